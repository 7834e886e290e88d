"""Quality rules by distribution divergence (DataFrame functions only).

Each document gets word, symbol, line and repetition counts, a histogram of character classes and one of common
words. The histograms are compared with those of its language in the corpus itself by Jensen-Shannon distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import broadcast_if_small, text_of, without, written

# Function words of the languages that have a common-word histogram.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was",
    "fr": "de la le que les et des un en qui pour dans",
    "de": "der die und den von zu das in nicht mit ist ein",
    "es": "de la que el en y los se del las un por",
}
# ASCII characters of each class, as regular expressions; what is left over is non-ASCII.
CLASSES = {"lower": "[a-z]+", "space": "[ \\t-\\r]+", "upper": "[A-Z]+", "stop": "[.,;:!?'\"()-]+", "digit": "[0-9]+", "symbol": "[\\x00-\\x7F]+"}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUTPUT = [*COUNTS, "base_failed", "class_distance", "word_distance", "kept"]


def _bins() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _with_repeat_words(step: DataFrame) -> DataFrame:
    """Adds n_repeat_words, words inside three-word windows that occur twice or more: windows sorted by hash show equal neighbours, whose starts, sorted again, cover at most three words each."""
    windows, near = F.col("__windows"), lambda k: F.get("__placed", k)["h"]
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    places = F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("i"))
    step = step.withColumn("__placed", F.when(repeats, F.sort_array(places)))
    found = F.filter("__placed", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    step = step.withColumn("__starts", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.transform("__starts", lambda x, k: F.least(F.lit(3), F.get("__starts", k + 1) - x))
    return step.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def _features(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    bins = _bins()
    signs = "".join(chr(0x30 + k) for k in range(len(bins)))  # one sign stands for each common word of a text, in a short string that is quick to count in
    step = docs.select(*carry, text_of(text).alias("__text")).withColumns(
        {
            "__words": F.array_remove(F.split("__text", "[ \\t-\\r]+"), ""),
            "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        }
    )
    n = F.size("__words")
    at = lambda i: F.get("__words", i)
    step = step.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>")),
            "__common": F.array_join(F.transform(F.filter(F.transform("__words", F.lower), lambda w: w.isin(bins)), lambda w: F.substring(F.lit(signs), F.array_position(F.array(*map(F.lit, bins)), w).cast("int"), F.lit(1))), ""),
            "__left0": F.col("__text"),
        }
    )
    for k, pattern in enumerate(CLASSES.values()):
        step = step.withColumn(f"__left{k + 1}", F.regexp_replace(f"__left{k}", pattern, ""))
    left = [F.length(f"__left{k}").cast("long") for k in range(len(CLASSES) + 1)]
    hits = [(F.octet_length("__common") - F.octet_length(F.replace("__common", F.lit(c), F.lit("")))).cast("long") for c in signs]
    return _with_repeat_words(step).select(
        *carry,
        *COUNTS,
        F.array(*[a - b for a, b in zip(left, left[1:])], left[-1]).alias("__class_hist"),
        F.array(*hits, F.col("n_words") - F.octet_length("__common")).alias("__word_hist"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.zip_with(counts, F.array_repeat(total, F.size(counts)), lambda x, t: x / t))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of shares; null if one is."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    carry: list[str] | None = None,
    min_chars: int = 200,
    min_words: int = 50,
    most_class: float = 0.28,
    most_words: float = 0.22,
    slack: float = 2.0,
    most_broadcast: int = 5000,
) -> DataFrame:
    """The rows of docs with the columns of OUTPUT; carry names the input columns to keep (all by default).

    base_failed: under 50 words, or over half the words in repeated three-word windows. kept: not base_failed, and
    neither histogram is too far from its language's. The character-class distance may be most_class at most and
    counts from min_chars characters in words; the common-word distance may be most_words + slack / sqrt(n_words)
    at most (short texts are noisy) and counts from min_words words. The language's histograms are sums over all its
    documents that pass the base rules; with a null language nothing is compared and the base rules alone decide. A null text counts as
    empty and fails the base rules; repeated rows are judged one by one; input columns named as in OUTPUT give way.
    """
    docs = without(docs, *OUTPUT)
    carry = [c for c in (carry or docs.columns) if c in docs.columns]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = written(_features(docs.withColumn("__lang", F.col(lang)), text, [*carry, "__lang"]).withColumn("base_failed", failed), "features")
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[k]) for k in range(n)])
    langs = (
        own.filter(F.col("__lang").isNotNull() & ~F.col("base_failed"))
        .groupBy("__lang")
        .agg(sums("__class_hist", len(CLASSES) + 1).alias("__class_ref"), sums("__word_hist", len(_bins()) + 1).alias("__word_ref"))
    )
    judged = own.join(broadcast_if_small(langs, most_broadcast), "__lang", "left").withColumns(
        {
            "class_distance": _distance(_shares(F.col("__class_hist")), _shares(F.col("__class_ref"))),
            "word_distance": _distance(_shares(F.col("__word_hist")), _shares(F.col("__word_ref"))),
        }
    )
    far = ((F.col("word_chars") >= min_chars) & (F.col("class_distance") > most_class)) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > most_words + slack / F.sqrt("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(*carry, *OUTPUT)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, carry=["doc_id"]).select("doc_id", *OUTPUT)

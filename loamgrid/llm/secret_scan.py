"""Secret scan with corpus-wide ownership frequency.

Candidates are found in each text by patterns; their hashes are then counted by distinct owners and repositories over
the whole corpus. What many owners carry is a copied example; what belongs to few looks like a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import broadcast_if_small, text_of, without, written

# The three base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "owned")

#: The method's own candidates: long runs that mix letters and digits, are no address, path or UUID, and look random.
OWNED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
ADDRESS = re.compile(r"(?i:https?:|ftp:|www\.)\S*")
#: Bits a character that a candidate's own distribution of characters must have.
LEAST_BITS = 3.3
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def looks_random(run: str) -> bool:
    """Letters and digits, no UUID, no path of words, no word and number joined, and characters spread as in a key."""
    if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)) or UUID.fullmatch(run):
        return False
    parts = [p for p in re.split("[/_=+-]+", run) if p]
    if len(parts) > 1 and all(p.isalpha() or p.isdigit() for p in parts):
        return False
    if re.fullmatch("[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+", run):
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= LEAST_BITS


def _outside(spans: list[tuple[int, int]], covered: list[tuple[int, int]]) -> list[bool]:
    """Which spans touch none of the covered ones; spans are in order and don't overlap each other."""
    covered, out, k, end = sorted(covered), [], 0, -1
    for a, b in spans:
        while k < len(covered) and covered[k][0] < b:
            end = max(end, covered[k][1])
            k += 1
        out.append(end <= a)
    return out


def find_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, hash of the value) of all candidates, in order of start and kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    if any(len(w) >= 20 and not w.isalpha() for w in text.split()):
        runs = [m for m in OWNED.finditer(text) if looks_random(m[0])]
        covered = [(a, b) for _, a, b, _ in found] + ([m.span() for m in ADDRESS.finditer(text)] if runs else [])
        found += [("owned", *m.span(), m[0]) for m, free in zip(runs, _outside([m.span() for m in runs], covered), strict=True) if free]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [(k, a, b, hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()) for k, a, b, v in found]


def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in find_spans(t)] for t in batch], dtype=object)


def secret_scan(
    docs: DataFrame,
    *,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    carry: list[str] | None = None,
    most_owners: int = 2,
    most_repositories: int = 50,
    owner_share: float = 0.2,
    repository_share: float = 0.2,
    most_broadcast: int = 300_000,
) -> DataFrame:
    """The rows of docs with secrets: array of (kind, start, end, value, owners, repositories, live), in order of start
    and kind. carry names the input columns to keep (all by default); an input column named secrets gives way.

    value is a hash. owners and repositories count, over the whole corpus, the distinct owners and (owner, repository)
    pairs that carry the value (null is a value of its own). live: the value is of one owner, however often it stands
    there; or its owners are at most owner_share of the corpus's owners, and the distinct texts that carry it at most
    repository_share of the repositories of its owners. In a small corpus most_owners owners and most_repositories
    texts are never too many. Candidates of the three base kinds are all kept; one of kind owned (a long run of letters and digits that looks random, outside of base spans and addresses) is kept only if it is live. Null
    and empty texts have none; rows with equal ids are scanned one by one and count as one repository.
    """
    docs = without(docs, "secrets")
    carry = carry or docs.columns
    scanned = docs.select(*carry, F.col(owner).alias("__owner"), F.col(repository).alias("__repository"), F.monotonically_increasing_id().alias("__row"), F.xxhash64(text_of(text)).alias("__text"), F.pandas_udf(_spans, SPANS)(text_of(text)).alias("__found"))
    scanned = written(scanned, "scanned")
    some = F.size("__found") > 0
    spans = scanned.filter(some).select("__row", "__owner", "__repository", "__text", F.posexplode("__found").alias("__at", "span")).select("__row", "__at", "__owner", "__repository", "__text", "span.*")
    repos = spans.select("value", "__owner", "__repository").distinct()
    owners = repos.groupBy("value", "__owner").agg(F.count(F.lit(1)).alias("repositories"))
    sizes = written(scanned.select("__owner", "__repository").distinct().groupBy("__owner").agg(F.count(F.lit(1)).alias("size")), "owners").withColumnRenamed("__owner", "__known")
    owners = owners.join(broadcast_if_small(sizes, most_broadcast), F.col("__owner").eqNullSafe(F.col("__known")))
    held = owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("size").alias("size"))
    held = held.join(spans.select("value", "__text").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("texts")), "value")
    few_owners = F.col("owners") <= max(most_owners, owner_share * sizes.count())
    few_texts = F.col("texts") <= F.greatest(F.lit(most_repositories), repository_share * F.col("size"))
    live = (F.col("owners") == 1) | (few_owners & few_texts)
    judged = spans.join(held, "value").withColumn("live", live).filter((F.col("kind") != "owned") | F.col("live"))
    one = F.struct("__at", "kind", "start", "end", "value", "owners", "repositories", "live")
    listed = judged.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(one)), lambda s: s.dropFields("__at")).alias("secrets"))
    empty = F.array().cast(listed.schema["secrets"].dataType)
    with_some = scanned.filter(some).join(listed, "__row", "left").select(*carry, F.coalesce("secrets", empty).alias("secrets"))
    return scanned.filter(~some).select(*carry, empty.alias("secrets")).unionByName(with_some)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs as secret_scan returns it, with every secret that is live replaced by mark in the text; overlapping spans go as one."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, found) -> str:
            out, at = [], 0
            for s in found:
                if s["live"] and s["end"] > at:
                    if s["start"] >= at:
                        out += [t[at : s["start"]], mark]
                    at = s["end"]
            return "".join(out) + t[at:]

        return pd.Series([one(t, f) for t, f in zip(texts, spans, strict=True)], dtype=object)

    any_live = F.exists("secrets", lambda s: s["live"])
    changed = docs.filter(any_live).withColumn(text, cut(F.col(text), F.transform("secrets", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["live"].alias("live")))))
    return docs.filter(~any_live).unionByName(changed)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda keep: F.array_join(F.transform(F.filter("secrets", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined(lambda s: s["kind"] != "owned"), 256).alias("base_sha256"),
        joined(lambda s: F.lit(True)).alias("spans"),
        joined(lambda s: s["live"]).alias("live_spans"),
    )

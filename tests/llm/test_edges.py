"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import bpe_codec, decontaminate, language_id, license_scan, ngram_join, quality_classifier, quality_rules, secret_scan, sharding, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, secrets string, shard int, ids string, score double, class_id string, n_tokens string"
LONG = "word of the long text " * 4000
ROWS = [(1, None, None, None, 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, LONG, "en", None, 1), (None, "a b c d e f", None, "a", 11), (None, "a b c d e f", None, "a", 11), (4, " \n\t ", "fr", "b", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, True, "x", 1, "y", 0.5, "z", "t") for r in ROWS], SCHEMA)


def test_sharding(docs, spark):
    for df in (docs, docs.limit(0)):
        out = sharding.hypergeometric_shuffle(df, shards=3, parts=8).collect()
        assert len(out) == df.count()
        for s in {r.shard for r in out}:
            own = sorted(r.slot for r in out if r.shard == s)
            assert own == list(range(len(own)))
        sizes = [sum(r.shard == s for r in out) for s in range(3)]
        assert max(sizes) - min(sizes) <= 1
    sharding.STEP, many = 7, spark.range(40).selectExpr("1 as x")
    assert sorted(r.slot for r in sharding.hypergeometric_shuffle(many, shards=1, parts=8).collect()) == list(range(40))


def test_license_scan(docs, spark):
    out = license_scan.license_scan(docs).collect()
    assert len(out) == len(ROWS) and all(r.n_base == 0 and r.labels == "" and r.score == 0 and r.first_word is None for r in out)
    assert license_scan.license_scan(docs.limit(0)).count() == 0
    text = "CC-BY. All rights reserved! released under the big MIT license; cc by"
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (13, 3, 0, 11, "cc-by,reserved", "cc-by,reserved", 1.0)
    whole = next(t for t, label in license_scan.NOTICES.items() if label == "mit-text").split()
    less = " ".join(["We", *whole[:60], "kindly", *whole[60:90], *whole[94:], "end"])
    rows = [(1, less), (2, "this wor\u212a is licensed under the GNU General Public License version 3"), (3, " ".join(whole[:40]))]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(whole) > 65 and "mit-text" in got[1].labels and 0.9 < got[1].score <= 1
    mixed = [" ".join(" ".join(whole[i : i + 3]) for i in range(len(whole) - 2)), " ".join(" ".join(whole[i : i + 8]) for i in range(len(whole) - 8, -1, -8)), " ".join(whole[::-1])]
    scattered = " so it is ".join(" ".join(whole[i : i + 2]) for i in range(0, len(whole), 2))
    for r in license_scan.license_scan(spark.createDataFrame([(k, t) for k, t in enumerate([*mixed, scattered])], "doc_id long, text string")).collect():
        assert (r.labels, r.score) == ("", 0.0), r
    twice = license_scan.license_scan(spark.createDataFrame([(1, " ".join([*whole, *["x"] * 5000, *whole]))], "doc_id long, text string")).first()
    assert twice.labels == "mit,mit-text" and twice.score == 1.0
    assert got[2].base_labels == "gpl" and got[2].n_words == 12 and "mit-text" not in got[3].labels


def test_secret_scan(docs, spark):
    out = secret_scan.secret_scan(docs)
    assert out.count() == len(ROWS) and out.filter(F.size("secrets") > 0).count() == 0 and secret_scan.secret_scan(docs.limit(0)).count() == 0
    copied, own = "api_key = '0123456789abcdef0123'", "é token: aZ09aZ09aZ09aZ09 and mixedRun1234567890abcXYZ"
    rows = [(k, copied, f"s{k}") for k in range(4)] + [(9, own, "s9"), (10, "secret=short token=secret=abcdefghijklmnop", "s9")]
    got = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(s.kind, s.start, s.end, s.live, s.owners) for s in got[0].secrets] == [("assign", 0, 31, False, 4), ("hex", 11, 31, False, 4)]
    assert [(s.kind, s.start, s.live) for s in got[9].secrets] == [("assign", 2, True), ("owned", 30, True)]
    assert [(s.kind, s.start, s.end) for s in got[10].secrets] == [("assign", 13, 42)]
    cut = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert cut[0] == copied and cut[9] == "é [SECRET] and [SECRET]"


def test_secrets_of_few_owners_stay_live(spark):
    key = lambda c: f"token={c}Z09aZ09aZ09a and mixedRun{c}1234567890abcXYZ"
    texts = [(f"note {k} {key('a')}", "s0") for k in range(60)]  # one owner, many texts
    texts += [(key("b"), f"s{k}") for k in range(3)]  # one text at three of twenty owners
    texts += [(key("c"), f"s{k % 2}") for k in range(120)]  # copies of one text at two owners
    texts += [(f"note {k} {key('d')}", f"s{k}") for k in range(15)]  # an example that most owners have
    texts += [(f"note {k} {key('e')}", f"s{k % 2}") for k in range(200)]  # two owners, most of their texts
    texts += [(key("f"), None)] * 60 + [("plain", f"s{k}") for k in range(20)]
    got = secret_scan.secret_scan(spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert len(got) == len(texts)
    live = {c: {(s.kind, s.live) for r in got if f"={c}Z09" in r.text for s in r.secrets} for c in "abcdef"}
    both, none = {("assign", True), ("owned", True)}, {("assign", False)}
    assert live == {"a": both, "b": both, "c": both, "d": none, "e": none, "f": both}


def test_ngram_join(docs):
    out = ngram_join.ngram_join(docs, carry=["doc_id"]).collect()
    assert len(out) == len(ROWS)
    assert [(r.class_id, r.n_links, r.kept) for r in out if r.doc_id == 2] == [(2, 0, True)] * 2
    twins = [r for r in out if r.doc_id is None]
    assert [r.n_links for r in twins] == [1, 1] and sum(r.kept for r in twins) == 1
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_tokens(docs):
    counts = token_counts.token_counts(docs, PATH).collect()
    codes = bpe_codec.bpe_encode(docs.drop("score"), PATH).collect()
    assert len(counts) == len(codes) == len(ROWS)
    assert [r.n_tokens for r in counts if not (r.text or "").strip()] == [0, 0, 0, 0]
    assert sorted(r.n_tokens for r in counts) == sorted(len(r.ids) // 4 for r in codes)
    assert [r.over_limit for r in counts if r.doc_id == 3] == [True]
    assert token_counts.token_counts(docs.limit(0), PATH).count() == bpe_codec.bpe_encode(docs.limit(0), PATH).count() == 0


def test_decontaminate(docs, spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "a b"), (None, "A, b; c d e F!")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.start, r.n_words, r.similarity) for r in out) == [("None", "1", 0, 6, 1.0), ("None", "3", 0, 2, 1.0), ("None", "None", 0, 6, 1.0)]
    odd = docs.withColumns({c: F.lit(1) for c in ("start", "m", "words", "all", "of", "similarity", "item", "__k1")})
    out = decontaminate.decontaminate(odd, bench, carry=odd.columns)
    assert out.columns == [*docs.columns, "m", "words", "all", "of", "item", "__k1", "item_id", "start", "n_words", "similarity"]
    assert {(r.m, r.words, r.all) for r in out.collect()} == {(1, 1, 1)}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == decontaminate.decontaminate(docs, bench.limit(0)).count() == 0


def test_models(docs, spark):
    labels = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for model in (quality_classifier.fit(docs, labels), b""):
        out = quality_classifier.quality_scores(docs, model).collect()
        assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    model = language_id.fit(docs)
    out = language_id.language_id(docs, model).collect()
    assert len(out) == len(ROWS) and {r.lang_pred for r in out if not (r.text or "").strip()} == {"und"}
    assert {r.lang_pred for r in language_id.language_id(docs, b"").collect()} == {"und"}
    assert language_id.fit(docs.limit(0)) == quality_classifier.fit(docs.limit(0), labels) == b""


def test_long_words_are_told_apart():
    words = ["alphabet", "mountain", "mountaim", "слово", "книга", "x" * 3000, "y" * 3000]
    assert len(set(quality_classifier.tokens([" ".join(words)])[0].tolist())) == len(words)
    alone = [quality_classifier.tokens([w])[0].tolist() for w in words]
    assert [b for a in alone for b in a] == quality_classifier.tokens([" ".join(words)])[0].tolist()
    vectors = quality_classifier.word_vectors(quality_classifier.context_sums(["mountain river alphabet forest meadow"]))
    a, b = quality_classifier.pooled(["mountain river", "alphabet meadow"], vectors)
    assert abs(a - b).max() > 0.01


def test_quality_rules(docs):
    out = quality_rules.quality_rules(docs).collect()
    assert len(out) == len(ROWS) and not any(r.kept for r in out)
    assert [(r.n_words, r.n_repeat_words) for r in out if r.doc_id == 3] == [(20000, 20000)]
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_short_items_and_documents_shorter_than_they(spark):
    item = "one two three four five six seven eight nine ten eleven twelve".split()
    items = {1: item, 2: item[:9], 3: ["a", "b", "c"], 4: item[:8]}
    texts = [item[:11], item[1:], item[:10], item, ["x", *item], ["x", *item[:11]], item[:8], item[:9], ["a", "b", "c"], ["a", "b"], item[1:11], [], [*item[:9], *item[:9]], ["b", "a", "b", "c"]]

    def similar(a, b):
        a, b = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
        return sum((a & b).values()) / sum((a | b).values())

    want = {(d, i) for d, w in enumerate(texts) for i, it in items.items() for s in range(max(1, len(w) - len(it) + 1)) if w and similar(w[s : s + len(it)], it) >= 0.8 and (len(it) >= 5 or w[s : s + len(it)] == it)}
    make = lambda rows, names: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], names)
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(make(enumerate(texts), "doc_id long, text string"), make(items.items(), "item_id long, text string")).collect()}
    assert got == want and {(0, 1), (1, 1), (3, 4), (12, 4)} <= want

"""Operators against plain Python on the smallest tables and on random texts."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamgrid.llm import bpe_codec, language_id, ngram_join, quality_classifier, secret_scan, sharding, token_counts
from loamgrid.llm.decontaminate import decontaminate
from loamgrid.llm.license_scan import ORACLE, op2_license_scan
from loamgrid.llm.quality_rules import COUNTS, op10_quality_rules
from loamgrid.llm.secret_scan import op3_secret_scan
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def table():
    return pd.read_parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(texts, threshold=0.8):
    """(least member of the class, number of links) of each text."""
    sets, held = [shingles(t) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    up, links = list(range(len(sets))), [0] * len(sets)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in held[g] if j > i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [(top(i), links[i]) for i in range(len(sets))]


@pytest.mark.parametrize("block", [512, 7])
def test_ngram_join(spark, block):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 400)) for _ in range(rng.choice([3, 60, 150]))]
        for _ in range(rng.choice([1, 5, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = str(rng.random())
            texts.append(" ".join(copy))
    got = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block, block_shingles=2000).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == dict(enumerate(linked(texts)))
    assert sorted(r.class_id for r in got if r.kept) == sorted({r.class_id for r in got})


def test_ngram_join_with_empty_blocks(spark):
    texts = []
    for c in range(8):
        base = [f"{c}x{i}" for i in range(300)]
        texts += [" ".join(base), " ".join(base[:-2]), *[" ".join(base + [f"{c}y{i}"]) for i in range(c % 2)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (500, 100):
        got = ngram_join.ngram_join(docs, block_shingles=most).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == dict(enumerate(linked(texts)))


def test_depth_shortens_until_the_recall_is_met():
    assert ngram_join.prefix_depth(0.8, 0.999) == 4 and ngram_join.prefix_depth(0.8, 0.5) > 4


def windows_alike(text, item, k=5):
    """(similarity, first start) of the best window of the item's length."""
    words, goal = WORD.findall(text.lower()), WORD.findall(item.lower())
    bag = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])
    want, best = bag(goal), (0.0, 0)
    for i in range(max(1, len(words) - len(goal) + 1)):
        got = bag(words[i : i + len(goal)])
        alike = sum((got & want).values()) / sum((got | want).values())
        best = max(best, (alike, -i))
    return best[0], -best[1]


def test_decontaminate(spark, table):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: f" {' '.join(WORD.findall(t.lower()))} "
    want = {(d, i) for d, t in zip(table.doc_id, map(plain, table.text)) for i, b in zip(bench.item_id, map(plain, bench.text)) if b in t}
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = decontaminate(docs, items).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got} and all(r.similarity >= 0.8 for r in got)
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)


def test_decontaminate_against_all_windows(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randint(0, 300))
    items = [" ".join(word() for _ in range(n)) for n in (3, 6, 12, 13, 15, 20, 27, 34, 41, 50, 58, 59, 64, 120, 300)]
    texts = []
    for t in items:
        w = t.split()
        for edit in range(6):
            x = list(w)
            if edit == 1:
                x[rng.randrange(len(x))] = word()
            elif edit == 2:
                x.insert(rng.randrange(len(x)), word())
            elif edit == 3:
                x = x[: len(x) - max(1, len(x) // 12)]
            elif edit == 4:
                x = x[max(1, len(x) // 12) :]
            elif edit == 5:
                del x[rng.randrange(len(x))]
            texts.append(" ".join([word() for _ in range(rng.randint(0, 90))] + x + [word() for _ in range(rng.randint(0, 90))]))
    texts += ["a b c d " * 700, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i): a for d, t in enumerate(texts) for i, x in enumerate(items) if (a := windows_alike(t, x))[0] >= 0.8}
    for most in (500_000, 3):
        got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate(docs, bench, most_broadcast=most).collect()}
        assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
        assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in got if want[p][0] == 1)


def test_license_scan_equals_oracle(spark):
    assert rows(op2_license_scan(spark, SF).toPandas()) == rows(oracle(ORACLE, SF))


def test_quality_counts(spark, table):
    got = op10_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(table.doc_id, table.text):
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(three)
        repeated = {k + j for k, x in enumerate(three) if count[x] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got.loc[i, COUNTS]) == want
    assert not got.kept[got.base_failed].any() and got.kept[~got.base_failed].mean() > 0.9


def base_spans(text):
    """The three base kinds by plain patterns, in the order of their digests."""
    kinds = [
        ("assign", [m.span() for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 12]),
        ("access", [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]),
        ("hex", [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]),
    ]
    return kinds, sorted((a, k, b) for k, (_, spans) in enumerate(kinds) for a, b in spans)


def test_secret_base_spans(spark, table):
    got = op3_secret_scan(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(table.doc_id, table.text):
        kinds, spans = base_spans(t)
        assert [got.loc[i, f"n_{k}"] for k, _ in kinds] == [len(s) for _, s in kinds]
        listed = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans]
        assert got.base_sha256[i] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(got.spans[i].split(",")) | {""}


def test_secret_owners_over_the_corpus(spark, table):
    """Owners and repositories of every value, counted by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, texts = defaultdict(set), defaultdict(set)
    for i, t, s in zip(table.doc_id, table.text, table.source):
        for *_, value in secret_scan.find_spans(t):
            held[value].add((s, i))
            texts[value].add(t)
    sizes = Counter(table.source)
    for r in secret_scan.secret_scan(docs, carry=["doc_id"]).collect():
        for s in r.secrets:
            owners = {o for o, _ in held[s.value]}
            few = len(owners) <= max(2, 0.2 * len(sizes)) and len(texts[s.value]) <= max(50, 0.2 * sum(sizes[o] for o in owners))
            assert (s.owners, s.repositories, s.live) == (len(owners), len(held[s.value]), len(owners) == 1 or few)


def test_own_secrets_have_structure():
    found = lambda t: [(k, a, b) for k, a, b, _ in secret_scan.find_spans(t)]
    assert found("key mixedRun1234567890abcXYZ end") == [("owned", 4, 28)]
    for t in ("see https://host.example/a/B9c8D7x6F5q4Z3c2K1w8/xyz", "id 123e4567-e89b-12d3-a456-426614174000", "some/long-path_of/words-and/2024", "chapterchapterchapter00012345", "zzzzzzzzzzzzzzzz1111zzzz2222"):
        assert found(t) == []
    t = " ".join(f"token={k:012d}abcdef Zx9{k:05d}qWeRtYuIoPaS" for k in range(4000))
    began = time.time()
    assert len(found(t)) >= 8000 and time.time() - began < 5


@pytest.fixture(scope="module")
def texts(table):
    rng = random.Random(3)
    made = ["".join(rng.choice(a) for _ in range(rng.choice([5, 40, 200]))) for a in ("aab", "thein ", "a'sd ll.,!1", "<|endoftext|>ab ", "éèΣİ日 a", "...!--=") for _ in range(40)]
    return [*table.text[:120], *made, "x<|endoftext|>y", "ΟΔΟΣ Σ", "a" * 3000, ""]


def test_tokens_equal_the_library(texts):
    library, codec, counter = Tokenizer.from_file(PATH), bpe_codec.codec(PATH), token_counts.transducer(PATH)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids and codec.decode(got) == library.decode(ids, skip_special_tokens=False)
        assert counter.count(t) == len(ids)
        state, n = json.dumps(counter.start.key), 0
        for part in counter.chunks(t, 11):
            found = counter.chunk_map(*part)
            if state not in found:
                n = len(ids)
                break
            state, k = found[state]
            n += k
        assert n == len(ids)


def test_long_stretches_take_the_parallel_way(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["ab" * 300 + " x " + "<|endoftext|>" * 9 + "é" * 90, "plain text"])], "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    for r in bpe_codec.bpe_encode(df, PATH, most_unsplit=20).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids
        assert r.decoded == library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
    for r in token_counts.token_counts(df, PATH, chunk=16).collect():
        assert r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids)


def test_communication_matrix(spark):
    counts = [5, 0, 100, 37, 2000, 3, 50, 805]
    df = spark.createDataFrame(list(enumerate(counts)), "part long, n long")
    drawn = np.array([[r.sent for r in sharding.communication_matrix(df, 8, 4, seed).orderBy("part").collect()] for seed in range(12)])
    assert (drawn.sum(2) == counts).all() and (drawn.sum(1) == 750).all()
    assert abs(drawn.mean((0, 2))[4] - 500) < 1e-9 and 2 < drawn[:, 4].std() < 25


def test_held_out_accuracy(spark):
    docs, labels = pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    got = language_id.op9_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(docs, on="doc_id")
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    got = quality_classifier.op8_quality_classifier(spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93


def test_learnt_word_vectors_beat_random_ones():
    table = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = table["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 3 == 1).to_numpy()
    texts, y = table["text"].fillna(""), table["quality"].to_numpy()
    right = []
    for sums in (quality_classifier.context_sums(texts[~held].tolist()), np.zeros((quality_classifier.BUCKETS, quality_classifier.WIDTH + 1))):
        vectors = quality_classifier.word_vectors(sums)
        model = quality_classifier.train(vectors, quality_classifier.pooled(texts[~held].tolist(), vectors), y[~held])
        right.append(((quality_classifier.scores(texts[held].tolist(), model) >= 0.5) == y[held]).mean())
    assert right[0] > 0.995 and 1 - right[0] < 0.5 * (1 - right[1])


def test_pooling_against_plain_loops():
    texts = ["", "one", "the same the same " * 30 + "end.", "A1 b2, c3! " * 9, "x y"]
    vectors = quality_classifier.word_vectors(quality_classifier.context_sums(texts))
    t, owner = quality_classifier.tokens(texts)
    got = quality_classifier.pooled(texts, vectors)
    for k in range(len(texts)):
        x = vectors[t[owner == k]].astype(float)
        if not len(x):
            assert not got[k].any()
            continue
        cuts = [c for c in range(0, len(x), 16) if c == 0 or len(x) - c >= 8]
        windows = [x[a:b] for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True)]
        want = np.hstack([x.mean(0), x.std(0), x.max(0), x.min(0), np.min([w.std(0) for w in windows], axis=0)])
        assert np.abs(got[k] - want).max() < 1e-3

"""The pipeline against brute force, stage by stage, each on its own input."""

import re

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_brute_force import SF, WORD, linked


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.toPandas())
    assert all(list(s.columns) == columns for s in seen[:-1])
    start, good, single, clean, safe, coded = seen
    assert set(good.doc_id) <= set(start.doc_id) and (good.text.str.split().str.len() >= 50).all()
    assert sorted(single.doc_id) == sorted(good.doc_id.iloc[i] for i in {c for c, _ in linked(list(good.sort_values("doc_id").text))}) or len(single) == len({c for c, _ in linked(list(good.text))})
    plain = lambda t: f" {' '.join(WORD.findall(t.lower()))} "
    items = [plain(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    leaky = {i for i, t in zip(single.doc_id, map(plain, single.text)) if any(b in t for b in items)}
    assert leaky <= set(single.doc_id) - set(clean.doc_id) and len(clean) >= len(single) - len(leaky) - 2
    assert sorted(safe.doc_id) == sorted(clean.doc_id) and (safe.n_chars == safe.text.str.len()).all()
    same = safe.set_index("doc_id").text[lambda s: ~s.str.contains("[SECRET]", regex=False)]
    assert (clean.set_index("doc_id").text[same.index] == same).all() and not same.str.contains(re.compile("token = .[0-9a-f]{40}")).all()
    library, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), safe.set_index("doc_id").text
    for r in coded.itertuples():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, and an empty table pass every stage; the rules drop what has too few words."""
    good = " ".join(a + b + c for a in ("ka", "lo", "mi", "ne") for b in ("ru", "sa", "te", "vo") for c in ("n", "r", "st", "l", "x"))
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, good, None, None, None), (3, good, None, "a", len(good)), (3, good, None, "a", len(good))]
    whole = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for n, docs in enumerate((whole, whole.limit(0))):
        counts = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            counts.append(docs.count())
        assert counts == ([3, 1, 1, 1, 1] if n == 0 else [0] * 5)

"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Every token bucket has a fixed sparse random index vector. A bucket's word vector is its own index vector and the sum of
those that stand around it in the training texts, shifted by their place, so that order counts, less what stands around
any token. A document is pooled from the vectors of its tokens alone: their mean, spread, greatest and least values, and
the least spread of any window of WINDOW tokens.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import text_of, without, written
from loamgrid.llm.shingles import run_hashes

BUCKETS, WIDTH, HIDDEN, AROUND = 1 << 14, 96, 24, 3
#: Tokens of a window; a last window of less than half of them belongs to the one before.
WINDOW = 16
#: Mean, spread, greatest, least, and least spread of a window.
FEATURES = 5 * WIDTH
#: Byte classes: white space 0, small and non-ASCII letters 1, capitals 2, digits 3, other signs 4.
CLASS = np.array([1 if b >= 128 or chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 0 if b <= 32 else 4 for b in range(256)], np.int8)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of every token. A token is a run of bytes of one class; all its bytes choose its bucket."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = CLASS[data]
    cut = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    begins, lengths = cut[:-1], np.diff(cut)
    seen = kind[begins] > 0
    begins, lengths = begins[seen], lengths[seen]
    bucket = (run_hashes(data, begins, begins + lengths) % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), begins, side="right")
    return bucket, owner


def _groups(texts: list[str], most_bytes: int = 1 << 18) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most_bytes:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


@functools.cache
def index_vectors() -> np.ndarray:
    return np.random.default_rng(8).choice(np.array([-1, 0, 1], np.float32), (BUCKETS, WIDTH), p=[0.06, 0.88, 0.06])


def context_sums(texts: list[str]) -> np.ndarray:
    """For every bucket the sum of the index vectors around it, each shifted by its distance, and how often it stands there."""
    index, sums = index_vectors(), np.zeros((BUCKETS, WIDTH + 1))
    for group in _groups(texts):
        t, owner = tokens(group)
        near = np.zeros((len(t), WIDTH), np.float32)
        for d in range(1, AROUND + 1):
            same = (owner[d:] == owner[:-d])[:, None]
            near[d:] += np.roll(index, d, axis=1)[t[:-d]] * same
            near[:-d] += np.roll(index, -d, axis=1)[t[d:]] * same
        for k in range(WIDTH):
            sums[:, k] += np.bincount(t, near[:, k], BUCKETS)
        sums[:, WIDTH] += np.bincount(t, minlength=BUCKETS)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Word vectors of length 1 from context sums: less the mean context of a token, and with the bucket's own index vector, which is all that an unseen one has."""
    seen = sums[:, WIDTH:]
    own = sums[:, :WIDTH] - seen * (sums[:, :WIDTH].sum(axis=0) / max(1, seen.sum())) + index_vectors()
    norm = np.linalg.norm(own, axis=1, keepdims=True)
    return (own / np.where(norm > 0, norm, 1)).astype(np.float32)


def _spread(sums: np.ndarray, squares: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares / n - np.square(sums / n), 0))


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers of each text from the word vectors of its tokens; zeros for a text without tokens."""
    out = []
    for group in _groups(texts):
        t, owner = tokens(group)
        row = np.zeros((len(group), FEATURES), np.float32)
        if len(t):
            x = vectors[t]
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            has, n = owner[begins], np.diff(np.append(begins, len(t)))
            place = np.arange(len(t)) - np.repeat(begins, n)
            cuts = np.flatnonzero(place % WINDOW == 0)
            whole = (np.diff(np.append(cuts, len(t))) >= WINDOW // 2) | (place[cuts] == 0)
            cuts = cuts[whole]
            size = np.diff(np.append(cuts, len(t)))[:, None]
            first = np.flatnonzero(np.diff(owner[cuts], prepend=-1))  # each text's first window
            sums, most, least = np.add.reduceat(x, cuts, axis=0), np.maximum.reduceat(x, begins, axis=0), np.minimum.reduceat(x, begins, axis=0)
            squares = np.add.reduceat(np.square(x, out=x), cuts, axis=0)
            all_sums, all_squares, n = np.add.reduceat(sums, first, axis=0), np.add.reduceat(squares, first, axis=0), n[:, None]
            row[has] = np.hstack([all_sums / n, _spread(all_sums, all_squares, n), most, least, np.minimum.reduceat(_spread(sums, squares, size), first, axis=0)])
        out.append(row)
    return np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)


def _forward(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh((x - m["mean"]) / m["scale"] @ m["w1"] + m["b1"])
    return h, h @ m["w2"] + m["b2"]


def train(vectors: np.ndarray, x: np.ndarray, labels: np.ndarray, epochs: int = 400, rate: float = 0.01, decay: float = 1e-2) -> dict:
    """The model from pooled rows; one row in five is set aside to fit the temperature."""
    y = labels.astype(float)
    rng = np.random.default_rng(9)
    aside = rng.random(len(y)) < 0.2
    aside &= not aside.all()
    xt, yt = x[~aside].astype(float), y[~aside]
    m = {"vectors": vectors, "mean": xt.mean(0), "scale": xt.std(0) + 1e-4, "w1": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": 0.0, "t": 1.0}
    names, state = ("w1", "b1", "w2", "b2"), {}
    z = (xt - m["mean"]) / m["scale"]
    for step in range(1, epochs + 1):
        h, logit = _forward(m, xt)
        d = (1 / (1 + np.exp(-logit)) - yt) / max(1, len(yt))
        back = d[:, None] * m["w2"] * (1 - h**2)
        grads = {"w1": z.T @ back + decay * m["w1"], "b1": back.sum(0), "w2": h.T @ d + decay * m["w2"], "b2": d.sum()}
        for k in names:
            a, b = state.get(k, (0.0, 0.0))
            a, b = 0.9 * a + 0.1 * grads[k], 0.999 * b + 0.001 * np.square(grads[k])
            state[k] = a, b
            m[k] = m[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    if aside.any():
        logit, ya = _forward(m, x[aside])[1], y[aside]
        m["t"] = float(min(np.geomspace(0.25, 8, 41), key=lambda t: np.logaddexp(0, np.where(ya > 0, -1, 1) * logit / t).sum()))
    return m


def scores(texts: list[str], m: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_forward(m, pooled(texts, m["vectors"]))[1] / m["t"], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: Column | None = None, most_rows: int = 5000) -> bytes:
    """The model as bytes, fitted on at most most_rows labelled rows: those whose ids hash lowest.

    Labels other than 0 and 1 and null ids are left out, as are rows for which `rows` (a condition on the labels) isn't true; of texts with one id the least counts. Word vectors and pooled rows are made where the texts lie; the driver gets the table of buckets, the task that trains one row of FEATURES numbers per text. Without any row the model is empty; with one class only it has nothing to tell apart.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.filter(rows) if rows is not None else known
    # At most most_rows rows of two numbers.
    chosen = F.broadcast(known.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(most_rows))
    sample = written(docs.select(F.col(doc_id).alias("id"), text_of(text).alias("body")).join(chosen, "id").groupBy("id", "y").agg(F.min("body").alias("body")), "sample")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((BUCKETS, WIDTH + 1))
        for batch in batches:
            sums += context_sums(batch["body"].tolist())
        seen = np.flatnonzero(np.abs(sums).sum(axis=1))
        if len(seen):
            yield pd.DataFrame({"bucket": seen, "sums": list(sums[seen])})

    parts = sample.select("body").mapInPandas(summed, "bucket long, sums array<double>")
    found = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(WIDTH + 1)]).alias("sums")).collect()  # BUCKETS rows at most
    if not found:
        return b""
    sums = np.zeros((BUCKETS, WIDTH + 1))
    for r in found:
        sums[r["bucket"]] = r["sums"]
    held = docs.sparkSession.sparkContext.broadcast(word_vectors(sums))

    @F.pandas_udf("array<float>")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(list(pooled(batch.tolist(), held.value)), dtype=object)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "y"])
        return pd.DataFrame({"model": [pickle.dumps(train(held.value, np.stack(group["x"].to_list()).astype(np.float32), group["y"].to_numpy()))]})

    made = sample.select("id", "y", vector("body").alias("x")).groupBy().applyInPandas(one, "model binary").collect()
    return bytes(made[0][0]) if made else b""


def quality_scores(docs: DataFrame, model: bytes, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    A null or empty text has the vector zero and gets that vector's score; without a model every score is 0.5. Input columns named score or predicted give way.
    """
    docs = without(docs, "score", "predicted")
    carry = carry or docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: bounded by the table of buckets

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = pickle.loads(held.value) if held.value else None
        for batch in texts:
            yield pd.Series(scores(batch.tolist(), m) if m else np.full(len(batch), 0.5))

    return docs.select(*carry, scored(text_of(text)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=fold != 1)
    return quality_scores(docs, model, carry=["doc_id"]).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")

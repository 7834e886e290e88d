"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It gives every byte a distribution over the languages;
a document's probabilities are the mean over its letter bytes. Texts are read in stretches of a fixed number of bytes,
each from a fresh state, all of the text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import text_of, without

STRETCH, HIDDEN = 64, 8
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def _stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, index of the text) of all stretches; the last of a text is filled up with zero bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = [-(-len(r) // STRETCH) for r in raw]
    data = b"".join(r + bytes(k * STRETCH - len(r)) for r, k in zip(raw, n, strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, STRETCH), np.repeat(np.arange(len(raw)), n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: half of one plus the hyperbolic tangent of half."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _run(d: dict, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, stretch, HIDDEN) of one direction; x is (time, stretch) bytes in its order of reading. keep gathers what training needs."""
    out = np.zeros((*x.shape, HIDDEN), np.float32)
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    for t in range(len(x)):
        own, past = d["in"][x[t]], h @ d["rec"]
        gates = _sigmoid(own[:, : 2 * HIDDEN] + past[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(own[:, 2 * HIDDEN :] + r * past[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((x[t], h, z, r, c, past[:, 2 * HIDDEN :]))
        h = c + z * (h - c)
        out[t] = h
    return out


def _run_fast(d: dict, x: np.ndarray) -> np.ndarray:
    """As _run, for prediction: gates lie apart from each other and are kept as hyperbolic tangents, g = (1 + tanh) / 2."""
    n, k = x.shape[1], HIDDEN
    table = [np.ascontiguousarray(d["in"][:, j * k : (j + 1) * k] * (0.5 if j < 2 else 1)) for j in range(3)]
    rec = np.stack([d["rec"][:, j * k : (j + 1) * k] * (0.5 if j < 2 else 1) for j in range(3)])
    out = np.empty((len(x), n, k), np.float32)
    own, past, h = np.empty((3, n, k), np.float32), np.empty((3, n, k), np.float32), np.zeros((n, k), np.float32)
    for t in range(len(x)):
        for j in range(3):
            table[j].take(x[t], axis=0, out=own[j], mode="clip")
        np.matmul(h, rec, out=past)
        own[:2] += past[:2]
        np.tanh(own[:2], out=own[:2])
        z, r, c = own
        past[2] *= 0.5
        r += 1
        r *= past[2]
        c += r
        np.tanh(c, out=c)
        np.subtract(h, c, out=r)
        r *= z
        r += h
        r += c
        h = np.multiply(r, 0.5, out=out[t])
    return out


def _back(d: dict, keep: list, dout: np.ndarray) -> dict:
    """Gradients of one direction, by time from the end."""
    g = {k: np.zeros_like(v) for k, v in d.items()}
    dh = np.zeros_like(dout[0])
    for t in range(len(keep) - 1, -1, -1):
        x, h, z, r, c, past = keep[t]
        dh = dh + dout[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * past * r * (1 - r)
        own = np.concatenate([dz, dr, dc], axis=1)
        rec = np.concatenate([dz, dr, dc * r], axis=1)
        for k in range(own.shape[1]):
            g["in"][:, k] += np.bincount(x, own[:, k], 256)
        g["rec"] += h.T @ rec
        dh = dh * z + rec @ d["rec"].T
    return g


def _chances(m: dict, x: np.ndarray, keeps: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(distribution over the languages, states) of every byte; x is (time, stretch)."""
    ahead, behind = keeps or (None, None)
    if keeps:
        states = np.concatenate([_run(m["ahead"], x, ahead), _run(m["behind"], x[::-1], behind)[::-1]], axis=2)
        p = states @ m["out"] + m["bias"]
    else:
        states = None
        p = _run_fast(m["ahead"], x) @ m["out"][:HIDDEN]
        p += (_run_fast(m["behind"], x[::-1]) @ m["out"][HIDDEN:])[::-1]
        p += m["bias"]
    np.exp(np.minimum(p, 60, out=p), out=p)
    p /= p.sum(axis=2, keepdims=True)
    return p, states


def train(x: np.ndarray, langs: list[str], batch: int = 256, epochs: int = 6, rate: float = 0.01) -> dict:
    """The model from stretches and the language of each; languages weigh alike."""
    rng = np.random.default_rng(11)
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    weight = (1 / np.bincount(y, minlength=len(names)).clip(1))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    draw = lambda a, b, s: rng.normal(0, s, (a, b)).astype(np.float32)
    one = lambda: {"in": draw(256, 3 * HIDDEN, 0.3), "rec": draw(HIDDEN, 3 * HIDDEN, 1 / np.sqrt(HIDDEN))}
    m = {"langs": names, "ahead": one(), "behind": one(), "out": draw(2 * HIDDEN, len(names), 0.3), "bias": np.zeros(len(names), np.float32)}
    state: dict = {}
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            step += 1
            xb = np.ascontiguousarray(x[part].T)
            keeps: tuple = ([], [])
            p, states = _chances(m, xb, keeps)
            d = p.copy()
            d[:, np.arange(len(part)), y[part]] -= 1
            d *= (LETTER[xb] * weight[part])[:, :, None] / max(1, LETTER[xb].sum())
            ds = d @ m["out"].T
            flat = d.reshape(-1, d.shape[2])
            grads = {("out",): states.reshape(-1, 2 * HIDDEN).T @ flat, ("bias",): flat.sum(0)}
            for side, keep, part_ds in (("ahead", keeps[0], ds[:, :, :HIDDEN]), ("behind", keeps[1], ds[::-1, :, HIDDEN:])):
                grads |= {(side, k): v for k, v in _back(m[side], keep, part_ds).items()}
            size = np.sqrt(sum(float(np.square(g).sum()) for g in grads.values()))
            for key, g in grads.items():
                g = g / max(1.0, size)
                a, b = state.get(key, (0.0, 0.0))
                a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * np.square(g)
                state[key] = a, b
                move = (rate * (1 - epoch / (epochs + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if len(key) == 1:
                    m[key[0]] = m[key[0]] - move
                else:
                    m[key[0]][key[1]] = m[key[0]][key[1]] - move
    return m


def predict(texts: list[str], m: dict, batch: int = 2048) -> tuple[list[str], list[float]]:
    """(language, its pooled probability) of each text; `und` and 0 for one without a letter."""
    x, owner = _stretches(texts)
    total = np.zeros((len(texts), len(m["langs"])))
    for k in range(0, len(x), batch):
        part, own = x[k : k + batch], owner[k : k + batch]
        sums = np.einsum("tsl,ts->sl", _chances(m, np.ascontiguousarray(part.T))[0], LETTER[part.T].astype(np.float32))
        for j in range(total.shape[1]):
            total[:, j] += np.bincount(own, sums[:, j], len(texts))
    whole = total.sum(1)
    best = total.argmax(1)
    has = [w > 0 and any(map(str.isalpha, t)) for w, t in zip(whole, texts, strict=True)]
    return [m["langs"][b] if h else "und" for b, h in zip(best, has, strict=True)], [float(total[i, b] / whole[i]) if h else 0.0 for i, (b, h) in enumerate(zip(best, has, strict=True))]


def fit(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", rows: Column | None = None, most_rows: int = 4000, most_stretches: int = 16_384) -> bytes:
    """The model as bytes, fitted in one task on at most most_stretches stretches, drawn by hash from the whole texts of at most most_rows documents with a language: those whose ids hash lowest.

    rows: a condition on docs that training rows must meet. Null ids and languages are left out; of texts with one id and language the least counts; without any row the model is empty.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    known = known.filter(rows) if rows is not None else known
    # At most most_rows rows of an id and a language.
    chosen = F.broadcast(known.select(F.col(doc_id).alias("id"), F.col(lang).alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(most_rows).distinct())
    sample = known.select(F.col(doc_id).alias("id"), F.col(lang).alias("y"), F.col(text).alias("body")).join(chosen, ["id", "y"]).groupBy("id", "y").agg(F.min("body").alias("body"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, i, body in zip(batch["y"], batch["id"], batch["body"], strict=True):
                x = _stretches([body])[0]
                yield pd.DataFrame({"id": i, "k": range(len(x)), "y": y, "stretch": [r.tobytes() for r in x]})

    stretches = sample.mapInPandas(cut, T.StructType([sample.schema["id"], T.StructField("k", T.LongType()), T.StructField("y", T.StringType()), T.StructField("stretch", T.BinaryType())]))
    drawn = stretches.orderBy(F.xxhash64("id", "k"), "id", "y", "k").limit(most_stretches)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "y", "k"])
        x = np.frombuffer(b"".join(group["stretch"]), np.uint8).reshape(-1, STRETCH)
        return pd.DataFrame({"model": [pickle.dumps(train(x, group["y"].tolist()))]})

    made = drawn.groupBy().applyInPandas(one, "model binary").collect()
    return bytes(made[0][0]) if made else b""


def language_id(docs: DataFrame, model: bytes, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of docs with lang_pred and score (its probability).

    `und` with score 0 where the text is null or has no letter, and everywhere if the model is empty; of languages with equal probabilities the first by name. Input columns named lang_pred or score give way.
    """
    docs = without(docs, "lang_pred", "score")
    carry = carry or docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)  # tens of KB

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(held.value) if held.value else None
        for batch in texts:
            langs, scores = predict(batch.tolist(), m) if m else (["und"] * len(batch), [0.0] * len(batch))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.select(*carry, told(text_of(text)).alias("__told")).select(*carry, "__told.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs, rows=fold != 0)
    return language_id(docs, model, carry=["doc_id"]).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Knowledge bundles (zip files of JSON lines, float32 vectors, an inverted index and a link graph) as DataFrames.

Bundles are read with Spark's binaryFile source, so they may be in any store that Spark reaches; a bundle is one row of
(bundle, path, bytes) per entry.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "id string, type string, display_title string, trigger_phrases map<string,array<string>>, question_variants map<string,array<string>>, source struct<document:string,span:string>, checksum string, aspects array<string>"
MANIFEST = "version string, schema_version string, sha256 string, size_kb double, languages array<string>, chunk_count long, created_at string, document_source string, document_sources array<string>"
VERSIONS = ("3.0", "4.0")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, path, bytes) of every entry of the zip files at path."""
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"))


def unzipped(archives: DataFrame) -> DataFrame:
    """(bundle, path, bytes) of every entry of zip files (path, content); slashes around names are cut, folders left out."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple[str, str, bytes]]:
            for batch in batches:
                for bundle, content in zip(batch["path"], batch["content"], strict=True):
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                        for name in z.namelist():
                            if name.strip("/") and not name.endswith("/"):
                                yield bundle.as_py(), name.strip("/"), z.read(name)

        return in_batches(entries(), ["bundle", "path", "bytes"])

    return archives.select("path", "content").mapInArrow(unzip, "bundle string, path string, bytes binary")


def in_batches(rows: Iterator[tuple], names: list[str], most_bytes: int = 4_000_000, most_rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is bytes as batches of about most_bytes, so that a task holds no more of them; a longer row stands alone."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most_bytes or len(held) >= most_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)


def _text(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path).select("bundle", F.decode("bytes", "UTF-8").alias("text"))


def manifests(files: DataFrame) -> DataFrame:
    """One row per bundle; an old single document source counts as a list of one. A version other than 3.0 and 4.0 is an error."""
    m = _text(files, "manifest.json").select("bundle", F.from_json("text", MANIFEST).alias("m")).select("bundle", "m.*")
    m = m.withColumn("document_sources", F.coalesce("document_sources", F.when(F.col("document_source").isNotNull(), F.array("document_source")))).drop("document_source")
    return m.withColumn("schema", checked_version(F.coalesce("schema_version", "version")))


def checked_version(version: Column) -> Column:
    """Major and minor number without a leading v; an error if it isn't a known one."""
    short = F.regexp_extract(version, "^[vV]?(\\d+\\.\\d+)", 1)
    return F.when(short.isin(*VERSIONS), short).otherwise(F.raise_error(F.concat(F.lit("unsupported bundle version "), F.coalesce(version, F.lit("none")))))


def chunks(files: DataFrame, path: str = "content/chunks.jsonl") -> DataFrame:
    """The chunks of all bundles with their content as JSON text; lines that aren't JSON, or lack an id, a type or content, are left out."""
    lines = _text(files, path).select("bundle", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    parsed = lines.select("bundle", "ord", F.from_json("line", CHUNK).alias("c"), F.get_json_object("line", "$.content").alias("content"))
    full = F.col("c.id").isNotNull() & F.col("c.type").isNotNull() & F.col("content").startswith("{") & (F.regexp_replace("content", "\\s", "") != "{}")
    return parsed.filter(full).select("bundle", "ord", "c.*", "content")


def vectors(files: DataFrame, path: str = "index/embeddings.bin", ids: str = "index/embeddings_index.json") -> DataFrame:
    """(bundle, ord, chunk_id, embedding): little-endian counts of rows and columns, then float32 values; a file too short gives none.

    The id index is an object by place or a plain list; a place without an id has its number for one.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, content in zip(batch["bundle"], batch["bytes"], strict=True):
                if len(content) < 8:
                    continue
                n, d = np.frombuffer(content, "<u4", 2).tolist()
                if len(content) < 8 + 4 * n * d:
                    continue
                x = np.frombuffer(content, "<f4", n * d, 8).reshape(n, d)
                for k in range(0, n, 1000):
                    yield pd.DataFrame({"bundle": bundle, "ord": np.arange(k, min(n, k + 1000)), "embedding": list(x[k : k + 1000])})

    found = files.filter(F.col("path") == path).select("bundle", "bytes").mapInPandas(rows, "bundle string, ord long, embedding array<float>")
    index = _text(files, ids)
    by_place = index.select("bundle", F.explode(F.from_json(F.get_json_object("text", "$.index"), "map<string,string>")).alias("ord", "chunk_id")).select("bundle", F.col("ord").cast("long"), "chunk_id")
    listed = index.select("bundle", F.posexplode(F.from_json("text", "array<string>")).alias("ord", "chunk_id")).select("bundle", F.col("ord").cast("long"), "chunk_id").filter(F.col("chunk_id").isNotNull())
    known = by_place.unionByName(listed)
    return found.join(known, ["bundle", "ord"], "left").select("bundle", "ord", F.coalesce("chunk_id", F.col("ord").cast("string")).alias("chunk_id"), "embedding")


def variant_records(files: DataFrame, path: str = "index/variant_embeddings_index.json") -> DataFrame:
    """(bundle, ord, chunk_id, field_type, lang, text): what each variant vector stands for, by place; none where the index is missing or isn't a JSON list."""
    shape = "array<struct<chunk_id:string,field_type:string,lang:string,text:string>>"
    return _text(files, path).select("bundle", F.posexplode(F.from_json("text", shape)).alias("ord", "r")).select("bundle", F.col("ord").cast("long"), "r.*")


def variants(files: DataFrame, path: str = "index/variant_embeddings.bin") -> DataFrame:
    """(bundle, ord, chunk_id, field_type, lang, text, embedding): variant vectors with their records; a vector without a record has nulls."""
    return vectors(files, path).drop("chunk_id").join(variant_records(files), ["bundle", "ord"], "left").select("bundle", "ord", "chunk_id", "field_type", "lang", "text", "embedding")


def described(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors (bundle, chunk_id, ...) with title and type of their chunks (bundle, id, ...); an unknown chunk has its id for a title and an empty type."""
    meta = chunks.select("bundle", F.col("id").alias("chunk_id"), F.nullif("display_title", F.lit("")).alias("title"), "type")
    return found.join(meta, ["bundle", "chunk_id"], "left").withColumns({"title": F.coalesce("title", "chunk_id"), "type": F.coalesce("type", F.lit(""))})


def quantised(embedding: Column) -> Column:
    """Values from -1 to 1 as whole numbers from -127 to 127, halves upwards."""
    return F.transform(embedding, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x * 127 + 0.5))).cast("tinyint"))


def postings(files: DataFrame, path: str = "index/lexical.json") -> DataFrame:
    """(bundle, lang, term, ord, chunk_id, score); none where the index is missing or isn't JSON."""
    shape = "map<string,struct<index:map<string,array<struct<chunk_id:string,score:double>>>>>"
    langs = _text(files, path).select("bundle", F.explode(F.from_json("text", shape)).alias("lang", "i"))
    terms = langs.select("bundle", "lang", F.explode("i.index").alias("term", "p"))
    return terms.select("bundle", "lang", "term", F.posexplode("p").alias("ord", "x")).select("bundle", "lang", "term", "ord", "x.*")


def edges(files: DataFrame, path: str = "index/gap_graph.json") -> DataFrame:
    """(bundle, src, ord, dst, edge_score, label)."""
    shape = "map<string,array<struct<to:string,score:double,label:string>>>"
    nodes = _text(files, path).select("bundle", F.explode(F.from_json("text", shape)).alias("src", "e"))
    return nodes.select("bundle", "src", F.posexplode("e").alias("ord", "x")).select("bundle", "src", "ord", F.col("x.to").alias("dst"), F.col("x.score").alias("edge_score"), "x.label")


def coverage(files: DataFrame, path: str = "index/coverage_manifest.json") -> DataFrame:
    """(bundle, topic, ord, aspect); a file that wraps its topics in an object of that name is read alike."""
    shape = "map<string,struct<aspects_covered:array<string>>>"
    body = F.coalesce(F.get_json_object("text", "$.topics"), F.col("text"))
    topics = _text(files, path).select("bundle", F.explode(F.from_json(body, shape)).alias("topic", "a"))
    return topics.select("bundle", "topic", F.posexplode("a.aspects_covered").alias("ord", "aspect"))


def documents(files: DataFrame, path: str = "content/sources.json") -> DataFrame:
    """(bundle, ord, name, url, year) of the documents that a bundle was made from; none where the file is missing or isn't JSON."""
    shape = "array<struct<name:string,url:string,year:int>>"
    return _text(files, path).select("bundle", F.posexplode(F.from_json(F.get_json_object("text", "$.sources"), shape)).alias("ord", "s")).select("bundle", "ord", "s.*")


def named_files(files: DataFrame, folder: str) -> DataFrame:
    """(bundle, id, text) of the JSON files in a folder, by file name."""
    pattern = f"^{folder}/([^/]+)\\.json$"
    return files.filter(F.col("path").rlike(pattern)).select("bundle", F.regexp_extract("path", pattern, 1).alias("id"), F.decode("bytes", "UTF-8").alias("text"))


def proxies(files: DataFrame, path: str = "index/query_proxies.json") -> DataFrame:
    """(bundle, proxy_id, pattern, embedding): the last of entries with equal patterns."""
    shape = "array<struct<pattern:string,embedding:array<float>>>"
    listed = _text(files, path).select("bundle", F.posexplode(F.from_json(F.coalesce(F.get_json_object("text", "$.en"), F.get_json_object("text", "$.entries")), shape)).alias("proxy_id", "p"))
    return listed.groupBy("bundle", F.col("p.pattern").alias("pattern")).agg(F.max(F.struct("proxy_id", "p.embedding")).alias("x")).select("bundle", "x.proxy_id", "pattern", "x.embedding")


def search_chunks(found: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Chunks one of whose tokens begins with the query, else those that contain it; by id."""
    low = F.lower(F.lit(query))
    begins = F.exists(F.split(F.lower("content"), "[^a-z0-9]+"), lambda t: F.startswith(t, low))
    return found.filter(begins | F.contains(F.lower("content"), low)).orderBy("id").limit(limit)


def payload_hash(files: DataFrame) -> DataFrame:
    """(bundle, sha256) over the digests of all entries but signatures, by path."""
    own = files.filter(~F.col("path").startswith("signature/")).select("bundle", "path", F.sha2("bytes", 256).alias("d"))
    return own.groupBy("bundle").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "d"))), lambda x: F.concat_ws(":", x["path"], x["d"])), "\n"), 256).alias("sha256"))


def packed(files: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle of (bundle, path, bytes) as one Parquet partition of its entries; read back with spark.read.parquet."""
    files.repartition("bundle").sortWithinPartitions("bundle", "path").write.mode("overwrite").parquet(folder)
    return files.sparkSession.read.parquet(folder)


def zipped(files: list[tuple[str, bytes]]) -> bytes:
    """A bundle of a few entries in memory, for fixtures and exports."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(name, content)
    return out.getvalue()


def vector_bytes(x: np.ndarray) -> bytes:
    return np.array(x.shape, "<u4").tobytes() + np.ascontiguousarray(x, "<f4").tobytes()


def lines(rows: list[dict]) -> bytes:
    return "\n".join(json.dumps(r) for r in rows).encode()

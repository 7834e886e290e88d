"""Vector files (two little-endian counts, then float32 rows) read by ranges of rows, joined to their records and checked.

The file format has no blocks, but its rows are of one size, so any range of them can be read on its own: a file of any
length is many tasks, each of which holds a few thousand rows at a time. Paths may be local (shared by driver and
executors) or of any file system that pyarrow reaches (hdfs, s3, gs).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Bytes of the header, dimensions of the vectors that are searched, and the norms that count as normalised.
HEADER, DIMENSIONS, NORMS = 8, 384, (0.95, 1.05)
#: Rows that one task reads by default, and that are held at once.
RANGE, BATCH = 200_000, 2_000
ROW, FILE = "file string, ord long, embedding array<float>", "file string, n long, d long, bytes long"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local, s3a and s3n are s3."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "file:///", path)))


def _files(path: str) -> list[str]:
    """The .bin files in a folder, or the file itself."""
    where, inside = _opened(path)
    info = where.get_file_info(inside)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in where.get_file_info(fs.FileSelector(inside, recursive=True)) if f.path.endswith(".bin"))
    return [inside]


def _header(where: fs.FileSystem, path: str) -> tuple[int, int, int]:
    """(rows, columns, bytes); a file without a whole header has no rows."""
    size = where.get_file_info(path).size
    with where.open_input_file(path) as f:
        n, d = np.frombuffer(f.read(HEADER), "<u4").tolist() if size >= HEADER else (0, 0)
    return n, d, size


@dataclass
class Range(InputPartition):
    """Rows first to last (exclusive) of a file, or the whole of a few files for their headers."""

    files: list[str]
    first: int = 0
    last: int = 0
    d: int = 0


class VectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.headers = options["path"], options.get("headers", "false") == "true"
        self.range = int(options.get("rangerows", RANGE))

    def partitions(self) -> list[Range]:
        """Ranges of equal length over all files; only headers are read for it. A file shorter than its header says has no rows."""
        where, files = _opened(self.path)[0], _files(self.path)
        if self.headers:
            return [Range(files[k : k + 1000]) for k in range(0, len(files), 1000)] or [Range([])]
        out = []
        for file in files:
            n, d, size = _header(where, file)
            if size >= HEADER + 4 * n * d and d:
                out += [Range([file], k, min(n, k + self.range), d) for k in range(0, n, self.range)]
        return out or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where = _opened(self.path)[0]
        if self.headers:
            rows = [(file, *_header(where, file)) for file in partition.files]
            yield pa.RecordBatch.from_pydict({name: [r[k] for r in rows] for k, name in enumerate(("file", "n", "d", "bytes"))}, pa.schema([("file", pa.string()), *((x, pa.int64()) for x in ("n", "d", "bytes"))]))
            return
        for file in partition.files:
            with where.open_input_file(file) as f:
                f.seek(HEADER + 4 * partition.d * partition.first)
                for at in range(partition.first, partition.last, BATCH):
                    n = min(BATCH, partition.last - at)
                    values = np.frombuffer(f.read(4 * n * partition.d), "<f4")
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, partition.d), pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(at, at + n)), rows], ["file", "ord", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class VectorWriter(DataSourceArrowWriter):
    """Writes the rows (file, embedding) of each task to files of those names; a file's rows must lie in one task, in order.

    Files get their names when all tasks are done; what a failed or repeated task wrote is never seen.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, folder = _opened(self.path)
        where.create_dir(folder, recursive=True)
        names, counts, out, last = [], [], None, None
        for batch in batches:
            for file, row in zip(batch.column("file").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if file != last:
                    self._closed(out, counts)
                    names.append((f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{file}"))
                    # The header needs the number of rows, so the rows are kept beside it until the file is whole.
                    out, last = where.open_output_stream(names[-1][0] + ".rows"), file
                    counts.append([0, len(row)])
                if len(row) != counts[-1][1]:
                    raise ValueError(f"vectors of {file} differ in length")
                out.write(np.asarray(row, "<f4").tobytes())
                counts[-1][0] += 1
        self._closed(out, counts)
        for (hidden, _), (n, d) in zip(names, counts, strict=True):
            with where.open_output_stream(hidden) as whole, where.open_input_stream(hidden + ".rows") as rows:
                whole.write(np.array([n, d], "<u4").tobytes())
                while block := rows.read(1 << 22):
                    whole.write(block)
            where.delete_file(hidden + ".rows")
        return Written(names)

    def _closed(self, out, counts) -> None:
        if out is not None:
            out.close()

    def commit(self, messages: list[Written | None]) -> None:
        where = _opened(self.path)[0]
        for hidden, name in (pair for m in messages if m for pair in m.names):
            where.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        where = _opened(self.path)[0]
        for hidden, _ in (pair for m in messages if m for pair in m.names):
            where.delete_file(hidden)


class VectorFileSource(DataSource):
    """Format `vectorfile`: options path, headers (true: one row per file) and rangerows (rows a task)."""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        return FILE if self.options.get("headers", "false") == "true" else ROW

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Writes vectors (file, ord, embedding) as one vector file per name, rows by ord; each file is written by one task."""
    vectors.sparkSession.dataSource.register(VectorFileSource)
    vectors.repartition("file").sortWithinPartitions("file", "ord").select("file", "embedding").write.format("vectorfile").mode("append").save(path)


def read_vectors(spark: SparkSession, path: str, rows_per_task: int = RANGE) -> DataFrame:
    """(file, ord, embedding) of a vector file or of those in a folder."""
    spark.dataSource.register(VectorFileSource)
    return spark.read.format("vectorfile").option("rangerows", rows_per_task).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, d, bytes) of each vector file."""
    spark.dataSource.register(VectorFileSource)
    return spark.read.format("vectorfile").option("headers", "true").load(path)


def import_vectors(spark: SparkSession, path: str, records: DataFrame, chunks: DataFrame, *, dimensions: int = DIMENSIONS, rows_per_task: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(imported, rejects) of the vector files at path.

    records: (file, ord, chunk_id), the place of each vector's chunk; file is the name without folders. chunks: (chunk_id,
    title, type, text), of any number of vectors. imported: (file, ord, chunk_id, title, type, text, embedding); a chunk
    that is not known has its id for a title and empty texts. rejects: (file, ord, reason). A file is rejected whole
    (ord null) if it is `short` of what its header says, of another `dimension`, or has another `count` than records; a
    row is rejected if its `norm` is not about 1, or its place has no `record`.
    """
    name = F.regexp_extract("file", "[^/]*$", 0)
    own = headers(spark, path).withColumn("file", name)
    counted = own.join(records.groupBy("file").agg(F.count(F.lit(1)).alias("listed")), "file", "left")
    reason = F.when(F.col("bytes") < F.greatest(F.lit(HEADER), HEADER + 4 * F.col("n") * F.col("d")), "short").when(F.col("d") != dimensions, "dimension").when(F.coalesce("listed", F.lit(0)) != F.col("n"), "count")
    judged = counted.select("file", reason.alias("reason"))
    rows = read_vectors(spark, path, rows_per_task).withColumn("file", name).join(judged.filter(F.col("reason").isNull()).select("file"), "file")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    placed = rows.join(records.select("file", F.col("ord").cast("long").alias("ord"), "chunk_id"), ["file", "ord"], "left")
    placed = placed.withColumn("reason", F.when(~norm.between(*NORMS), "norm").when(F.col("chunk_id").isNull(), "record"))
    kept = placed.filter(F.col("reason").isNull()).join(chunks.select("chunk_id", "title", "type", "text"), "chunk_id", "left")
    imported = kept.select("file", "ord", "chunk_id", F.coalesce("title", F.col("chunk_id").cast("string")).alias("title"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("text", F.lit("")).alias("text"), "embedding")
    rejects = judged.filter(F.col("reason").isNotNull()).select("file", F.lit(None).cast("long").alias("ord"), "reason")
    return imported, rejects.unionByName(placed.filter(F.col("reason").isNotNull()).select("file", "ord", "reason"))

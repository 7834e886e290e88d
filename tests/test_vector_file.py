"""Vector files: ranges, files that say more than they hold, checks and rejects."""

import numpy as np
import pytest

from loamgrid.sources import bundle as B
from loamgrid.sources import vector_file as V


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = np.random.default_rng(3), tmp_path_factory.mktemp("vectors")
    x = rng.normal(size=(5000, 8)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[17] *= 2
    (at / "a.bin").write_bytes(B.vector_bytes(x))
    (at / "b.bin").write_bytes(B.vector_bytes(x[:10])[:-1])
    (at / "c.bin").write_bytes(B.vector_bytes(x[:10, :4]))
    (at / "d.bin").write_bytes(B.vector_bytes(x[:10]))
    (at / "e.bin").write_bytes(b"\1\0\0")
    (at / "f.bin").write_bytes(B.vector_bytes(x[:0]))
    return at, x


def test_a_file_is_read_in_ranges(spark, folder):
    at, x = folder
    rows = V.read_vectors(spark, str(at / "a.bin"), rows_per_task=700)
    assert rows.rdd.getNumPartitions() == 8
    got = rows.orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(5000)) and np.array([r.embedding for r in got], "f4").tolist() == x.tolist()
    assert V.read_vectors(spark, f"file://{at}").groupBy("file").count().count() == 3
    assert V.read_vectors(spark, str(at / "f.bin")).count() == 0


def test_import_rejects_files_and_rows(spark, folder):
    at, x = folder
    records = [("a.bin", k if k != 40 else 9999, f"c{k % 7}") for k in range(5000)] + [(f, k, "c1") for f in ("b.bin", "c.bin") for k in range(10)] + [("d.bin", k, "c1") for k in range(9)]
    records = spark.createDataFrame(records, "file string, ord int, chunk_id string")
    chunks = spark.createDataFrame([("c1", "One", "faq", "text")], "chunk_id string, title string, type string, text string")
    imported, rejects = V.import_vectors(spark, str(at), records, chunks, dimensions=8, rows_per_task=999)
    assert {(r.file, r.ord, r.reason) for r in rejects.collect()} == {("a.bin", 17, "norm"), ("a.bin", 40, "record"), ("b.bin", None, "short"), ("c.bin", None, "dimension"), ("d.bin", None, "count"), ("e.bin", None, "short")}
    got = {r.ord: r for r in imported.collect()}
    assert len(got) == 4998 and (got[8].title, got[8].type, got[8].text) == ("One", "faq", "text") and (got[9].title, got[9].type, got[9].text) == ("c2", "", "")


def test_written_files_are_whole(spark, folder, tmp_path):
    _, x = folder
    rows = spark.createDataFrame([(f"v{k % 3}.bin", k, v.tolist()) for k, v in enumerate(x)], "file string, ord long, embedding array<float>").repartition(5)
    V.write_vectors(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v0.bin", "v1.bin", "v2.bin"]
    for k in range(3):
        assert (tmp_path / "out" / f"v{k}.bin").read_bytes() == B.vector_bytes(x[k::3])
    uneven = spark.createDataFrame([("w.bin", 0, [1.0]), ("w.bin", 1, [1.0, 2.0])], "file string, ord long, embedding array<float>")
    with pytest.raises(Exception, match="differ in length"):
        V.write_vectors(uneven, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.bin"))) == 3

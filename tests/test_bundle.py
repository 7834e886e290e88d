import numpy as np
import pytest

from loamgrid.sources import bundle as B


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bundles")
    chunk = {"id": "c1", "type": "faq", "content": {"en": {"answer": "yes"}}, "trigger_phrases": {"en": ["a b"]}, "aspects": ["dosage"]}
    x = np.array([[1, 0, 0], [0, 1, -0.5]], np.float32)
    content = B.zipped(
        [
            ("/manifest.json", b'{"version": "v3.0.1", "languages": ["en"], "chunk_count": 1, "document_source": "d"}'),
            ("content/chunks.jsonl", B.lines([chunk]) + b'\nnot json\n{"type": "faq", "content": {"a": 1}}\n{"id": "c2", "type": "faq", "content": {}}'),
            ("index/embeddings.bin", B.vector_bytes(x)),
            ("index/embeddings_index.json", b'{"index": {"1": "c2", "0": "c1"}}'),
            ("index/lexical.json", b'{"en": {"index": {"fever": [{"chunk_id": "c1", "score": 3.0}, {"chunk_id": "c1", "score": 8.0}]}}}'),
            ("index/gap_graph.json", b'{"c1": [{"to": "c2", "score": 0.5}]}'),
            ("index/coverage_manifest.json", b'{"topics": {"malaria": {"aspects_covered": ["treatment", "dosage"]}}}'),
            ("content/sources.json", b'{"sources": [{"name": "Guide", "year": 2020}]}'),
            ("index/variant_embeddings.bin", B.vector_bytes(x)),
            ("index/variant_embeddings_index.json", b'[{"chunk_id": "c1", "field_type": "trigger_phrase", "lang": "en", "text": "a b"}]'),
            ("i18n/en.json", b'{"hi": "Hello"}'),
            ("index/query_proxies.json", b'{"entries": [{"pattern": "p", "embedding": [1.0]}, {"pattern": "p", "embedding": [2.0]}]}'),
        ]
    )
    (folder / "a.zip").write_bytes(content)
    (folder / "b.zip").write_bytes(B.zipped([("manifest.json", b'{"version": "4.0"}'), ("index/embeddings.bin", B.vector_bytes(x)[:-1])]))
    return B.entries(spark, f"{folder}/*.zip").cache()


def test_tables(files):
    assert [(r.id, r.aspects) for r in B.chunks(files).collect()] == [("c1", ["dosage"])]
    assert sorted((r.schema, r.document_sources) for r in B.manifests(files).collect()) == [("3.0", ["d"]), ("4.0", None)]
    assert [(r.chunk_id, r.embedding) for r in B.vectors(files).orderBy("ord").collect()] == [("c1", [1, 0, 0]), ("c2", [0, 1, -0.5])]
    assert [(r.chunk_id, r.title, r.type) for r in B.described(B.vectors(files), B.chunks(files)).orderBy("ord").collect()] == [("c1", "c1", "faq"), ("c2", "c2", "")]
    assert [(r.ord, r.chunk_id, r.field_type, r.text, r.embedding) for r in B.variants(files).orderBy("ord").collect()] == [(0, "c1", "trigger_phrase", "a b", [1, 0, 0]), (1, None, None, None, [0, 1, -0.5])]
    assert [(r.name, r.url, r.year) for r in B.documents(files).collect()] == [("Guide", None, 2020)]
    assert [r.score for r in B.postings(files).orderBy("ord").collect()] == [3.0, 8.0]
    assert [(r.src, r.dst, r.edge_score) for r in B.edges(files).collect()] == [("c1", "c2", 0.5)]
    assert [(r.topic, r.aspect) for r in B.coverage(files).orderBy("ord").collect()] == [("malaria", "treatment"), ("malaria", "dosage")]
    assert [(r.id, r.text) for r in B.named_files(files, "i18n").collect()] == [("en", '{"hi": "Hello"}')]
    assert [(r.pattern, r.embedding) for r in B.proxies(files).collect()] == [("p", [2.0])]
    assert [r.id for r in B.search_chunks(B.chunks(files), "ye").collect()] == ["c1"]


def test_version_is_checked(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="unsupported bundle version"):
        spark.range(1).select(B.checked_version(F.lit("2.3"))).collect()


def test_round_trip_and_hash(files, tmp_path):
    again = B.packed(files, str(tmp_path / "packed"))
    assert again.count() == files.count()
    assert {(r.bundle, r.sha256) for r in B.payload_hash(again).collect()} == {(r.bundle, r.sha256) for r in B.payload_hash(files).collect()}


def test_quantised_rounds_halves_up(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([([0.5 / 127, -0.5 / 127, 2.0, -1.0],)], "v array<double>").select(B.quantised(F.col("v"))).first()[0]
    assert got == [1, 0, 127, -127]

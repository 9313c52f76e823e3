import pytest

from millrace.llm import pii, queries
from millrace.llm.components import connected_components

from .data import KIND, documents

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[300] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages(spark, tmp_path):
    rows = documents()
    rows[20] = (20, rows[20][1] + "\nWrite to some.body@mail.example or 10.1.2.3 please.", "en", "src0", 1)
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[1] is not None and len(r[1]) > 60), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        seen[name] = docs
    kinds = [f.simpleString() for f in spark.createDataFrame([], KIND).schema]
    for name in ("quality classifier", "SimHash near-dedup", "PII", "mixing"):
        assert [f.simpleString() for f in seen[name].schema] == kinds
    texts = [r["text"] for r in seen["SimHash near-dedup"].collect()]
    assert len(texts) == len(set(texts))
    assert not any(pii.find_spans(r["text"]) for r in seen["PII"].collect())
    mixed = {r["doc_id"]: r["text"] for r in seen["mixing"].collect()}
    pieces = seen["best-fit packing"].collect()
    assert {r["doc_id"] for r in pieces} == set(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_ten_queries_are_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}

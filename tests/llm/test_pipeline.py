"""The pipeline over odd and planted rows, stage by stage."""

from __future__ import annotations

import pytest
from cases import odd_documents, words

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    bench = [words(30, 700 + i) for i in range(5)]
    copy = words(80, 1, pool=150)
    texts = [words(60, 100 + i, pool=150) for i in range(100)] + [words(60, 300 + i, pool=150) + " vileword" for i in range(40)]
    planted = [copy, copy + " end", f"{words(40, 2, pool=150)} {bench[3]} {words(40, 3, pool=150)}", f"{words(40, 4, pool=150)} mail a@b.co now"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + planted)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages_keep_and_drop(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontamination", "pii", "packing"]
    kept = {}
    for name, stage in list(stages.items())[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r["doc_id"] for r in docs.collect()}
    clean = set(range(100))
    assert kept["toxicity"] == clean | {140, 141, 142, 143}
    assert kept["jaccard_join"] == clean | {140, 142, 143}
    assert kept["decontamination"] == kept["pii"] == clean | {140, 143}
    (row,) = docs.where("doc_id = 143").collect()
    assert "<EMAIL>" in row["text"] and "a@b.co" not in row["text"] and row["n_chars"] == len(row["text"])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == kept["pii"]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in stages["packing"](spark, docs, folder).collect()}


def test_odd_documents_go_through(spark, folder):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
    assert none.count() == 0

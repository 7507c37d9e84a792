"""The pipeline stage by stage against plain versions of each decision, and its queries' schemas."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import entries, secrets

from . import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append((name, before, docs))
    by = {name: (before, {r.doc_id: r for r in after.collect()}, after.columns) for name, before, after in seen}
    assert all(by[name][2] == names for name, _ in corpus_pipeline.STAGES[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after, _ = by["quality"]
    judged = [i for i in before if i in labels]
    assert sum((i in after) == bool(labels[i]) for i in judged) / len(judged) > 0.95
    before, after, _ = by["near_duplicates"]
    ids = sorted(before)
    roots, _ = brute.near_copies([before[i].text for i in ids])
    assert {ids[k] for k in roots} <= set(after) != set(ids)
    assert len(ids) - len(after) >= 0.95 * (len(ids) - len(set(roots)))
    before, after, _ = by["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(before)
    verdict = brute.contamination([before[i].text for i in ids], items)
    assert sorted(after) == [i for i, x in zip(ids, verdict, strict=True) if not x[-1]]
    before, after, _ = by["secrets"]
    assert set(before) == set(after)
    assert all(not brute.spans(r.text) and r.n_chars == len(r.text) for r in after.values())
    assert set(by["packing"][1]) == set(after)


def test_stages_are_the_five_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entries.queries() if not n.startswith(("pipeline", "op12", "op13"))))
def test_queries_return_a_row_for_each_document(spark, name):
    df = entries.queries()[name](spark, SF)
    source = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1 if name.startswith("op4") else spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() == source
    key = "conv_id" if name.startswith("op4") else "doc_id"
    assert df.where(F.col(key).isNull()).count() == 0


def test_empty_tables_run_through(spark, tmp_path):
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in entries.queries().items():
        assert query(spark, str(tmp_path)).count() == (1 if name.startswith("op4") else 0), name


def test_texts_without_secrets_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, None), (3, "password=hunter22 here"), (3, "password=hunter22 here"), (4, "")], "doc_id long, text string")
    made = secrets.redact(docs)
    assert sorted((r.doc_id, r.text) for r in made.collect()) == [(1, "plain words"), (2, None), (3, "[REDACTED] here"), (3, "[REDACTED] here"), (4, "")]
    joined = made._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Union") == 1 and joined.index("Union") < joined.index("Join")

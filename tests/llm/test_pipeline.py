from __future__ import annotations

import corpus_pipeline
from attestra.llm.common import table

from .helpers import awkward, docs

STAGES = ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == STAGES and corpus_pipeline.ORACLE_SQL is None
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "sharding":
            assert docs.columns == columns
        kept[name] = [r["doc_id"] for r in docs.collect()]
    start = {r["doc_id"] for r in table(spark, sf, "documents").collect()}
    assert set(kept["sharding"]) <= set(kept["decontamination"]) <= set(kept["near_duplicates"]) <= set(kept["quality"]) <= start
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])
    assert 0.6 * len(start) <= len(kept["near_duplicates"]) < len(start)
    assert docs.columns == [*columns, "shard", "slot"]


def test_run_agrees_with_the_stages(spark, sf):
    a = sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf).collect())
    b = sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert a == b and len(a) > 100


def test_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []


def test_extra_columns_clash_with_no_helper(spark, sf):
    extra = ["_o", "_t", "o", "t", "y", "_id", "_n", "n", "p", "host", "score", "copies", "bucket", "shard", "in_0"]
    rows = docs(spark, awkward()).selectExpr("*", *[f"doc_id AS `{name}`" for name in extra])
    whole = {tuple(r) for r in rows.collect()}
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, sf)
        assert got.columns == rows.columns and {tuple(r) for r in got.collect()} <= whole, name
        if name == "near_duplicates":
            kept = got
    found = [r["doc_id"] for r in kept.collect()]
    # 20 to 23 are copies and near copies; texts below five words link as whole sequences.
    assert 20 in found and not {21, 22, 23, 44} & set(found) and {30, 31, 40, 41, 42, 43} <= set(found)
    out = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert out.columns == [*rows.columns, "_shard", "slot"] and {tuple(r)[:-2] for r in out.collect()} == whole


def test_driver_returns_memory_outside_its_heap(spark):
    import os

    from attestra.llm import common

    assert common.trim_driver(spark) or os.uname().sysname != "Linux"

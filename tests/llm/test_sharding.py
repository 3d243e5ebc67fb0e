from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from attestra.llm import sharding

from .helpers import awkward, docs


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 2000, 300])
def test_rows_law(spark, bucket_bytes):
    rows = awkward()
    out = sharding.shard(docs(spark, rows), 8, bucket_bytes=bucket_bytes).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((i, t) for i, t, _ in rows)
    per = Counter(r["shard"] for r in out)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))


def test_reruns_agree_whatever_the_partitions(spark):
    d = docs(spark, [(i, f"text {i}", "s") for i in range(500)])
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(d, bucket_bytes=1500).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(d.repartition(9), bucket_bytes=1500).collect()}
    assert a == b
    assert sorted(a, key=a.get) != sorted(a)


def test_one_key_holds_a_third(spark):
    rows = [(7 if i % 3 == 0 else i, f"text {i}", "s") for i in range(6000)]
    out = sharding.external_shuffle(docs(spark, rows), bucket_bytes=6000)
    per = out.groupBy("bucket").count().collect()
    assert sum(r["count"] for r in per) == 6000 and max(r["count"] for r in per) < 1500


def test_empty_and_clashing_names(spark):
    assert sharding.shard(docs(spark, [])).collect() == []
    d = docs(spark, [(1, "a", "s"), (2, "b", "s")]).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "bucket")
    got = sharding.shard(d, 2)
    assert got.columns == ["doc_id", "text", "shard", "source", "bucket", "_shard", "slot"] and got.count() == 2


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, [s]).tolist()) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert sharding.fisher_yates(0, [1]).tolist() == [] and sharding.fisher_yates(1, [1]).tolist() == [0]
    assert sorted(sharding.fisher_yates(100, [4]).tolist()) == list(range(100)) and np.array_equal(sharding.fisher_yates(9, [4]), sharding.fisher_yates(9, [4]))


def test_write_shards(spark, tmp_path):
    out = sharding.shard(docs(spark, [(i, "t", "s") for i in range(16)]), 4)
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 4

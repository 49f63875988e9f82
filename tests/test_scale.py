"""Plans that must not gather a group, or more than they need, in one task."""

import os

import pytest
from pyspark.sql import functions as F

from tidelog import queries as q
from tidelog.operators import apply as A
from tidelog.operators import log as L

SF = "/root/testdata/sf0.001"

CHANGES = "device_id string, segment_seq long, change_number long, op string, before array<string>, after array<string>"


def test_bag_fold_holds_no_group(spark):
    """A row that moves 300 times, back and forth at the end, and copies taken away on the way; no Python holds a device's table."""
    rows = [("d", 0, 0, "INSERT", None, ["0"]), ("d", 0, 1, "INSERT", None, ["7"]), ("d", 0, 2, "INSERT", None, ["stays"])]
    rows += [("d", 1, k, "UPDATE", [str(k)], [str(k + 1)]) for k in range(200)]
    rows += [("d", 2, k, "UPDATE", [str(200 + k % 2)], [str(201 - k % 2)]) for k in range(100)]
    rows += [("d", 3, 0, "INSERT", None, ["9"]), ("d", 3, 1, "UPDATE", ["9"], ["10"]), ("d", 3, 2, "DELETE", ["10"], None)]
    rows += [(None, 0, 0, "INSERT", None, ["9"]), (None, 0, 1, "INSERT", None, ["x", None]), (None, 0, 2, "DELETE", ["x", None], None)]
    out = A.bag_apply(spark.createDataFrame(rows, CHANGES).repartition(3), ["device_id"])
    assert {(r.device_id, tuple(r.image)): r.copies for r in out.collect()} == {("d", ("200",)): 2, ("d", ("stays",)): 1, (None, ("9",)): 1, (None, ("x", None)): 1}
    inserts = spark.range(100).select(F.lit("d").alias("device_id"), F.lit(0).alias("segment_seq"), F.col("id").alias("change_number"), F.lit("INSERT").alias("op"), F.lit(None).cast("array<string>").alias("before"), F.array(F.col("id").cast("string")).alias("after"))
    out = A.bag_apply(inserts, ["device_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 100 and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sidecars_are_dealt_by_size(spark, monkeypatch):
    """A join of sidecars has a task for so many bytes of files, with the same rows; little input stays as it is, and so does what has no known size."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = q.sidecar_expand(spark, SF)
    assert "RepartitionByExpression" not in plan(small)
    orders, lines = q.read(spark, SF, "orders"), q.read(spark, SF, "lineitem")
    files = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    monkeypatch.setattr(L, "TASK_BYTES", files // 16)
    dealt = L.dealt((orders, ["o_orderkey"]), (lines, ["l_orderkey"]))
    assert 8 <= dealt[0].rdd.getNumPartitions() <= 40 and dealt[0].rdd.getNumPartitions() == dealt[1].rdd.getNumPartitions()
    monkeypatch.setattr(L, "TASK_BYTES", files // 32)
    more = L.dealt((orders, ["o_orderkey"]), (lines, ["l_orderkey"]))
    assert more[0].rdd.getNumPartitions() > 1.8 * dealt[0].rdd.getNumPartitions()
    large = q.sidecar_expand(spark, SF)
    assert "RepartitionByExpression" in plan(large) and large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()
    unknown = spark.createDataFrame([(1,)], "o_orderkey long")
    assert "RepartitionByExpression" not in plan(L.dealt((unknown, ["o_orderkey"]), (lines, ["l_orderkey"]))[0])

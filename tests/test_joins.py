"""Joins that return far more rows than they read."""

import pytest
from pyspark.sql import functions as F

from brindle import Engine
from brindle.operators import compile as compiler
from brindle.plans.ir import ConditionGroup


@pytest.fixture
def sides(spark, tmp_path):
    """Two tables of one file each; all rows but a few share a key, and some have none."""
    e = Engine(spark)
    for name, rows in (("many", 600), ("few", 60)):
        key = F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 20 == 3, F.col("id")).otherwise(1)
        spark.range(rows).select("id", key.alias("k"), (F.col("id") * 37 % 101).alias("v")).coalesce(1).write.parquet(str(tmp_path / name))
        e.register(name, spark.read.parquet(str(tmp_path / name)))
    return e


def joined(e, kind, left, right, equal=True):
    on = ConditionGroup().where_column("a.k", "=", "b.k") if equal else ConditionGroup()
    on = on.where_column("a.v", "<", "b.v")
    t = e.table(f"{left} a")
    return {"inner": t.join_on, "left": t.left_join_on, "right": t.right_join_on}[kind](f"{right} b", on).select("a.id", "b.v")


@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("left, right", [("many", "few"), ("few", "many")])
@pytest.mark.parametrize("kind", ["inner", "left", "right"])
def test_ranges_are_dealt_out(sides, monkeypatch, kind, left, right, equal):
    """A join on ranges runs in many tasks, though its larger side is one file with one key, and gives the same rows."""
    want = sorted(map(tuple, joined(sides, kind, left, right, equal).df().collect()), key=repr)
    monkeypatch.setattr(compiler, "PAIR_BYTES", 1)
    df = joined(sides, kind, left, right, equal).df()
    busy = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(busy) >= 8 and max(r["count"] for r in busy) <= sum(r["count"] for r in busy) / 3
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_small_or_equal_joins_are_left_alone(sides, monkeypatch):
    plan = lambda q: q.df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(joined(sides, "inner", "many", "few"))
    monkeypatch.setattr(compiler, "PAIR_BYTES", 1)
    assert "Repartition" in plan(joined(sides, "inner", "many", "few"))
    assert "Repartition" not in plan(sides.table("many a").join("few b", "a.k", "=", "b.k").select("a.id", "b.v"))

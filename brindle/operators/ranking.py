"""Ranking of a whole table without a partition, in many tasks.

A window without a partition puts all rows into one task.  For ROW_NUMBER the rows, which a last sort key
makes different, are dealt out by range and each range's total (one row for each range) is turned into an
offset, so that a row's number is its range's offset plus its place there: a key that many
rows share is dealt over many ranges.  For RANK and DENSE_RANK the distinct
sort keys are counted and dealt out in the same way; rows then get the rank of their key by a join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Up to this estimated size a table is ranked by one sorted window.
ONE_TASK_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate; for what it cannot tell it is large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in sorted ranges, told by ``__range``; written once, as what is in a range must not change between two uses."""
    path = f"{shared_folder(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def rank_all(df: DataFrame, func: str, keys: list[tuple[Column, bool]], name: str, tie: Column) -> DataFrame:
    """``df`` with ``name``: ROW_NUMBER (equal keys by ``tie``), RANK or DENSE_RANK by ``keys`` (column, descending)."""
    cols = [f"__k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[c.alias(k) for (c, _), k in zip(keys, cols)])
    order = [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_first() for (_, down), k in zip(keys, cols)]
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(f"`{c}`") for c in df.columns]
    if func == "ROW_NUMBER":
        order = [*order, F.col("__tie")]
        held = _dealt(keyed.withColumn("__tie", tie), order)
        totals = held.groupBy("__range").agg(F.count("*").alias("__rows"))
        offsets = totals.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
        number = F.col("__base") + F.row_number().over(Window.partitionBy("__range").orderBy(*order))
        return held.join(F.broadcast(offsets), "__range").select(*own, number.cast("long").alias(name))
    counted = keyed.groupBy(*cols).agg(F.count("*").alias("__n"))
    held = _dealt(counted, order)
    totals = held.groupBy("__range").agg(F.sum("__n").alias("__rows"), F.count("*").alias("__keys"))
    offsets = totals.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__row_base"), F.coalesce(F.sum("__keys").over(before), F.lit(0)).alias("__key_base"))
    within = Window.partitionBy("__range").orderBy(*order)
    smaller = F.coalesce(F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.select(*cols, "__range", smaller.alias("__rows_before"), F.row_number().over(within).alias("__key"))
    value = F.col("__row_base") + F.col("__rows_before") + 1 if func == "RANK" else F.col("__key_base") + F.col("__key")
    ranks = placed.join(F.broadcast(offsets), "__range").select(*[F.col(k).alias(f"{k}r") for k in cols], value.cast("long").alias(name))
    return keyed.join(ranks, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in cols]).select(*own, F.col(f"`{name}`"))

"""Queries on unbounded tables.

The builder compiles to DataFrame operations, so a query whose steps Structured
Streaming supports runs on a streaming DataFrame as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import QueryError
from ..plans import ir
from ..plans.builder import Query


def stateless(query: Query) -> bool:
    """True if the query only filters and projects, with joins, so that it needs no state but a join's."""
    p = query.plan
    return not (p.group_by or p.having or p.order_by or p.distinct or p.offset or p.limit is not None or p.unions or ir.subqueries(p) or any(hasattr(i, "func") for i in p.items))


def start(query: Query, name: str, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Runs a query on a streaming table; the view ``name`` shows its rows.

    Executors write each batch to files beside those of its progress in ``checkpoint``, which they must share with the driver:
    no rows come to the driver.  A batch that is run again replaces its own files, so a query that starts again goes on where it was.
    """
    df: DataFrame = query.df()
    if not df.isStreaming:
        raise QueryError("no table of the query is a stream")
    spark, schema, rows = df.sparkSession, df.schema, f"{checkpoint.rstrip('/')}/rows"

    def show(folder: str) -> None:
        spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder).createOrReplaceTempView(name)

    def write(batch: DataFrame, number: int) -> None:
        # A complete result takes the place of the one before the last, so that the last can still be read meanwhile.
        folder = f"{rows}/{number % 2 if output_mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(folder)
        show(folder if output_mode == "complete" else rows)

    if output_mode == "complete":
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
    else:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(rows)
        show(rows)
    return df.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode(output_mode).foreachBatch(write).start()


__all__ = ["start", "stateless"]

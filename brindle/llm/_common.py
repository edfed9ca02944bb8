"""Shared plumbing of the operators: shared storage, table access, components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A-Z and its lower case: contracts fold these 26 letters only, not all of Unicode.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Java regex of the white space that separates words (space and tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"


_written: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only its running tasks, as
    the files are on shared storage.  Files go when they are discarded or the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if not _written:
        atexit.register(discard_all)
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found._stored_at = path
    return found


def stored_alone(make, name: str) -> DataFrame:
    """``stored(make(), name)`` without the files that ``make`` has stored on the way."""
    before = set(_written)
    found = stored(make(), name)
    for path in set(_written) - before - {found._stored_at}:
        _remove(path)
    return found


def discard(df: DataFrame) -> None:
    """Remove the files of what ``stored`` gave, once nothing is made of them any more."""
    _remove(df._stored_at)


def _remove(path: str) -> None:
    spark = _written.pop(path)
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; nothing is lost
        return


def discard_all() -> None:
    for path in list(_written):
        _remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def let(value, body):
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def crc_mod(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` can reach.

    Alternates "large star" and "small star" steps until the edges are stars around smallest nodes; the
    number of rounds grows with the logarithm of a component's size and no
    round holds more than about the number of edges.  A star's centre is a
    minimum over its neighbours, so a hub is pre-aggregated on the map side and
    never gathered.  Edges are stored in the shared folder after each round.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("v != u").distinct()
    e = stored(e, "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Stored, so that both sides of the join are plain shuffles: the rows of a hub can be split among tasks.
        least = stored(both.groupBy("v").agg(F.min("u").alias("m")), "least")
        large = (
            both.filter("u > v").join(least.select("v", F.least("m", "v").alias("m")), "v")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .filter("v != u").distinct()
        )
        large = stored(large, "edges")
        low = stored(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p"))
            .select("p.v", "p.u").filter("v != u").distinct()
        )
        discard(e)
        e = stored(small, "edges")
        for done in (least, large, low):
            discard(done)
    centres = e.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(centres)


def _are_stars(e: DataFrame) -> bool:
    """Whether each node has one smaller neighbour and that one has none: then it is the least of its component."""
    if not e.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    return e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()

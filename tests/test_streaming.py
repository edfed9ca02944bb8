import pytest

from brindle import Agg, Engine, QueryError, streaming


def test_builder_on_a_stream(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / "in"))
    e = Engine(spark)
    e.register("s", spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in")))
    e.register("names", spark.createDataFrame([(0, "zero"), (1, "one")], "k long, name string"))
    q = e.table("s").join("names", "s.k", "=", "names.k").select("s.id", "names.name").where("s.id", ">", 3)
    assert streaming.stateless(q) and not streaming.stateless(e.table("s").select(Agg.count().as_("n")).group_by("k"))
    run = streaming.start(q, "joined", str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("joined").collect())) == [(4, "one"), (6, "zero"), (7, "one"), (9, "zero")]
    with pytest.raises(QueryError):
        streaming.start(e.table("names"), "x", str(tmp_path / "c2"))


def test_rows_of_a_stream_are_files(spark, tmp_path):
    """Rows that executors wrote, not rows that the driver holds; a query goes on from its progress."""
    e = Engine(spark)
    feed = lambda a, b: spark.range(a, b).write.mode("append").parquet(str(tmp_path / "in"))
    feed(0, 10)
    e.register("s", spark.readStream.schema("id long").parquet(str(tmp_path / "in")))
    q = e.table("s").select("id").where("id", ">", 3)
    for until in (10, 14):
        run = streaming.start(q, "kept", str(tmp_path / "ck"))
        run.processAllAvailable()
        feed(until, until + 2)
        run.processAllAvailable()
        run.stop()
        feed(until + 2, until + 4)
    assert spark.table("kept").inputFiles()
    assert sorted(r.id for r in spark.table("kept").collect()) == list(range(4, 16))


def test_complete_result_of_a_stream(spark, tmp_path):
    e = Engine(spark)
    spark.range(10).write.parquet(str(tmp_path / "in"))
    e.register("s", spark.readStream.schema("id long").parquet(str(tmp_path / "in")))
    run = streaming.start(e.table("s").select(Agg.count().as_("n")), "counted", str(tmp_path / "ck"), "complete")
    for n in (10, 15, 20):
        run.processAllAvailable()
        assert [r.n for r in spark.table("counted").collect()] == [n]
        spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    run.stop()

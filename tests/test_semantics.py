"""Rules of comparison, NULL, names and order on hand-made rows."""

import pytest

from brindle import Agg, CaseWhen, ConditionGroup, Engine, Func, Like, QueryError
from pyspark.sql import types as T


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.register("u", spark.createDataFrame([(1, "alice", 1, "5"), (2, "bob", 1, "05"), (3, "carol", None, "x"), (4, "dave", 2, "6.0")], "id long, name string, dept long, code string"))
    e.register("d", spark.createDataFrame([(1, "eng"), (2, "sales"), (3, "hr")], "id long, title string"))
    return e


def ids(q):
    return sorted(r["id"] for r in q.get())


def test_text_and_numbers(engine):
    assert ids(engine.table("u").where("code", 5)) == [1, 2]
    assert ids(engine.table("u").where("code", "5")) == [1, 2]
    assert ids(engine.table("u").where("code", ">", 5.5)) == [3, 4]  # 'x' is compared as text
    assert ids(engine.table("u").where("id", "2")) == [2]
    assert ids(engine.table("u").where("dept", True)) == [1, 2]
    assert ids(engine.table("u").join("d as k", "u.code", "=", "k.id").select("u.id")) == []


def test_null_rules(engine):
    assert ids(engine.table("u").where("dept", "!=", 1)) == [4]
    assert ids(engine.table("u").where("dept", None)) == []
    assert ids(engine.table("u").where_not_in("dept", [None])) == [1, 2, 4]
    assert ids(engine.table("u").where_not_in("dept", [1, None])) == [4]
    assert ids(engine.table("u").where_in("dept", [])) == []
    assert ids(engine.table("d").where_not_in("id", engine.table("u").select("dept"))) == [3]
    assert engine.table("u").select(Agg.count("dept").as_("n"), Agg.sum("dept").as_("s")).where("id", 3).first() == {"n": 0, "s": None}


def test_left_to_right(engine):
    q = engine.table("u").where("name", "alice").or_where("name", "bob").where("id", 2)
    assert ids(q) == [2]
    g = ConditionGroup().where("name", "bob").where("id", 2)
    assert ids(engine.table("u").where("name", "alice").or_where_group(g)) == [1, 2]


def test_like(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "50%"), (2, "50x"), (3, "a\\b"), (4, "a\nb")], "id int, s string"))
    assert ids(e.table("t").where_like("s", Like.escape("50%"))) == [1]
    assert ids(e.table("t").where("s", "like", "50_")) == [1, 2]
    assert ids(e.table("t").where_like("s", "a\\b")) == [3]
    assert ids(e.table("t").where_like("s", "a%b")) == [3, 4]


def test_order_of_output_columns(engine):
    q = engine.table("u").select(Agg.count().as_("n"), "name", Func.upper(Func.col("name")).as_("x")).group_by("dept")
    assert q.df().columns == ["dept", "name", "x", "n"]
    assert {r["dept"]: r["name"] for r in q.get()} == {1: "alice", None: "carol", 2: "dave"}


def test_names_must_be_known_and_unique(engine):
    for bad in (
        lambda: engine.table("u").select("nope").df(), lambda: engine.table("u").where("x.id", 1).df(), lambda: engine.table("u").join("d", "u.dept", "=", "d.id").select("id").df(),
        lambda: engine.table("u").join("d", "u.dept", "=", "d.id").df(), lambda: engine.table("u").join("u", "u.id", "=", "u.id").df(),
        lambda: engine.table("u").having("id", 1).df(), lambda: engine.table("u").select(Func.rank()).df(), lambda: engine.table("u u u"), lambda: engine.table("u").limit(-1),
        lambda: engine.table("u").union(engine.table("d")).df(), lambda: engine.table("u").where_in("id", engine.table("d")).df(),
    ):
        with pytest.raises(QueryError):
            bad()


def test_builder_is_immutable_and_takes_camel_case(engine):
    q = engine.table("u")
    q.where("id", 1)
    assert len(q.get()) == 4
    assert ids(q.whereNotNull("dept").orderByDesc("id").limit(2)) == [2, 4]


def test_windows_cover_whole_partitions(engine):
    q = engine.table("u").select("id", Agg.sum("id").over().partition_by("dept").order_by("id").as_("s"), Func.row_number().partition_by("dept").order_by_desc("id").as_("rn"))
    assert {r["id"]: (r["s"], r["rn"]) for r in q.get()} == {1: (3, 2), 2: (3, 1), 3: (3, 1), 4: (4, 1)}


def test_first_chunk_cursor_and_result(engine):
    q = engine.table("u").select("id").order_by("id")
    seen = []
    assert q.chunk(3, lambda rows, n: seen.append((n, len(rows)))) == 4 and seen == [(1, 3), (2, 1)]
    assert q.chunk(2, lambda rows, n: False) == 2
    assert [r["id"] for r in q.cursor()] == [1, 2, 3, 4]
    r = q.get()
    assert (r.first(), r.count(), r.pluck("id"), r.is_empty()) == ({"id": 1}, 4, [1, 2, 3, 4], False)
    assert r.to_json().startswith('[{"id": 1}')
    assert engine.table("u").where("id", 9).first() is None
    assert (engine.table("u").count(), engine.table("u").max("name"), engine.table("u").where("id", 9).sum("id")) == (4, "dave", None)


def test_functions_and_case(engine):
    F = Func
    q = engine.table("u").where("id", 1).select(
        F.concat(F.upper(F.col("name")), "-", 1, True).as_("a"), F.round(-2.5).as_("b"), F.floor(F.col("id")).as_("c"), F.substr(F.col("name"), 2).as_("d"),
        F.year("2024-03-05 10:20:30").as_("e"), F.nullif(F.col("id"), 1).as_("f"), CaseWhen.make().when("dept", 1).then("x").else_("y").as_("g"), F.trim("\t a\0\x0b").as_("h"),
    )
    assert q.first() == {"a": "ALICE-11", "b": -3.0, "c": 1.0, "d": "lice", "e": 2024, "f": None, "g": "x", "h": "a"}
    with pytest.raises(QueryError):
        engine.table("u").select(F.substr("abc", 0)).df()
    with pytest.raises(Exception, match="DAY takes a date"):
        engine.table("u").select(F.day("2024-02-30").as_("d")).get().rows()


def test_unions_remove_all_duplicates(spark):
    e = Engine(spark)
    for n, rows in (("a", [("x",), ("x",), ("y",)]), ("b", [("y",), ("w",)])):
        e.register(n, spark.createDataFrame(rows, T.StructType([T.StructField("name", T.StringType())])))
    names = lambda q: sorted(q.get().pluck("name"))
    assert names(e.table("a").union(e.table("b"))) == ["w", "x", "y"]
    assert names(e.table("a").union_all(e.table("b"))) == ["w", "x", "x", "y", "y"]
    assert [r["name"] for r in e.table("a").union(e.table("b")).order_by_desc("name").offset(1).limit(1).get()] == ["x"]


def test_explain(engine):
    q = engine.table("u").join("d", "u.dept", "=", "d.id").select("u.id", Func.rank().order_by("u.id").as_("r")).where_in("u.id", [1]).distinct().order_by("id").limit(3)
    assert [s["step"] for s in q.explain()] == ["SCAN", "JOIN", "WINDOW", "DISTINCT", "SORT", "LIMIT"]
    assert q.explain()[1]["type"] == "HASH"


def test_filters_reach_the_scan(spark):
    e = Engine(spark)
    e.register("part", spark.read.parquet("/root/testdata/sf0.001/part.parquet"))
    plan = e.table("part").select("p_partkey").where("p_size", ">", 20).df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,20)" in plan and "p_name" not in plan


@pytest.mark.parametrize("func", ["row_number", "rank", "dense_rank"])
def test_ranking_in_many_tasks_is_ranking_in_one(spark, monkeypatch, func):
    from brindle.operators import compile as compiler

    e = Engine(spark)
    e.register("t", spark.range(2000).selectExpr("id", "case when id % 50 = 0 then null else id * 37 % 301 end as v", "id % 2 as w"))
    q = e.table("t").select("id", getattr(Func, func)().order_by_desc("v").order_by("w").as_("r"))
    want = sorted((r["r"], r["id"]) for r in q.get())
    monkeypatch.setattr(compiler, "ONE_TASK_BYTES", -1)
    df = q.df()
    got = sorted((r["r"], r["id"]) for r in df.collect())
    assert got == want
    if func == "row_number":  # equal keys are numbered in the order of the source
        assert [r for r, _ in got] == list(range(1, 2001))
    ranks = {i: (v if v is not None else -1, w) for i, v, w in spark.range(2000).selectExpr("id", "case when id % 50 = 0 then null else id * 37 % 301 end as v", "id % 2 as w").collect()}
    assert all((-ranks[a[1]][0], ranks[a[1]][1]) <= (-ranks[b[1]][0], ranks[b[1]][1]) for a, b in zip(got, got[1:]))


def test_plans_of_subqueries_and_joins(spark):
    e = Engine(spark)
    for t in ("customer", "orders", "lineitem"):
        e.register(t, spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet"))
    plan = lambda q: q.df()._jdf.queryExecution().executedPlan().toString()
    cheap = e.table("customer").select("c_custkey").where("c_acctbal", "<", 0)
    for q, kind in (
        (e.table("orders").select("o_orderkey").where_in("o_custkey", cheap), "LeftSemi"), (e.table("orders").select("o_orderkey").where_not_in("o_custkey", cheap), "LeftAnti"),
        (e.table("orders").select("o_orderkey").where("o_orderstatus", "F").or_where_exists(e.table("customer c").where_column("c.c_custkey", "=", "orders.o_custkey").where("c.c_acctbal", "<", 0)), "ExistenceJoin"),
        (e.table("orders o").join_on("customer c", ConditionGroup().where_column("o.o_custkey", "=", "c.c_custkey").where_column("o.o_totalprice", ">", "c.c_acctbal")).select("o.o_orderkey"), "Inner"),
    ):
        text = plan(q)
        assert kind in text and "NestedLoop" not in text and "Cartesian" not in text
    assert "TakeOrderedAndProject" in plan(e.table("orders").select("o_orderkey").order_by("o_totalprice").limit(3))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan(e.table("orders").select(Agg.sum("o_totalprice").as_("s")).group_by("o_custkey"))


def test_nullif_is_about_numbers(engine):
    F = Func
    q = engine.table("u").select("id", F.nullif(F.col("code"), 5).as_("a"), F.nullif(F.col("code"), "x").as_("b"), F.nullif(F.col("name"), 5).as_("c"), F.nullif(F.concat(F.col("code")), F.col("id")).as_("d"), F.nullif(None, 1).as_("e")).order_by("id")
    rows = q.get().rows()
    assert [r["a"] for r in rows] == [None, None, "x", "6.0"] and [r["b"] for r in rows] == ["5", "05", None, "6.0"]
    assert [r["c"] for r in rows] == ["alice", "bob", "carol", "dave"] and [r["d"] for r in rows] == ["5", "05", "x", "6.0"] and {r["e"] for r in rows} == {None}
    one = engine.table("u").where("id", 2).select(F.nullif("05", F.round(5)).as_("a"), F.nullif(F.col("id"), "2.0").as_("b"), F.nullif(F.col("id"), None).as_("c"))
    assert one.first() == {"a": None, "b": None, "c": 2}


def test_ties_keep_the_order_of_the_source(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(i, i % 3, f"g{i % 5}") for i in range(100)], "id int, k int, g string").coalesce(1))
    assert [r["id"] for r in e.table("t").where("id", ">", 9).order_by("k").limit(5).get()] == [12, 15, 18, 21, 24]
    assert [r["g"] for r in e.table("t").select(Agg.count().as_("n")).where("id", ">", 1).group_by("g").order_by("n").get()] == ["g0", "g1", "g2", "g3", "g4"]
    assert [r["g"] for r in e.table("t").select("g").distinct().where("k", 1).order_by("g", "DESC").get()] == ["g4", "g3", "g2", "g1", "g0"]

    def define(t):
        t.int("id").primary_key()
        t.int("k")

    e.create_table("s", define)
    e.table("s").insert_many([{"id": 50 - i, "k": i % 2} for i in range(20)])
    e.table("s").insert_many([{"id": 100 + i, "k": i % 2} for i in range(4)])
    assert [r["id"] for r in e.table("s").order_by("k").get()] == [50 - i for i in range(0, 20, 2)] + [100, 102] + [50 - i for i in range(1, 20, 2)] + [101, 103]
    joined = e.table("s a").join("s b", "a.k", "=", "b.k").select("a.id", Func.col("b.id").as_("other")).where("a.id", ">", 100).order_by("a.k").limit(3)
    assert [(r["id"], r["other"]) for r in joined.get()] == [(102, 50), (102, 48), (102, 46)]
    assert [r["n"] for r in e.table("s").select("id", Func.row_number().order_by("k").as_("n")).order_by("id").limit(2).get()] == [24 - 2, 10]


def test_one_union_removes_what_several_would(spark):
    e = Engine(spark)
    for n, values in (("a", [1, 1]), ("b", [1, 2]), ("c", [2, 2]), ("d", [3, 3])):
        e.register(n, spark.createDataFrame([(v,) for v in values], "v int"))
    q = e.table("a").union(e.table("b")).union(e.table("c")).union_all(e.table("d"))
    assert sorted(q.get().pluck("v")) == [1, 2, 3, 3]
    assert q.df()._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_stable_order_keeps_filters_at_the_scan(spark):
    e = Engine(spark)
    e.register("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    plan = e.table("orders").select("o_orderkey").where("o_totalprice", ">", 1000).order_by("o_orderstatus").limit(5).df()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(o_totalprice,1000" in plan

"""Registered queries on state and outcomes: what writes, rules, catalogs, files and handles leave behind."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import migration, streaming
from .bridge import Mapper
from .engine import Engine
from .errors import BrindleError
from .functions import Agg, CaseWhen, Func
from .functions.expressions import Expression
from .plans.ir import ConditionGroup, Constant
from .registry import C, G, _row, _stored, _then, _write, query
from .sources import exchange
from .sources.shared import shared_folder
from .sources.store import Store


def _rows(e: Engine, schema: str, rows: list[tuple]) -> DataFrame:
    return e.spark.createDataFrame(rows, schema)


def _outcome(run: Callable) -> str:
    """The class of the error that ``run`` raises, or ``none``."""
    try:
        run()
    except BrindleError as error:
        return type(error).__name__
    return "none"


def _values(columns: str, *rows: tuple) -> str:
    """SQL of literal rows."""
    shown = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) AS t({columns})"


def _aside(e: Engine, name: str) -> str:
    return f"{shared_folder(e.spark)}/{name}-{uuid.uuid4().hex}"


def _people(t) -> None:
    t.id()
    t.varchar("name", 8).not_null().unique()
    t.int("age").default(18)
    t.check("adult", ConditionGroup().where("age", ">=", 18))


def _pets(t) -> None:
    t.id()
    t.bigint("owner")
    t.foreign_key("owner").references("people", "id").on_delete("RESTRICT").on_update("CASCADE")


# ties and order

query("order_stable", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER () AS place FROM orders) ORDER BY o_orderpriority, place LIMIT 40")(
    lambda e: e.table("orders").select("o_orderkey", "o_orderpriority").order_by("o_orderpriority").limit(40)
)
query("order_stable_filtered", "SELECT o_orderkey FROM (SELECT *, row_number() OVER () AS place FROM orders) WHERE o_totalprice > 150000 ORDER BY o_orderstatus DESC, place LIMIT 30 OFFSET 10")(
    lambda e: e.table("orders").select("o_orderkey").where("o_totalprice", ">", 150000).order_by_desc("o_orderstatus").limit(30).offset(10)
)
query("order_stable_groups", "SELECT c_nationkey, count(*) AS n FROM (SELECT *, row_number() OVER () AS place FROM customer) GROUP BY c_nationkey ORDER BY count(*) DESC, min(place) LIMIT 7")(
    lambda e: e.table("customer").select(Agg.count().as_("n")).group_by("c_nationkey").order_by_desc("n").limit(7)
)
query("order_stable_distinct", "SELECT p_brand, p_size FROM (SELECT p_brand, p_size, min(place) AS place FROM (SELECT *, row_number() OVER () AS place FROM part) GROUP BY p_brand, p_size) ORDER BY p_size, place LIMIT 15")(
    lambda e: e.table("part").select("p_brand", "p_size").distinct().order_by("p_size").limit(15)
)
query("win_row_number_ties", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, place) AS rn FROM (SELECT *, row_number() OVER () AS place FROM orders)")(
    lambda e: e.table("orders").select("o_orderkey", Func.row_number().partition_by("o_orderstatus").order_by("o_orderpriority").as_("rn"))
)
query("win_row_number_global", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, place) AS rn FROM (SELECT *, row_number() OVER () AS place FROM orders)")(
    lambda e: e.table("orders").select("o_orderkey", Func.row_number().order_by("o_orderpriority").as_("rn"))
)

# names, constants and NULLs

query("output_names", 'SELECT c.c_custkey, upper(c.c_name) AS "UPPER(c_name)", c.c_acctbal AS balance FROM customer c')(lambda e: e.table("customer c").select("c.c_custkey", Func.upper(C("c_name")), C("c.c_acctbal").as_("balance")))
query("names_across_sources", "SELECT n_name, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r_name = 'ASIA' AND n.n_nationkey > 5")(
    lambda e: e.table("nation n").join("region r", "n_regionkey", "=", "r.r_regionkey").select("n_name", "r.r_name").where("r_name", "ASIA").where("n.n_nationkey", ">", 5)
)
query("unknown_names", _values("what, outcome", ("column", "QueryError"), ("alias", "QueryError"), ("table", "StorageError"), ("ambiguous", "QueryError")))(
    lambda e: _rows(e, "what string, outcome string", [
        ("column", _outcome(lambda: e.table("nation").select("nope").df())), ("alias", _outcome(lambda: e.table("nation n").where("x.n_name", "A").df())),
        ("table", _outcome(lambda: e.table("nowhere").df())), ("ambiguous", _outcome(lambda: e.table("nation a").join("nation b", "a.n_nationkey", "=", "b.n_nationkey").select("n_name").df())),
    ])
)
query("boolean_constants", "SELECT r_regionkey FROM region WHERE true AND (false OR r_regionkey > 2)")(
    lambda e: e.table("region").select("r_regionkey")._where(Constant(True)).where_group(ConditionGroup((("and", Constant(False)),)).or_where("r_regionkey", ">", 2))
)
query("join_null_keys", "SELECT a.k AS x, b.k AS y FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT r_regionkey, nullif(r_regionkey, 1) AS k FROM region) b ON a.k = b.k")(
    lambda e: e.with_({"a": e.table("nation").select("n_nationkey", Func.nullif(C("n_regionkey"), 1).as_("k")), "b": e.table("region").select("r_regionkey", Func.nullif(C("r_regionkey"), 1).as_("k"))})
    .from_cte("a").left_join_cte("b", "a.k", "=", "b.k").select(C("a.k").as_("x"), C("b.k").as_("y"))
)
query("nullif_numbers", "SELECT c_custkey, nullif(CAST(c_nationkey AS VARCHAR), '7') AS v, c_mktsegment AS w, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey END AS x FROM customer")(
    lambda e: e.table("customer").select(
        "c_custkey", Func.nullif(Func.concat(C("c_nationkey")), 7.0).as_("v"), Func.nullif(C("c_mktsegment"), 5).as_("w"), Func.nullif(C("c_nationkey"), "7").as_("x"))
)
query("wrong_queries", _values("what, outcome", ("rank without order", "QueryError"), ("union of other columns", "QueryError"), ("having without group", "QueryError"), ("negative limit", "QueryError"), ("case without then", "QueryError")))(
    lambda e: _rows(e, "what string, outcome string", [
        ("rank without order", _outcome(lambda: e.table("part").select("p_partkey", Func.rank().as_("r")).df())),
        ("union of other columns", _outcome(lambda: e.table("nation").select("n_name").union(e.table("region").select("r_name")).df())),
        ("having without group", _outcome(lambda: e.table("nation").having("n_name", "x").df())), ("negative limit", _outcome(lambda: e.table("nation").limit(-1))),
        ("case without then", _outcome(lambda: e.table("nation").select(CaseWhen.make().when("n_name", "x").as_("c")).df())),
    ])
)
query("union_nested", "SELECT n_regionkey AS k FROM nation UNION ALL (SELECT r_regionkey AS k FROM region UNION SELECT s_nationkey AS k FROM supplier)")(
    lambda e: e.table("nation").select(C("n_regionkey").as_("k")).union_all(e.table("region").select(C("r_regionkey").as_("k")).union(e.table("supplier").select(C("s_nationkey").as_("k"))))
)
query("union_then_all", "(SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region) UNION ALL SELECT s_nationkey AS k FROM supplier")(
    lambda e: e.table("nation").select(C("n_regionkey").as_("k")).union(e.table("region").select(C("r_regionkey").as_("k"))).union_all(e.table("supplier").select(C("s_nationkey").as_("k")))
)

# handles of results


def _customers(e: Engine):
    _stored(e, "regions", "nations", "customers")
    return e.table("customers")


query("find_primary", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey = 77")(lambda e: _rows(e, "c_custkey long, c_name string, c_nationkey int, c_acctbal double", [tuple(_customers(e).find(77).values())]))
query("first_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")(lambda e: _row(e.spark, **e.table("orders").select("o_orderkey", "o_totalprice").order_by_desc("o_totalprice").order_by("o_orderkey").first()))
query("result_handle", "SELECT count(*) AS n, min(r_name) AS first, string_agg(r_name, ',' ORDER BY r_name) AS names FROM region")(lambda e: _handle(e))
query("cursor_scan", "SELECT count(*) AS n, CAST(sum(p_partkey * rn) AS BIGINT) AS weighted FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rn FROM part)")(lambda e: _cursor(e))
query("chunk_scan", "SELECT CAST((rn - 1) // 70 + 1 AS BIGINT) AS chunk, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) GROUP BY 1")(lambda e: _chunks(e))


def _handle(e: Engine) -> DataFrame:
    found = e.table("region").select("r_name").order_by("r_name").get()
    return _row(e.spark, n=found.count(), first=found.first()["r_name"], names=",".join(found.pluck("r_name")))


def _cursor(e: Engine) -> DataFrame:
    n = weighted = 0
    for r in e.table("part").select("p_partkey").order_by("p_retailprice").order_by("p_partkey").cursor():
        n += 1
        weighted += n * r["p_partkey"]
    return _row(e.spark, n=n, weighted=weighted)


def _chunks(e: Engine) -> DataFrame:
    seen: list[tuple] = []
    e.table("customer").select("c_custkey").order_by("c_custkey").chunk(70, lambda rows, n: seen.append((n, len(rows), rows[0]["c_custkey"])))
    return _rows(e, "chunk long, n long, first long", seen)


# rules of writes

query("auto_increment", "SELECT CAST(id AS BIGINT) AS id, name FROM (" + _values("id, name", (1, "a"), (2, "b"), (10, "c"), (11, "d"), (12, "e")) + ")")(lambda e: _numbered(e))
query("insert_result", _values("row_count, last_insert_id", (2, 2), (1, 10), (2, 12)))(lambda e: _inserted(e))
query("auto_increment_select", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS lo, count(*) AS hi, count(DISTINCT s_suppkey) AS named FROM supplier")(lambda e: _numbered_select(e))
query("rule_outcomes", _values("what, outcome", ("unique", "ConstraintError"), ("not null", "ConstraintError"), ("check", "ConstraintError"), ("too long", "TypeCastError"), ("no parent", "ConstraintError"), ("parent in use", "ConstraintError"), ("unknown column", "QueryError"), ("two in one batch", "ConstraintError"), ("fine", "none")))(lambda e: _rules(e))
query("rules_leave_nothing", _values("id, name, age", (1, "al", 18), (2, "ok", 30)))(lambda e: _ruled(e))
_write("write_where_subquery", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "regions", "nations", "customers")(
    lambda e: _then(e, "customers", lambda: e.table("customers").where_in("c_custkey", e.table("orders").select("o_custkey").where("o_totalprice", ">", 200000)).delete())
)
_write("write_where_exists", "SELECT n_nationkey, CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900) THEN 'RICH' ELSE n_name END AS n_name, n_regionkey FROM nation n", "regions", "nations", "customers")(
    lambda e: _then(e, "nations", lambda: e.table("nations n").where_exists(e.table("customers c").where_column("c.c_nationkey", "=", "n.n_nationkey").where("c.c_acctbal", ">", 9900)).update({"n_name": "RICH"}))
)
_write("matched_rows", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS updated, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS deleted, CAST(0 AS BIGINT) AS none", "regions", "nations", "customers")(
    lambda e: _row(e.spark, updated=e.table("customers").where("c_acctbal", "<", 0).update({"c_acctbal": 0}), deleted=e.table("customers").where("c_acctbal", ">", 9000).delete(), none=e.table("customers").where("c_custkey", -1).update({"c_name": "x"}))
)
_write("trigger_update_delete", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'ONE' ELSE r_name END AS r_name, 'AMERICA>ONE' AS updates, 1 AS deletes FROM region WHERE r_regionkey <> 4", "regions")(lambda e: _triggered(e))
_write("many_small_writes", "SELECT * FROM region UNION ALL SELECT CAST(100 + i AS INTEGER), 'R' || i FROM range(0, 40) t(i)", "regions")(lambda e: _small(e))


def _numbered(e: Engine) -> DataFrame:
    _inserted(e)
    return e.table("people").select("id", "name").df()


def _inserted(e: Engine) -> DataFrame:
    e.create_table("people", _people)
    t = e.table("people")
    made = [t.insert_many([{"name": "a"}, {"name": "b"}]), t.insert({"id": 10, "name": "c"}), t.insert_many([{"name": "d"}, {"name": "e"}])]
    return _rows(e, "row_count int, last_insert_id int", [(r.row_count, r.last_insert_id) for r in made])


def _numbered_select(e: Engine):
    def define(t):
        t.id()
        t.varchar("name", 25)

    e.create_table("numbered", define)
    e.table("numbered").insert_select(e.table("supplier").select(C("s_name").as_("name")))
    return e.table("numbered").select(Agg.count().as_("n"), Agg.min("id").as_("lo"), Agg.max("id").as_("hi"), Agg.count("name").as_("named"))


def _rules(e: Engine) -> DataFrame:
    e.create_table("people", _people)
    e.create_table("pets", _pets)
    t = e.table("people")
    t.insert({"name": "al"})
    e.table("pets").insert({"owner": 1})
    tried = [
        ("unique", lambda: t.insert({"name": "al"})), ("not null", lambda: t.insert({"name": None})), ("check", lambda: t.insert({"name": "x", "age": 3})), ("too long", lambda: t.insert({"name": "x" * 9})),
        ("no parent", lambda: e.table("pets").insert({"owner": 9})), ("parent in use", lambda: t.where("id", 1).delete()), ("unknown column", lambda: t.insert({"nope": 1})),
        ("two in one batch", lambda: t.insert_many([{"name": "p"}, {"name": "p"}])), ("fine", lambda: t.insert({"name": "ok", "age": 30})),
    ]
    return _rows(e, "what string, outcome string", [(what, _outcome(run)) for what, run in tried])


def _ruled(e: Engine) -> DataFrame:
    _rules(e)
    return e.table("people").select(Func.round(C("id")).as_("id"), "name", "age").df().withColumn("id", F.col("id").cast("int"))


def _triggered(e: Engine) -> DataFrame:
    seen: list[str] = []
    gone: list[str] = []
    e.create_trigger("regions", "after", "update", lambda old, new: seen.append(f"{old['r_name']}>{new['r_name']}"))
    e.create_trigger("regions", "before", "delete", lambda row: gone.append(row["r_name"]))
    e.table("regions").where("r_regionkey", 1).update({"r_name": "ONE"})
    e.table("regions").where("r_regionkey", 4).delete()
    return e.table("regions").df().withColumn("updates", F.lit("|".join(seen))).withColumn("deletes", F.lit(len(gone)))


def _small(e: Engine):
    for i in range(40):
        e.table("regions").insert({"r_regionkey": 100 + i, "r_name": f"R{i}"})
    assert len(e.entry("regions")["parts"]) < 20  # merged as they come
    return e.table("regions")


# catalogs


def _catalog(e: Engine) -> DataFrame:
    e.create_database("other")
    rows = [(d, int(d == e.current_database())) for d in e.databases()]
    e.use("other")
    e.create_table("people", _people)
    rows += [(f"other.{t}", int(e.current_database() == "other")) for t in e.tables()]
    e.use("main")
    rows.append(("dropped", int(_outcome(lambda: e.drop_database("other")) == "none" and not e.has_database("other"))))
    return _rows(e, "name string, state int", rows)


query("databases", _values("name, state", ("main", 1), ("other", 0), ("other.people", 1), ("dropped", 1)))(_catalog)


def _guards(e: Engine) -> DataFrame:
    e.create_table("people", _people)
    e.create_table("pets", _pets)
    e.create_view("adults", e.table("people").select("name").where("age", ">", 20))
    e.table("people").insert({"name": "al", "age": 30})
    rows = [
        ("drop a referenced column", _outcome(lambda: e.alter_table("people", lambda t: t.drop_column("id")))), ("drop a checked column", _outcome(lambda: e.alter_table("people", lambda t: t.drop_column("age")))),
        ("drop a referenced table", _outcome(lambda: e.drop_table("people"))), ("create it twice", _outcome(lambda: e.create_table("people", _people))), ("view of that name", _outcome(lambda: e.create_view("people", e.table("pets")))),
        ("rename a key", _outcome(lambda: e.alter_table("people", lambda t: t.rename_column("id", "key")))), ("its child still finds it", _outcome(lambda: e.table("pets").insert({"owner": 1}))),
        ("and misses others", _outcome(lambda: e.table("pets").insert({"owner": 5}))), ("key", e.table_schema("pets").foreign_keys[0].references),
    ]
    return _rows(e, "what string, outcome string", rows)


query("guards_and_renames", _values("what, outcome", ("drop a referenced column", "SchemaError"), ("drop a checked column", "SchemaError"), ("drop a referenced table", "SchemaError"), ("create it twice", "SchemaError"), ("view of that name", "SchemaError"), ("rename a key", "none"), ("its child still finds it", "none"), ("and misses others", "ConstraintError"), ("key", "key")))(_guards)


def _indexed(e: Engine) -> DataFrame:
    t = _customers(e)
    via = lambda q: q.explain()[0]["via"].partition(" (")[0]
    rows = [("none", via(t.where("c_nationkey", 3))), ("primary", via(t.where("c_custkey", 3)))]
    e.create_index("customers", "by_nation", "c_nationkey")
    rows += [("made", via(t.where("c_nationkey", 3))), ("range", via(t.where("c_nationkey", ">", 3))), ("has", str(e.has_index("customers", "by_nation")))]
    e.drop_index("customers", "by_nation")
    return _rows(e, "what string, via string", [*rows, ("dropped", via(t.where("c_nationkey", 3))), ("rows", str(t.where("c_nationkey", 3).count() == e.table("customer").where("c_nationkey", 3).count()))])


query("indexes", _values("what, via", ("none", "FULL SCAN"), ("primary", "INDEX PRIMARY"), ("made", "INDEX by_nation"), ("range", "FULL SCAN"), ("has", "True"), ("dropped", "FULL SCAN"), ("rows", "True")))(_indexed)
query("explain_steps", _values("place, step", (0, "SCAN"), (1, "JOIN"), (2, "SUBQUERY"), (3, "AGGREGATE"), (4, "SORT"), (5, "LIMIT")))(
    lambda e: _rows(e, "place int, step string", [(i, s["step"]) for i, s in enumerate(
        e.table("nation n").join("region r", "n.n_regionkey", "=", "r.r_regionkey").select(Agg.count().as_("c")).where_in("n.n_nationkey", e.table("customer").select("c_nationkey")).group_by("r.r_name").order_by("c").limit(3).explain())])
)


def _migrated(e: Engine) -> DataFrame:
    _stored(e, "regions")
    target = Engine(e.spark)

    def wider(t):
        t.int("r_regionkey").primary_key()
        t.varchar("r_name", 25).not_null().unique()
        t.int("score").default(7)

    target.create_table("regions", wider)
    target.create_table("people", _people)
    steps = migration.diff(target, e)
    left = migration.apply(e, steps)
    return e.table("regions").df().withColumns({"steps": F.lit(",".join(s["op"] for s in steps)), "unresolved": F.lit(len(left)), "people": F.lit(e.table("people").count()), "again": F.lit(len(migration.diff(target, e)))})


query("migration", "SELECT r_regionkey, r_name, 7 AS score, 'createTable,addColumn' AS steps, 0 AS unresolved, 0 AS people, 0 AS again FROM region")(_migrated)

# files


def _durable(e: Engine, root: str) -> Engine:
    made = Engine(e.spark, root)
    made.register("region", e.frame("region"))
    _stored(made, "regions")
    return made


def _backed_up(e: Engine) -> DataFrame:
    made = _durable(e, _aside(e, "store"))
    made.table("regions").where("r_regionkey", 0).update({"r_name": "ZERO"})
    target = _aside(e, "copy")
    made.backup(target)
    made.table("regions").truncate()
    return Engine(e.spark, target).table("regions").df()


def _two_writers(e: Engine) -> DataFrame:
    root = _aside(e, "store")
    one = _durable(e, root)
    two = Engine(e.spark, root)
    one.begin()
    two.table("regions").insert({"r_regionkey": 50, "r_name": "TWO"})
    one.table("regions").insert({"r_regionkey": 60, "r_name": "ONE"})
    outcome = _outcome(one.commit)
    one.roll_back()
    kept = one.vacuum()  # what another writer may yet commit is young and stays
    one.store.refresh()
    return Engine(e.spark, root).table("regions").df().withColumns({"outcome": F.lit(outcome), "seen": F.lit(one.table("regions").count()), "removed": F.lit(kept)})


def _crashed(e: Engine) -> DataFrame:
    """A writer that stops after its part is written and before its catalog is."""
    root = _aside(e, "store")
    made = _durable(e, root)
    made.store.write(made.frame("regions", ("__batch", "__row")), "main", "regions")
    after = Engine(e.spark, root)
    removed = after.vacuum(grace=0)
    return after.table("regions").df().withColumn("removed", F.lit(removed))


class Halved(Store):
    """A store of one's own: another codec."""

    def __init__(self, spark, root):
        super().__init__(spark, root, "gzip", durable=False)


def _own_store(e: Engine):
    made = Engine(e.spark, store=Halved(e.spark, _aside(e, "own")))
    made.register("region", e.frame("region"))
    _stored(made, "regions")
    assert made.store.compression == "gzip"
    return made.table("regions")


def _exchanged(e: Engine) -> DataFrame:
    _stored(e, "regions")
    document, lines = _aside(e, "document"), _aside(e, "lines")
    exchange.write_table_json(e.table("regions").df(), document, e.table_schema("regions").to_dict(), 0)
    back = exchange.read_table_json(e.spark, document, e.table_schema("regions").struct())
    hidden = exchange.encrypted(back, ["r_name"], b"0123456789abcdef")
    exchange.write_json_lines(hidden, lines)
    return exchange.decrypted(exchange.read_json_lines(e.spark, lines, hidden.schema), ["r_name"], b"0123456789abcdef")


query("backup", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'ZERO' ELSE r_name END AS r_name FROM region")(_backed_up)
query("two_writers", "SELECT *, 'TransactionError' AS outcome, (SELECT CAST(count(*) + 1 AS INTEGER) FROM region) AS seen, 0 AS removed FROM (SELECT * FROM region UNION ALL SELECT 50, 'TWO')")(_two_writers)
query("crash_recovery", "SELECT r_regionkey, r_name, 1 AS removed FROM region")(_crashed)
query("own_store", "SELECT r_regionkey, r_name FROM region")(_own_store)
query("exchange_formats", "SELECT r_regionkey, r_name FROM region")(_exchanged)

# connectors, functions of one's own, streams

query("mapper", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE (n_nationkey > 3 AND (r_name = 'ASIA' OR n_name LIKE 'C%')) ORDER BY n_name LIMIT 6")(
    lambda e: Mapper(e).query({
        "table": "nation", "alias": "n", "join": [("inner", "region r", "n.n_regionkey", "=", "r.r_regionkey")], "field": "n.n_name, r.r_name",
        "where": [("n.n_nationkey", ">", 3), ("and", [("r.r_name", "=", "ASIA")] + [("or", [("n.n_name", "like", "C%")])])], "order": {"n.n_name": "asc"}, "limit": 6})
)


@dataclass(frozen=True)
class Doubled(Expression):
    """A function of one's own, in Arrow batches."""

    name: str
    alias: str | None = None

    def default_name(self) -> str:
        return f"DOUBLED({self.name})"

    def column(self, resolve):
        def doubled(x: pd.Series) -> pd.Series:
            return x * 2

        return F.pandas_udf(doubled, T.DoubleType())(resolve(self.name).cast("double"))


query("own_function", "SELECT p_partkey, p_size * 2.0::DOUBLE AS v FROM part WHERE p_size > 30")(lambda e: e.table("part").select("p_partkey", Doubled("p_size").as_("v")).where("p_size", ">", 30))


def _streamed(e: Engine) -> DataFrame:
    """A builder query on a stream of files, run to its end."""
    source, name = _aside(e, "stream"), f"streamed_{uuid.uuid4().hex}"
    events = e.frame("events").select("event_id", "user_id")
    events.write.parquet(source)
    e.register("incoming", e.spark.readStream.schema(events.schema).parquet(source))
    run = streaming.start(e.table("incoming").select("event_id", C("user_id").as_("u")).where("user_id", ">", 50), name, _aside(e, "progress"))
    run.processAllAvailable()
    run.stop()
    return e.spark.table(name)


query("stream_stateless", "SELECT event_id, user_id AS u FROM events WHERE user_id > 50")(_streamed)

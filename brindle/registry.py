"""The registered queries: one for each operator, with equivalent SQL.

Each takes (spark, sf_dir), registers the tables of that folder on a fresh
engine and builds its query over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .functions import Agg, CaseWhen, Func, Like
from .plans.ir import ConditionGroup

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "benchmark", "pages", "embeddings")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C, G = Func.col, ConditionGroup


def engine_on(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose tables are the Parquet files of a folder."""
    engine = Tables(spark)
    engine.sf_dir = sf_dir
    return engine


class Tables(Engine):
    """Reads a table's file when the table is first named."""

    sf_dir = ""

    def _known(self, name: str) -> None:
        if name in TABLES and name not in self.external and not self.has_table(name):
            self.external[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def frame(self, name, keep=()):
        self._known(name)
        return super().frame(name, keep)

    def schema_of(self, name):
        self._known(name)
        return super().schema_of(name)

    def ci_columns(self, name):
        self._known(name)
        return super().ci_columns(name)


def query(name: str, sql: str):
    """Registers ``build(engine)``, which gives a query or a DataFrame."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = build(engine_on(spark, sf_dir))
            return made if isinstance(made, DataFrame) else made.df()

        QUERIES[name], SQL[name] = run, " ".join(sql.split())
        return build

    return add


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# scans and projection
query("scan_all", "SELECT * FROM nation")(lambda e: e.table("nation"))
query("project_cols", "SELECT c_custkey, c_name, c_acctbal AS balance FROM customer")(lambda e: e.table("customer as c").select("c.c_custkey", "c_name", C("c.c_acctbal").as_("balance")))
query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda e: e.table("lineitem").select("l_returnflag", "l_linestatus").distinct())
query("find_by_key", "SELECT * FROM orders WHERE o_orderkey = 32 LIMIT 1")(lambda e: e.table("orders").where("o_orderkey", 32).limit(1))

# predicates
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    query(f"where_cmp_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 20")(lambda e, op=_op: e.table("part").select("p_partkey", "p_size").where("p_size", op, 20))
query("where_column", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")(lambda e: e.table("lineitem").select("l_orderkey", "l_linenumber").where_column("l_partkey", "<", "l_suppkey"))
query("where_text_date", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-07-01 00:00:00'")(
    lambda e: e.table("orders").select("o_orderkey", "o_orderdate").where("o_orderdate", ">=", "1996-01-01").where("o_orderdate", "<", "1996-07-01 00:00:00")
)
query("where_or_leftfold", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 100000")(
    lambda e: e.table("orders").select("o_orderkey").where("o_orderstatus", "F").or_where("o_orderpriority", "1-URGENT").where("o_totalprice", ">", 100000)
)
query("where_group", "SELECT p_partkey FROM part WHERE p_size > 10 AND (p_brand = 'Brand#13' OR p_retailprice < 1000)")(
    lambda e: e.table("part").select("p_partkey").where("p_size", ">", 10).where_group(G().where("p_brand", "Brand#13").or_where("p_retailprice", "<", 1000))
)
query("or_where_group", "SELECT p_partkey FROM part WHERE p_size > 45 OR (p_brand = 'Brand#13' AND p_retailprice < 1000)")(
    lambda e: e.table("part").select("p_partkey").where("p_size", ">", 45).or_where_group(G().where("p_brand", "Brand#13").where("p_retailprice", "<", 1000))
)
query("where_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 13) AND p_brand IN ('Brand#13', 'Brand#22')")(
    lambda e: e.table("part").select("p_partkey", "p_size").where_in("p_size", [1, 7, 13]).where_in("p_brand", ["Brand#13", "Brand#22"])
)
query("where_not_in_nulls", "SELECT v.k FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'F') AS s FROM orders) v WHERE v.s IS NOT NULL AND v.s NOT IN ('O')")(
    lambda e: e.table("orders").from_sub(e.table("orders").select(C("o_orderkey").as_("k"), Func.nullif(C("o_orderstatus"), "F").as_("s")), "v").select("v.k").where_not_in("v.s", ["O", None])
)
query("where_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000.5")(lambda e: e.table("orders").select("o_orderkey").where_between("o_totalprice", 1000, 50000.5))
query("where_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")(
    lambda e: e.table("documents d").left_join("labels l", "d.doc_id", "=", "l.doc_id").select("d.doc_id").where_null("l.quality")
)
query("where_not_null", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")(
    lambda e: e.table("documents d").left_join("labels l", "d.doc_id", "=", "l.doc_id").select("d.doc_id", "l.quality").where_not_null("l.quality")
)
query("where_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%' AND p_brand LIKE 'Brand#_3'")(lambda e: e.table("part").select("p_partkey", "p_name").where_like("p_name", "%widget%").where_like("p_brand", "Brand#_3"))
query("where_like_escaped", r"SELECT event_id FROM events WHERE contains(props, '_') OR contains(props, '%')")(
    lambda e: e.table("events").select("event_id").where_group(G().where_like("props", f"%{Like.escape('_')}%").or_where_like("props", f"%{Like.escape('%')}%"))
)
query("ci_filter", "SELECT c_custkey FROM ci_customer WHERE lower(c_mktsegment) = 'building'".replace("ci_customer", "customer"))(lambda e: _ci(e).select("c_custkey").where("c_mktsegment", "buildING"))
query("ci_join", "SELECT a.c_custkey, r.r_name FROM customer a JOIN nation n ON a.c_nationkey = n.n_nationkey JOIN region r ON lower(substr(a.c_mktsegment, 1, 1)) = lower(substr(r.r_name, 1, 1)) AND n.n_regionkey = r.r_regionkey")(lambda e: _ci_join(e))
query("ci_sort", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY lower(c_mktsegment), c_custkey DESC LIMIT 50")(
    lambda e: _ci(e).select("c_custkey", "c_mktsegment").order_by("c_mktsegment").order_by_desc("c_custkey").limit(50)
)


def _ci(e: Engine):
    """A stored copy of customers with case-insensitive segments."""
    if not e.has_table("ci_customer"):
        def define(t):
            t.bigint("c_custkey").primary_key()
            t.varchar("c_mktsegment", 32).ci()
            t.varchar("c_initial", 1).ci()
            t.int("c_nationkey")

        e.create_table("ci_customer", define)
        e.table("ci_customer").insert_select(e.table("customer").select("c_custkey", "c_mktsegment", Func.lower(Func.substr(C("c_mktsegment"), 1, 1)).as_("c_initial"), "c_nationkey"))
    return e.table("ci_customer")


def _ci_join(e: Engine):
    _ci(e)
    regions = e.table("region").select("r_regionkey", "r_name", Func.substr(C("r_name"), 1, 1).as_("initial"))
    on = G().where_column("a.c_initial", "=", "r.initial").where_column("n.n_regionkey", "=", "r.r_regionkey")
    made = e.table("ci_customer a").join("nation n", "a.c_nationkey", "=", "n.n_nationkey").with_("r", regions)
    return made._join("inner", made._cte("r", None), on).select("a.c_custkey", "r.r_name")


# subqueries
_RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 9000"
query("in_subquery", f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({_RICH})")(
    lambda e: e.table("orders").select("o_orderkey").where_in("o_custkey", e.table("customer").select("c_custkey").where("c_acctbal", ">", 9000))
)
query("not_in_subquery_null", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")(
    lambda e: e.table("orders").select("o_orderkey").where_not_in(
        "o_custkey", e.table("customer").select(CaseWhen.make().when("c_mktsegment", "BUILDING").then(None).else_(C("c_custkey")).as_("k")))
)
query("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")(
    lambda e: e.table("customer c").select("c.c_custkey").where_exists(e.table("orders o").where_column("o.o_custkey", "=", "c.c_custkey").where("o.o_totalprice", ">", 400000))
)
query("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")(
    lambda e: e.table("customer c").select("c.c_custkey").where_not_exists(e.table("orders o").where_column("o.o_custkey", "=", "c.c_custkey").where("o.o_orderstatus", "P"))
)
query("or_exists", "SELECT c_custkey FROM customer c WHERE c.c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")(
    lambda e: e.table("customer c").select("c.c_custkey").where("c.c_acctbal", ">", 9500).or_where_exists(e.table("orders o").where_column("o.o_custkey", "=", "c.c_custkey").where("o.o_totalprice", ">", 400000))
)
query("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")(
    lambda e: e.table("part").select("p_partkey").where_scalar("p_retailprice", ">", e.table("part").select(Agg.avg("p_retailprice").as_("a")))
)
query("corr_in", "SELECT c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT s.s_nationkey FROM supplier s WHERE s.s_acctbal > c.c_acctbal)")(
    lambda e: e.table("customer c").select("c.c_custkey").where_in("c.c_nationkey", e.table("supplier s").select("s.s_nationkey").where_column("s.s_acctbal", ">", "c.c_acctbal"))
)
query("corr_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9000)")(
    lambda e: e.table("supplier s").select("s.s_suppkey").where_exists(e.table("customer c").where_column("c.c_nationkey", "=", "s.s_nationkey").where("c.c_acctbal", ">", 9000))
)
query("corr_scalar", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")(
    lambda e: e.table("orders o").select("o.o_orderkey").where_scalar("o.o_totalprice", "=", e.table("orders i").select(Agg.max("i.o_totalprice").as_("m")).where_column("i.o_custkey", "=", "o.o_custkey"))
)
query("nested_subquery", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))")(
    lambda e: e.table("nation").select("n_name").where_in("n_nationkey", e.table("customer").select("c_nationkey").where_in("c_custkey", e.table("orders").select("o_custkey").where("o_totalprice", ">", 450000)))
)

# joins
query("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda e: e.table("nation").join("region", "n_regionkey", "=", "r_regionkey").select("n_name", "r_name"))
query("join_left", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda e: e.table("documents d").left_join("labels l", "d.doc_id", "=", "l.doc_id").select("d.doc_id", "l.toxic"))
query("join_right", "SELECT l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")(lambda e: e.table("labels l").right_join("documents d", "l.doc_id", "=", "d.doc_id").select("l.quality", "d.doc_id"))
query("join_theta", "SELECT a.n_name AS a_name, r.r_name FROM nation a JOIN region r ON a.n_regionkey < r.r_regionkey")(lambda e: e.table("nation a").join("region r", "a.n_regionkey", "<", "r.r_regionkey").select(C("a.n_name").as_("a_name"), "r.r_name"))
query("join_on_group", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal < s.s_acctbal")(
    lambda e: e.table("customer c").join_on("supplier s", G().where_column("c.c_nationkey", "=", "s.s_nationkey").where_column("c.c_acctbal", "<", "s.s_acctbal")).select("c.c_custkey", "s.s_suppkey")
)
query("join_on_or", "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON (n.n_regionkey = r.r_regionkey OR r.r_name = 'ASIA')")(
    lambda e: e.table("nation n").left_join_on("region r", G().where_column("n.n_regionkey", "=", "r.r_regionkey").or_where("r.r_name", "ASIA")).select("n.n_name", "r.r_name")
)
query("join_using", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")(lambda e: e.table("documents d").join_using("labels l", "doc_id").select("d.doc_id", "d.lang", "l.quality"))
query("join_using_multi", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")(
    lambda e: e.table("lineitem a").join_using("lineitem b", ["l_orderkey", "l_linenumber"]).select("a.l_orderkey", "a.l_linenumber", "b.l_quantity")
)
query("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")(
    lambda e: e.table("nation a").join("nation b", "a.n_regionkey", "=", "b.n_regionkey").select(C("a.n_name").as_("x"), C("b.n_name").as_("y")).where_column("a.n_nationkey", "<", "b.n_nationkey")
)
query("join_chain", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")(
    lambda e: e.table("customer c").join("nation n", "c.c_nationkey", "=", "n.n_nationkey").left_join("region r", "n.n_regionkey", "=", "r.r_regionkey").select("c.c_custkey", "n.n_name", "r.r_name")
)
_SPENT = "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey)"


def _spent(e: Engine):
    return e.table("orders").select("o_custkey", Agg.count().as_("n")).where("o_totalprice", ">", 200000).group_by("o_custkey")


query("join_cte", f"{_SPENT} SELECT c.c_name, t.n FROM customer c JOIN t ON c.c_custkey = t.o_custkey")(lambda e: e.table("customer c").with_({"t": _spent(e)}).join_cte("t", "c.c_custkey", "=", "t.o_custkey").select("c.c_name", "t.n"))
query("left_join_cte", f"{_SPENT} SELECT c.c_name, t.n FROM customer c LEFT JOIN t ON c.c_custkey = t.o_custkey")(lambda e: e.table("customer c").with_({"t": _spent(e)}).left_join_cte("t", "c.c_custkey", "=", "t.o_custkey").select("c.c_name", "t.n"))
query("right_join_cte", f"{_SPENT} SELECT c.c_name, t.n FROM customer c RIGHT JOIN t ON c.c_custkey = t.o_custkey")(lambda e: e.table("customer c").with_({"t": _spent(e)}).right_join_cte("t", "c.c_custkey", "=", "t.o_custkey").select("c.c_name", "t.n"))

# aggregation; sums of doubles are rounded in an outer query
query("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")(
    lambda e: e.table("lineitem").from_sub(e.table("lineitem").select(Agg.count().as_("n"), Agg.sum("l_quantity").as_("q"), Agg.avg("l_discount").as_("d"), Agg.min("l_tax").as_("lo"), Agg.max("l_tax").as_("hi")), "t")
    .select("n", Func.round(C("q"), 2).as_("q"), Func.round(C("d"), 6).as_("d"), "lo", "hi")
)
query("agg_global_empty", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, max(p_name) AS m FROM part WHERE p_size < 0")(lambda e: e.table("part").select(Agg.count().as_("n"), Agg.sum("p_size").as_("s"), Agg.max("p_name").as_("m")).where("p_size", "<", 0))
query("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")(
    lambda e: e.table("lineitem").from_sub(e.table("lineitem").select(Agg.count().as_("n"), Agg.sum("l_quantity").as_("q")).group_by("l_returnflag", "l_linestatus"), "t").select("l_returnflag", "l_linestatus", "n", Func.round(C("q"), 2).as_("q"))
)
query("group_by_expr", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1")(lambda e: e.table("orders").select(Func.year(C("o_orderdate")).as_("y"), Agg.count().as_("n")).group_by("y"))
query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")(lambda e: e.table("orders").select(Agg.count().as_("n")).group_by("o_custkey").having("n", ">=", 15))
query("count_col_nulls", "SELECT d.lang, count(*) AS n, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")(
    lambda e: e.table("documents d").left_join("labels l", "d.doc_id", "=", "l.doc_id").select(Agg.count().as_("n"), Agg.count("l.quality").as_("labelled")).group_by("d.lang")
)
query("min_max_string", "SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand")(lambda e: e.table("part").select(Agg.min("p_name").as_("lo"), Agg.max("p_name").as_("hi")).group_by("p_brand"))
query("first_row_column", "SELECT n_regionkey, first(n_name ORDER BY n_nationkey) AS n_name, count(*) AS n FROM nation GROUP BY n_regionkey")(lambda e: e.table("nation").select("n_name", Agg.count().as_("n")).group_by("n_regionkey"))
query("agg_shortcut_count", "SELECT count(*) AS v FROM orders WHERE o_orderstatus = 'F'")(lambda e: _row(e.spark, v=e.table("orders").where("o_orderstatus", "F").count()))
query("agg_shortcut_sum", "SELECT CAST(sum(p_size) AS BIGINT) AS v FROM part")(lambda e: _row(e.spark, v=e.table("part").sum("p_size")))
query("agg_shortcut_avg", "SELECT avg(p_size) AS v FROM part")(lambda e: _row(e.spark, v=e.table("part").avg("p_size")))
query("agg_shortcut_min", "SELECT min(p_retailprice) AS v FROM part")(lambda e: _row(e.spark, v=e.table("part").min("p_retailprice")))
query("agg_shortcut_max", "SELECT max(p_name) AS v FROM part")(lambda e: _row(e.spark, v=e.table("part").max("p_name")))

# windows
query("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")(
    lambda e: e.table("orders").select("o_orderkey", Func.row_number().partition_by("o_custkey").order_by_desc("o_totalprice").order_by("o_orderkey").as_("rn"))
)
query("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")(lambda e: e.table("part").select("p_partkey", Func.rank().partition_by("p_brand").order_by("p_size").as_("r")))
query("win_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")(lambda e: e.table("part").select("p_partkey", Func.dense_rank().partition_by("p_brand").order_by("p_size").as_("r")))
for _f in ("count", "sum", "avg", "min", "max"):
    _w = f"{_f}(p_size) OVER (PARTITION BY p_brand)"
    query(f"win_{_f}", f"SELECT p_partkey, {f'CAST({_w} AS BIGINT)' if _f == 'sum' else _w} AS v FROM part")(lambda e, f=_f: e.table("part").select("p_partkey", getattr(Agg, f)("p_size").over().partition_by("p_brand").order_by("p_name").as_("v")))
query("win_over_agg", "SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_orderpriority")(
    lambda e: e.table("orders").select(Agg.count().as_("n"), Func.rank().order_by_desc("n").as_("r")).group_by("o_orderpriority")
)
query("win_global", "SELECT p_partkey, max(p_size) OVER () AS hi, count(*) OVER () AS n FROM part")(lambda e: e.table("part").select("p_partkey", Agg.max("p_size").over().as_("hi"), Agg.count().over().as_("n")))

# sort and paging
query("order_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")(lambda e: e.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal").order_by("c_mktsegment").order_by("c_acctbal", "desc").order_by("c_custkey"))
query("order_unprojected", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")(lambda e: e.table("customer").select("c_name").order_by_desc("c_acctbal").order_by("c_custkey").limit(20))
query("order_nulls", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 100")(
    lambda e: e.table("documents d").left_join("labels l", "d.doc_id", "=", "l.doc_id").select("d.doc_id", "l.quality").order_by("l.quality").order_by("d.doc_id").limit(100)
)
query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")(lambda e: e.table("orders").select("o_orderkey").order_by("o_orderkey").limit(25).offset(50))
query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda e: e.table("orders").select("o_orderkey", "o_totalprice").order_by_desc("o_totalprice").order_by("o_orderkey").limit(10))

# set operations
query("union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey AS k FROM customer")(lambda e: e.table("supplier").select(C("s_nationkey").as_("k")).union(e.table("customer").select(C("c_nationkey").as_("k"))))
query("union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey AS k FROM customer")(lambda e: e.table("supplier").select(C("s_nationkey").as_("k")).union_all(e.table("customer").select(C("c_nationkey").as_("k"))))
query("union_chain", "(SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region) UNION SELECT s_nationkey AS k FROM supplier")(
    lambda e: e.table("nation").select(C("n_regionkey").as_("k")).union_all(e.table("region").select(C("r_regionkey").as_("k"))).union(e.table("supplier").select(C("s_nationkey").as_("k")))
)
query("union_outer_order_limit", "SELECT * FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT c_name AS name FROM customer) ORDER BY name DESC LIMIT 12 OFFSET 3")(
    lambda e: e.table("supplier").select(C("s_name").as_("name")).union_all(e.table("customer").select(C("c_name").as_("name"))).order_by_desc("name").limit(12).offset(3)
)
query("union_side_limit", "SELECT n_name AS name FROM nation UNION ALL SELECT * FROM (SELECT c_name AS name FROM customer ORDER BY c_custkey LIMIT 5)")(
    lambda e: e.table("nation").select(C("n_name").as_("name")).union_all(e.table("customer").select(C("c_name").as_("name")).order_by("c_custkey").limit(5))
)

# functions
_DOC = "SELECT doc_id, {} AS v FROM documents"
for _name, _make, _sql in (
    ("upper", lambda: Func.upper(C("source")), "upper(source)"), ("lower", lambda: Func.lower(C("text")), "lower(text)"), ("length", lambda: Func.length(C("text")), "CAST(length(text) AS INTEGER)"),
    ("trim", lambda: Func.trim(Func.concat(" \t", C("source"), " \n")), "source"), ("ltrim", lambda: Func.ltrim(Func.concat(" \t", C("source"), " x ")), "source || ' x '"),
    ("rtrim", lambda: Func.rtrim(Func.concat(" x ", C("source"), " \n")), "' x ' || source"), ("substr", lambda: Func.substr(C("text"), 3, 10), "substr(text, 3, 10)"),
    ("concat", lambda: Func.concat(C("lang"), "-", C("source"), True), "lang || '-' || source || '1'"), ("replace", lambda: Func.replace(C("text"), "the", "THE"), "replace(text, 'the', 'THE')"),
    ("coalesce", lambda: Func.coalesce(Func.nullif(C("lang"), "en"), C("source")), "coalesce(nullif(lang, 'en'), source)"), ("nullif", lambda: Func.nullif(C("lang"), "en"), "nullif(lang, 'en')"),
):
    query(f"fn_{_name}", _DOC.format(_sql))(lambda e, make=_make: e.table("documents").select("doc_id", make().as_("v")))
for _name, _make, _sql in (
    ("abs", lambda: Func.abs(C("c_acctbal")), "abs(c_acctbal)"), ("round", lambda: Func.round(C("c_acctbal"), 1), "round(c_acctbal, 1)"),
    ("floor", lambda: Func.floor(C("c_acctbal")), "floor(c_acctbal)"), ("ceil", lambda: Func.ceil(C("c_acctbal")), "ceil(c_acctbal)"),
):
    query(f"fn_{_name}", f"SELECT c_custkey, CAST({_sql} AS DOUBLE) AS v FROM customer")(lambda e, make=_make: e.table("customer").select("c_custkey", make().as_("v")))
for _name in ("year", "month", "day"):
    query(f"fn_{_name}", f"SELECT o_orderkey, CAST({_name}(o_orderdate) AS INTEGER) AS v FROM orders")(lambda e, name=_name: e.table("orders").select("o_orderkey", getattr(Func, name)(C("o_orderdate")).as_("v")))
query("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS v FROM part")(
    lambda e: e.table("part").select("p_partkey", CaseWhen.make().when("p_size", "<", 10).then("small").when("p_size", "<", 30).then("middle").else_("large").as_("v"))
)
query("case_nested", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_mktsegment) ELSE CASE WHEN c_nationkey = 3 THEN 'three' ELSE c_name END END AS v FROM customer")(
    lambda e: e.table("customer").select("c_custkey", CaseWhen.make().when("c_acctbal", "<", 0).then(Func.upper(C("c_mktsegment"))).else_(CaseWhen.make().when("c_nationkey", 3).then("three").else_(C("c_name"))).as_("v"))
)

# derived tables, common table expressions, views
query("from_sub", "SELECT t.k FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 12")(
    lambda e: e.table("orders").from_sub(e.table("orders").select(C("o_custkey").as_("k"), Agg.count().as_("n")).group_by("o_custkey"), "t").select("t.k").where("t.n", ">", 12)
)
query("from_sub_join", "SELECT c.c_name, t.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t JOIN customer c ON t.o_custkey = c.c_custkey")(
    lambda e: e.table("orders").from_sub(e.table("orders").select(Agg.count().as_("n")).group_by("o_custkey"), "t").join("customer c", "t.o_custkey", "=", "c.c_custkey").select("c.c_name", "t.n")
)
query("cte_from", f"{_SPENT} SELECT o_custkey, n FROM t WHERE n > 5")(lambda e: e.with_({"t": _spent(e)}).from_cte("t").select("o_custkey", "n").where("n", ">", 5))
query("cte_chain", f"{_SPENT}, u AS (SELECT n, count(*) AS m FROM t GROUP BY n) SELECT n, m FROM u WHERE m > 1")(lambda e: _cte_chain(e))
query("cte_reuse", f"{_SPENT} SELECT a.o_custkey, b.n FROM t a JOIN t b ON a.o_custkey = b.o_custkey")(
    lambda e: e.with_({"t": _spent(e)}).from_cte("t", "a").join_cte("t", "a.o_custkey", "=", "b.o_custkey", "b").select("a.o_custkey", "b.n")
)


def _cte_chain(e: Engine):
    q = e.with_({"t": _spent(e)})
    return q.with_("u", q.from_cte("t").select(Agg.count().as_("m")).group_by("n")).from_cte("u").select("n", "m").where("m", ">", 1)


def _stored(e: Engine, *names: str) -> None:
    """Copies of driver tables with keys, filled by INSERT SELECT."""
    def region(t):
        t.int("r_regionkey").primary_key()
        t.varchar("r_name", 25).not_null().unique()

    def nation(t):
        t.int("n_nationkey").primary_key()
        t.varchar("n_name", 25).not_null()
        t.int("n_regionkey")
        t.foreign_key("n_regionkey").references("regions", "r_regionkey").on_delete("CASCADE").on_update("CASCADE")

    def customer(t):
        t.bigint("c_custkey").primary_key()
        t.varchar("c_name", 25).not_null()
        t.int("c_nationkey")
        t.double("c_acctbal")
        t.foreign_key("c_nationkey").references("nations", "n_nationkey").on_delete("CASCADE").on_update("CASCADE")

    defined = {"regions": (region, "region", ("r_regionkey", "r_name")), "nations": (nation, "nation", ("n_nationkey", "n_name", "n_regionkey")), "customers": (customer, "customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal"))}
    for name in names:
        define, source, columns = defined[name]
        e.create_table(name, define)
        e.table(name).insert_select(e.table(source).select(*columns))


def _write(name: str, sql: str, *tables: str):
    """Registers a write: ``run(engine)`` changes stored copies and gives the final state."""

    def add(run):
        def build(e: Engine):
            _stored(e, *tables)
            return run(e)

        return query(name, sql)(build)

    return add


def _then(e: Engine, result: str, *writes):
    for w in writes:
        w()
    return e.table(result)


query("view_query", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")(lambda e: _view(e))
query("view_refine", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_custkey < 500 ORDER BY c_custkey LIMIT 20")(lambda e: _view(e).where("c_custkey", "<", 500).order_by("c_custkey").limit(20))


def _view(e: Engine):
    _stored(e, "regions", "nations", "customers")
    e.create_view("rich", e.table("customers").select("c_custkey", "c_acctbal").where("c_acctbal", ">", 5000))
    return e.view("rich")


# writes
_R = ("regions",)
_write("dml_insert", "SELECT * FROM region UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, 'MU'", *_R)(
    lambda e: _then(e, "regions", lambda: e.table("regions").insert_many([{"r_regionkey": 100, "r_name": "ATLANTIS"}, {"r_regionkey": "101", "r_name": "MU"}]))
)
_write("dml_insert_select", "SELECT * FROM nation", "regions", "nations")(lambda e: e.table("nations"))
_write("dml_upsert", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'NEW' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'NINE'", *_R)(
    lambda e: _then(e, "regions", lambda: e.table("regions").upsert({"r_regionkey": 1, "r_name": "NEW"}), lambda: e.table("regions").upsert({"r_regionkey": 9, "r_name": "NINE"}))
)
_write("dml_ignore", "SELECT * FROM region UNION ALL SELECT 9, 'NINE'", *_R)(
    lambda e: _then(e, "regions", lambda: e.table("regions").insert_ignore({"r_regionkey": 1, "r_name": "X"}), lambda: e.table("regions").insert_ignore({"r_regionkey": 9, "r_name": "NINE"}))
)
_write("dml_replace", "SELECT * FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 2, 'TWO'", *_R)(lambda e: _then(e, "regions", lambda: e.table("regions").replace({"r_regionkey": 2, "r_name": "TWO"})))
_write("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer", "regions", "nations", "customers")(
    lambda e: _then(e, "customers", lambda: e.table("customers").where("c_acctbal", "<", 0).update({"c_acctbal": 0}))
)
_write("dml_update_limit", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7) THEN 'LOW' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer", "regions", "nations", "customers")(
    lambda e: _then(e, "customers", lambda: e.table("customers").order_by("c_acctbal").order_by("c_custkey").limit(7).update({"c_name": "LOW"}))
)
_write("dml_update_join", "SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN 'REGION2' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey", "regions", "nations", "customers")(
    lambda e: _then(e, "customers", lambda: e.table("customers c").join("nations n", "c.c_nationkey", "=", "n.n_nationkey").where("n.n_regionkey", 2).update({"c.c_name": "REGION2"}))
)
_write("dml_delete", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 100)", "regions", "nations", "customers")(lambda e: _then(e, "customers", lambda: e.table("customers").where("c_acctbal", "<", 100).delete()))
_write("dml_delete_join", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1", "regions", "nations", "customers")(
    lambda e: _then(e, "customers", lambda: e.table("customers c").join("nations n", "c.c_nationkey", "=", "n.n_nationkey").where("n.n_regionkey", 1).delete())
)
_write("dml_cascade", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3", "regions", "nations", "customers")(
    lambda e: _then(e, "customers", lambda: e.table("regions").where("r_regionkey", 3).delete())
)
_write("dml_cascade_update", "SELECT n_nationkey, n_name, CASE n_regionkey WHEN 3 THEN 33 ELSE n_regionkey END AS n_regionkey FROM nation", "regions", "nations", "customers")(
    lambda e: _then(e, "nations", lambda: e.table("regions").where("r_regionkey", 3).update({"r_regionkey": 33}))
)
_write("dml_truncate", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE 1 = 0", "regions", "nations")(lambda e: _then(e, "nations", lambda: e.table("nations").truncate()))
_write("dml_savepoint", "SELECT * FROM region WHERE r_regionkey <> 0", *_R)(
    lambda e: _then(
        e, "regions", e.begin, lambda: e.table("regions").where("r_regionkey", 0).delete(), lambda: e.savepoint("s"), lambda: e.table("regions").where("r_regionkey", ">", 1).delete(), lambda: e.roll_back_to("s"), e.commit)
)
_write("dml_rollback", "SELECT * FROM region", *_R)(lambda e: _then(e, "regions", e.begin, lambda: e.table("regions").delete(), e.roll_back))
_write("ddl_alter", "SELECT n_nationkey, n_name AS title, 'none' AS memo FROM nation", "regions", "nations")(lambda e: _then(e, "plain", lambda: _altered(e)))
_write("trigger_insert", "SELECT * FROM region UNION ALL SELECT 7, 'SEVEN!'", *_R)(
    lambda e: _then(e, "regions", lambda: e.create_trigger("regions", "before", "insert", lambda row: {**row, "r_name": row["r_name"] + "!"}), lambda: e.table("regions").insert({"r_regionkey": 7, "r_name": "SEVEN"}))
)


def _altered(e: Engine) -> None:
    def define(t):
        t.int("n_nationkey").primary_key()
        t.varchar("n_name", 25)
        t.int("n_regionkey")

    e.create_table("plain", define)
    e.table("plain").insert_select(e.table("nations").select("n_nationkey", "n_name", "n_regionkey"))

    def change(t):
        t.rename_column("n_name", "title")
        t.drop_column("n_regionkey")
        t.varchar("memo", 8).default("none")

    e.alter_table("plain", change)


FLAGSHIP_SQL = """SELECT n_name, round(sum(l_extendedprice), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'
    GROUP BY n_name HAVING sum(l_extendedprice) > 1000000 ORDER BY revenue DESC, n_name LIMIT 10"""


@query("flagship", FLAGSHIP_SQL)
def flagship(e: Engine):
    """Revenue and lines of each nation's BUILDING customers."""
    inner = (
        e.table("lineitem l").join("orders o", "l.l_orderkey", "=", "o.o_orderkey").join("customer c", "o.o_custkey", "=", "c.c_custkey").join("nation n", "c.c_nationkey", "=", "n.n_nationkey")
        .select(Agg.sum("l.l_extendedprice").as_("revenue"), Agg.count().as_("lines")).where("c.c_mktsegment", "BUILDING").group_by("n.n_name").having("revenue", ">", 1000000)
    )
    return e.table("lineitem").from_sub(inner, "t").select("t.n_name", Func.round(C("t.revenue"), 2).as_("revenue"), "t.lines").order_by_desc("revenue").order_by("n_name").limit(10)


from . import states as _states  # noqa: E402, F401 - registers queries on state and outcomes

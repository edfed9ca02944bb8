"""The fluent builder: each call returns a new query.

Names are in snake case; the camel-case spelling of every method works too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from ..errors import QueryError
from ..functions import Aggregate, Window
from . import ir

TABLE = re.compile(r"^\s*([A-Za-z_]\w*)(?:\s+(?:as\s+)?([A-Za-z_]\w*))?\s*$", re.I)
CAMEL = re.compile(r"(?<!^)([A-Z])")


def table_source(text: str) -> ir.TableSource:
    found = TABLE.match(text)
    if not found:
        raise QueryError(f"not a table reference: {text!r}")
    return ir.TableSource(found[1], found[2] or found[1])


class Query:
    """A query on an engine; terminal calls run it."""

    def __init__(self, engine, plan: ir.Select, ctes: dict[str, ir.Select] | None = None):
        self.engine, self.plan, self.ctes = engine, plan, ctes or {}

    def __getattr__(self, name: str):
        snake = CAMEL.sub(lambda m: "_" + m[1].lower(), name)
        if snake != name and not name.startswith("_") and hasattr(type(self), snake):
            return getattr(self, snake)
        raise AttributeError(name)

    def _new(self, **changes) -> Query:
        return type(self)(self.engine, self.plan.with_(**changes), self.ctes)

    # sources

    def from_sub(self, query: Query, alias: str) -> Query:
        return self._new(source=ir.QuerySource(ir.as_select(query), alias))

    def with_(self, name, query: Query | None = None) -> Query:
        """Common table expressions: a mapping, or one name and query; later ones may use earlier ones."""
        given = {name: query} if isinstance(name, str) else dict(name)
        return Query(self.engine, self.plan, {**self.ctes, **{k: ir.as_select(v) for k, v in given.items()}})

    def _cte(self, name: str, alias: str | None) -> ir.QuerySource:
        if name not in self.ctes:
            raise QueryError(f"no common table expression {name!r}")
        return ir.QuerySource(self.ctes[name], alias or name, name)

    def from_cte(self, name: str, alias: str | None = None) -> Query:
        return self._new(source=self._cte(name, alias))

    # projection

    def select(self, *items) -> Query:
        return self._new(items=(*self.plan.items, *items))

    def distinct(self) -> Query:
        return self._new(distinct=True)

    # predicates

    def _where(self, condition: ir.Condition, connector: str = "and") -> Query:
        return self._new(where=self.plan.where.add(condition, connector))

    def where(self, column: str, *rest) -> Query:
        return self._where(ir.comparison(column, *rest))

    and_where = where

    def or_where(self, column: str, *rest) -> Query:
        return self._where(ir.comparison(column, *rest), "or")

    def where_column(self, left: str, op: str, right: str) -> Query:
        return self._where(ir.ColumnComparison(left, ir.operator(op), right))

    def where_group(self, group: ir.ConditionGroup) -> Query:
        return self._where(group)

    def or_where_group(self, group: ir.ConditionGroup) -> Query:
        return self._where(group, "or")

    def where_in(self, column: str, values) -> Query:
        return self._where(ir.in_condition(column, values, False))

    def where_not_in(self, column: str, values) -> Query:
        return self._where(ir.in_condition(column, values, True))

    def where_between(self, column: str, low, high) -> Query:
        return self._where(ir.Between(column, low, high))

    def where_null(self, column: str) -> Query:
        return self._where(ir.IsNull(column))

    def where_not_null(self, column: str) -> Query:
        return self._where(ir.IsNull(column, True))

    def where_like(self, column: str, pattern: str) -> Query:
        return self._where(ir.LikePattern(column, pattern))

    def where_exists(self, query: Query) -> Query:
        return self._where(ir.Exists(ir.as_select(query)))

    def where_not_exists(self, query: Query) -> Query:
        return self._where(ir.Exists(ir.as_select(query), True))

    def or_where_exists(self, query: Query) -> Query:
        return self._where(ir.Exists(ir.as_select(query)), "or")

    def or_where_not_exists(self, query: Query) -> Query:
        return self._where(ir.Exists(ir.as_select(query), True), "or")

    def where_scalar(self, column: str, op: str, query: Query) -> Query:
        return self._where(ir.ScalarComparison(column, ir.operator(op), ir.as_select(query)))

    def or_where_scalar(self, column: str, op: str, query: Query) -> Query:
        return self._where(ir.ScalarComparison(column, ir.operator(op), ir.as_select(query)), "or")

    # joins

    def _join(self, kind: str, source, on: ir.ConditionGroup) -> Query:
        source = table_source(source) if isinstance(source, str) else source
        return self._new(joins=(*self.plan.joins, ir.Join(kind, source, on)))

    def _join_one(self, kind: str, source, left: str, op: str, right: str) -> Query:
        return self._join(kind, source, ir.ConditionGroup().where_column(left, op, right))

    def join(self, table: str, left: str, op: str, right: str) -> Query:
        return self._join_one("inner", table, left, op, right)

    def left_join(self, table: str, left: str, op: str, right: str) -> Query:
        return self._join_one("left", table, left, op, right)

    def right_join(self, table: str, left: str, op: str, right: str) -> Query:
        return self._join_one("right", table, left, op, right)

    def join_on(self, table: str, on: ir.ConditionGroup) -> Query:
        return self._join("inner", table, on)

    def left_join_on(self, table: str, on: ir.ConditionGroup) -> Query:
        return self._join("left", table, on)

    def right_join_on(self, table: str, on: ir.ConditionGroup) -> Query:
        return self._join("right", table, on)

    def _using(self, kind: str, table: str, columns) -> Query:
        source, left = table_source(table), self.plan.sources()[-1].alias
        names = [columns] if isinstance(columns, str) else list(columns)
        if not names:
            raise QueryError("USING takes a column")
        on = ir.ConditionGroup()
        for c in names:
            on = on.where_column(f"{left}.{c}", "=", f"{source.alias}.{c}")
        return self._join(kind, source, on)

    def join_using(self, table: str, columns) -> Query:
        return self._using("inner", table, columns)

    def left_join_using(self, table: str, columns) -> Query:
        return self._using("left", table, columns)

    def right_join_using(self, table: str, columns) -> Query:
        return self._using("right", table, columns)

    def join_cte(self, name: str, left: str, op: str, right: str, alias: str | None = None) -> Query:
        return self._join_one("inner", self._cte(name, alias), left, op, right)

    def left_join_cte(self, name: str, left: str, op: str, right: str, alias: str | None = None) -> Query:
        return self._join_one("left", self._cte(name, alias), left, op, right)

    def right_join_cte(self, name: str, left: str, op: str, right: str, alias: str | None = None) -> Query:
        return self._join_one("right", self._cte(name, alias), left, op, right)

    # groups, order, paging, sets

    def group_by(self, *columns: str) -> Query:
        return self._new(group_by=(*self.plan.group_by, *columns))

    def having(self, column: str, *rest) -> Query:
        c = ir.comparison(column, *rest)
        if not isinstance(c, ir.Comparison):
            raise QueryError("HAVING takes a comparison")
        return self._new(having=(c.column, c.op, c.value))

    def order_by(self, column: str, direction: str = "ASC") -> Query:
        if str(direction).upper() not in ("ASC", "DESC"):
            raise QueryError(f"unknown direction {direction!r}")
        return self._new(order_by=(*self.plan.order_by, (column, str(direction).upper() == "DESC")))

    def order_by_desc(self, column: str) -> Query:
        return self.order_by(column, "DESC")

    def _count_of(self, n: Any, what: str) -> int:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise QueryError(f"{what} takes a whole number of at least 0")
        return n

    def limit(self, n: int, offset: int | None = None) -> Query:
        q = self._new(limit=self._count_of(n, "LIMIT"))
        return q if offset is None else q.offset(offset)

    def offset(self, n: int) -> Query:
        return self._new(offset=self._count_of(n, "OFFSET"))

    def union(self, query: Query) -> Query:
        return self._new(unions=(*self.plan.unions, ir.Union(ir.as_select(query), False)))

    def union_all(self, query: Query) -> Query:
        return self._new(unions=(*self.plan.unions, ir.Union(ir.as_select(query), True)))

    # terminal calls

    def df(self):
        """The query as a DataFrame; nothing is run."""
        return self.engine.compile(self.plan)

    def get(self):
        from ..result import ResultSet

        return ResultSet(self.df())

    def first(self) -> dict | None:
        return self._new(limit=1 if self.plan.limit is None else min(1, self.plan.limit)).get().first()

    def cursor(self) -> Iterator[dict]:
        """Rows one by one; partitions are fetched as they are needed."""
        return iter(self.get())

    def chunk(self, size: int, handler: Callable[[list[dict], int], Any]) -> int:
        """Calls ``handler(rows, number)`` for each ``size`` rows until it returns False; the number of rows handled."""
        if self._count_of(size, "chunk") < 1:
            raise QueryError("chunk takes a size of at least 1")
        done, number, rows = 0, 0, []
        for row in self.cursor():
            rows.append(row)
            if len(rows) == size:
                number, done = number + 1, done + size
                if handler(rows, number) is False:
                    return done
                rows = []
        if rows:
            done += len(rows)
            handler(rows, number + 1)
        return done

    def _aggregate(self, func: str, column: str):
        plan = self.plan
        if plan.group_by or plan.unions or plan.distinct or plan.limit is not None or plan.offset or any(isinstance(i, (Aggregate, Window)) for i in plan.items):
            plan = ir.Select(ir.QuerySource(plan, "t"))
            column = column if column == "*" else column.rpartition(".")[2]
        plan = plan.with_(items=(Aggregate(func, column, "value"),), order_by=())
        return self.engine.compile(plan).first()[0]

    def count(self, column: str = "*") -> int:
        return self._aggregate("COUNT", column)

    def sum(self, column: str):
        return self._aggregate("SUM", column)

    def avg(self, column: str):
        return self._aggregate("AVG", column)

    def min(self, column: str):
        return self._aggregate("MIN", column)

    def max(self, column: str):
        return self._aggregate("MAX", column)

    def explain(self) -> list[dict]:
        from .explain import steps

        return steps(self.engine, self.plan)

    # writes

    def update(self, values: dict) -> int:
        return self.engine.writer.update(self.plan, values)

    def delete(self) -> int:
        return self.engine.writer.delete(self.plan)


class Table(Query):
    """A table: the start of queries, and its own writes."""

    def _new(self, **changes) -> Query:
        return Query(self.engine, self.plan.with_(**changes), self.ctes)

    @property
    def name(self) -> str:
        return self.plan.source.name

    def find(self, key) -> dict | None:
        columns = self.engine.table_schema(self.name).primary_columns()
        if len(columns) != 1:
            raise QueryError("find takes a table with a primary key of one column")
        return self.where(columns[0], key).first()

    def insert(self, row: dict):
        return self.engine.writer.insert(self.name, [row])

    def insert_many(self, rows: Iterable[dict]):
        return self.engine.writer.insert(self.name, list(rows))

    def insert_ignore(self, row: dict) -> int:
        return self.engine.writer.insert_ignore(self.name, row)

    def upsert(self, row: dict) -> int:
        return self.engine.writer.upsert(self.name, row)

    def replace(self, row: dict) -> int:
        return self.engine.writer.replace(self.name, row)

    def replace_many(self, rows: Iterable[dict]) -> int:
        return sum(self.replace(r) for r in rows)

    def insert_select(self, query: Query) -> int:
        return self.engine.writer.insert_select(self.name, ir.as_select(query))

    def truncate(self) -> None:
        self.engine.writer.truncate(self.name)

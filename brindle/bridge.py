"""An adapter from option dicts, as object mappers build them, to the builder.

``where`` is a list of (column, operator, value) triples, of (connector, triples)
groups, or a dict of equalities.  What has no counterpart raises.
"""

from __future__ import annotations

from typing import Any

from .engine import Engine
from .errors import QueryError
from .plans.builder import Query
from .plans.ir import ConditionGroup

_AGGREGATES = ("count", "sum", "avg", "min", "max")


class Mapper:
    def __init__(self, engine: Engine):
        self.engine = engine

    # translation

    def _group(self, conditions) -> ConditionGroup:
        group = ConditionGroup()
        items = [(c, "=", v) for c, v in conditions.items()] if isinstance(conditions, dict) else list(conditions)
        for item in items:
            if len(item) == 2 and str(item[0]).lower() in ("and", "or"):
                inner = self._group(item[1])
                group = group.where_group(inner) if item[0].lower() == "and" else group.or_where_group(inner)
                continue
            column, op, value = item if len(item) == 3 else (item[0], "=", item[1])
            group = self._condition(group, column, str(op).lower().strip(), value)
        return group

    def _condition(self, group: ConditionGroup, column: str, op: str, value: Any) -> ConditionGroup:
        if op in ("=", "!=", "<>", "<", "<=", ">", ">="):
            return group.where(column, op, value)
        simple = {
            "in": lambda: group.where_in(column, value), "not in": lambda: group.where_not_in(column, value), "like": lambda: group.where_like(column, value),
            "between": lambda: group.where_between(column, *value), "null": lambda: group.where_null(column), "not null": lambda: group.where_not_null(column),
        }
        if op not in simple:
            raise QueryError(f"not supported: {op}")
        return simple[op]()

    def query(self, options: dict) -> Query:
        """The builder's query for ``options``: table, where, field, join, group, order, limit, page, distinct."""
        known = {"table", "alias", "where", "field", "join", "group", "order", "limit", "page", "distinct"}
        if extra := set(options) - known:
            raise QueryError(f"not supported: {sorted(extra)[0]}")
        alias = options.get("alias")
        q: Query = self.engine.table(options["table"] + (f" as {alias}" if alias else ""))
        for kind, table, left, op, right in options.get("join", ()):
            q = {"inner": q.join, "left": q.left_join, "right": q.right_join}[kind.lower()](table, left, op, right)
        if options.get("where"):
            q = q.where_group(self._group(options["where"]))
        if fields := options.get("field"):
            q = q.select(*([f.strip() for f in fields.split(",")] if isinstance(fields, str) else fields))
        if groups := options.get("group"):
            q = q.group_by(*([groups] if isinstance(groups, str) else groups))
        if options.get("distinct"):
            q = q.distinct()
        order = options.get("order") or {}
        for column, direction in order.items() if isinstance(order, dict) else [(c, "ASC") for c in order]:
            q = q.order_by(column, direction)
        if "page" in options:
            page, size = options["page"]
            return q.limit(size).offset((page - 1) * size)
        if (limit := options.get("limit")) is not None:
            q = q.limit(limit) if isinstance(limit, int) else q.limit(limit[1]).offset(limit[0])
        return q

    # calls

    def find(self, options: dict) -> dict | None:
        return self.query(options).first()

    def select(self, options: dict) -> list[dict]:
        return self.query(options).get().rows()

    def value(self, options: dict, column: str, default: Any = None) -> Any:
        row = self.query({**options, "field": [column]}).first()
        return default if row is None else row[column.rpartition(".")[2]]

    def column(self, options: dict, column: str, key: str | None = None) -> list | dict:
        rows = self.query({**options, "field": [column, *([key] if key and key != column else [])]}).get().rows()
        name = column.rpartition(".")[2]
        return [r[name] for r in rows] if key is None else {r[key.rpartition(".")[2]]: r[name] for r in rows}

    def aggregate(self, options: dict, func: str, column: str = "*") -> Any:
        if func.lower() not in _AGGREGATES:
            raise QueryError(f"not supported: {func}")
        return getattr(self.query(options), func.lower())(column)

    def insert(self, table: str, row: dict, get_id: bool = False) -> int | None:
        made = self.engine.table(table).insert(row)
        return made.last_insert_id if get_id else made.row_count

    def insert_all(self, table: str, rows: list[dict]) -> int:
        return self.engine.table(table).insert_many(rows).row_count

    def insert_all_by_keys(self, table: str, keys: list[str], rows: list[list]) -> int:
        return self.insert_all(table, [dict(zip(keys, r)) for r in rows])

    def update(self, options: dict, values: dict) -> int:
        return self.query(options).update(values)

    def delete(self, options: dict) -> int:
        return self.query(options).delete()

    def transaction(self, run) -> Any:
        """Runs ``run(mapper)``; within a transaction it is a savepoint."""
        if not self.engine.in_transaction():
            return self.engine.transaction(lambda _: run(self))
        name = f"nested_{len(self.engine._savepoints)}"
        self.engine.savepoint(name)
        try:
            return run(self)
        except Exception:
            self.engine.roll_back_to(name)
            raise

    def fields(self, table: str) -> dict[str, str]:
        return {c.name: c.type for c in self.engine.table_schema(table).columns}

    def select_insert(self, *_: Any) -> None:
        raise QueryError("not supported: select insert")

    def sql(self, *_: Any) -> None:
        raise QueryError("not supported: SQL text")

"""Migration: the steps that turn one database's tables into another's."""

from __future__ import annotations

from .engine import Engine
from .schema import Blueprint, ColumnDefinition, TableSchema


def diff(target: Engine, current: Engine) -> list[dict]:
    """Steps in order: tables to create, to change, to drop."""
    wanted, there = target.tables(), current.tables()
    plan = [{"op": "createTable", "name": t, "schema": target.table_schema(t)} for t in wanted if t not in there]
    for t in wanted:
        if t in there:
            plan += diff_table(target.table_schema(t), current.table_schema(t))
    return plan + [{"op": "dropTable", "name": t} for t in there if t not in wanted]


def diff_table(target: TableSchema, current: TableSchema) -> list[dict]:
    new, old = ({c.name: c for c in s.columns} for s in (target, current))
    steps = [{"op": "addColumn", "table": target.name, "column": c} for n, c in new.items() if n not in old]
    steps += [{"op": "dropColumn", "table": target.name, "name": n} for n in old if n not in new]
    steps += [{"op": "modifyColumn", "table": target.name, "column": c, "from": old[n]} for n, c in new.items() if n in old and old[n] != c]
    a, b = ({i.name: i for i in s.indexes} for s in (target, current))
    steps += [{"op": "dropIndex", "table": target.name, "name": n} for n in b if a.get(n) != b[n]]
    steps += [{"op": "createIndex", "table": target.name, "index": i} for n, i in a.items() if b.get(n) != i]
    for what in ("primary", "uniques", "foreign_keys", "checks"):
        if getattr(target, what) != getattr(current, what):
            steps.append({"op": "note", "table": target.name, "detail": f"{what} differ and are not changed"})
    return steps


def _define(s: TableSchema):
    def define(t: Blueprint) -> None:
        t.columns = [ColumnDefinition(c) for c in s.columns]
        t.build = lambda: s  # type: ignore[method-assign]

    return define


def apply(engine: Engine, plan: list[dict]) -> list[dict]:
    """Runs the steps; those that need a decision (modifyColumn, note) are returned."""
    left = []
    for step in plan:
        op = step["op"]
        if op == "createTable":
            engine.create_table(step["name"], _define(step["schema"]))
        elif op == "dropTable":
            engine.drop_table(step["name"])
        elif op == "addColumn":
            engine.alter_table(step["table"], lambda t, c=step["column"]: t.columns.append(ColumnDefinition(c)))
        elif op == "dropColumn":
            engine.alter_table(step["table"], lambda t, n=step["name"]: t.drop_column(n))
        elif op == "createIndex":
            engine.create_index(step["table"], step["index"].name, *step["index"].columns)
        elif op == "dropIndex":
            engine.drop_index(step["table"], step["name"])
        else:
            left.append(step)
    return left

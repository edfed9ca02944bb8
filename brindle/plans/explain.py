"""EXPLAIN: the steps of a logical plan, without running it."""

from __future__ import annotations

from ..functions import Aggregate, Window
from . import ir


def _scan(engine, plan: ir.Select) -> dict:
    s = plan.source
    if isinstance(s, ir.QuerySource):
        return {"step": "DERIVED", "alias": s.alias, "steps": steps(engine, s.query)}
    schema = engine.schema_of(s.name)
    via = "FULL SCAN"
    flat = all(k == "and" and isinstance(c, ir.Comparison) and c.op == "=" and c.value is not None for k, c in plan.where.items)
    if schema and flat and plan.where.items and not plan.joins:
        used = [c.column.rpartition(".")[2] for _, c in plan.where.items]
        if not any(schema.column(c).ci for c in used if schema.has_column(c)):
            for name, columns in schema.access_paths():
                if sorted(columns) == sorted(used):
                    via = f"INDEX {name} (equality, pushed to the Parquet scan)"
                    break
    return {"step": "SCAN", "table": s.name, "via": via, "estRows": engine.stored_rows(s.name)}


def steps(engine, plan: ir.Select) -> list[dict]:
    out = [_scan(engine, plan)]
    for j in plan.joins:
        equal = [c for k, c in j.on.items if k == "and" and isinstance(c, ir.ColumnComparison) and c.op == "="]
        hashed = equal and not any(k == "or" for k, _ in j.on.items[1:])
        out.append({"step": "JOIN", "kind": j.kind.upper(), "table": j.source.name, "alias": j.source.alias, "type": "HASH" if hashed else "NESTED LOOP"})
    if n := len(ir.subqueries(plan)):
        out.append({"step": "SUBQUERY", "count": n})
    functions = [i.output for i in plan.items if isinstance(i, Aggregate)]
    if plan.group_by or functions:
        out.append({"step": "AGGREGATE", "groupBy": list(plan.group_by), "funcs": functions})
    for w in plan.items:
        if isinstance(w, Window):
            out.append({"step": "WINDOW", "func": w.func, "partitionBy": list(w.partition), "orderBy": [(c, "DESC" if d else "ASC") for c, d in w.order]})
    for i, u in enumerate(plan.unions):
        out.append({"step": "UNION", "type": "UNION ALL" if u.all else "UNION", "order": i + 1})
    if plan.distinct:
        out.append({"step": "DISTINCT"})
    if plan.order_by:
        out.append({"step": "SORT", "keys": [(c, "DESC" if d else "ASC") for c, d in plan.order_by]})
    if plan.limit is not None or plan.offset:
        out.append({"step": "LIMIT", "limit": plan.limit, "offset": plan.offset})
    return out

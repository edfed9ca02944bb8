"""Plans as JSON values, for stored views and checks."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import fields, is_dataclass, replace
from typing import Any

from ..errors import QueryError
from ..functions import Aggregate, Expression, Window
from . import ir

KINDS = {c.__name__: c for c in (ir.Comparison, ir.ColumnComparison, ir.InList, ir.InQuery, ir.Between, ir.IsNull, ir.LikePattern, ir.Exists, ir.ScalarComparison, ir.Constant, ir.ConditionGroup, ir.TableSource, ir.QuerySource, ir.Join, ir.Union, ir.Select, Aggregate)}


def to_dict(value: Any) -> Any:
    if is_dataclass(value) and type(value).__name__ in KINDS:
        return {"is": type(value).__name__, **{f.name: to_dict(getattr(value, f.name)) for f in fields(value)}}
    if isinstance(value, (list, tuple)):
        return [to_dict(v) for v in value]
    if isinstance(value, (decimal.Decimal, datetime.date)):
        return {"is": type(value).__name__, "value": str(value)}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise QueryError(f"cannot be stored: {type(value).__name__}")


def from_dict(value: Any) -> Any:
    if isinstance(value, list):
        return tuple(from_dict(v) for v in value)
    if not isinstance(value, dict):
        return value
    kind = value["is"]
    if kind == "Decimal":
        return decimal.Decimal(value["value"])
    if kind in ("date", "datetime"):
        return getattr(datetime, kind).fromisoformat(value["value"])
    return KINDS[kind](**{k: from_dict(v) for k, v in value.items() if k != "is"})


def storable_view(plan: ir.Select) -> None:
    """Raises unless the plan may be a view: no expressions, windows, derived or common tables, or subqueries."""
    if any(isinstance(i, (Expression, Window)) for i in plan.items):
        raise QueryError("a view has no expressions and no windows")
    if any(isinstance(s, ir.QuerySource) for s in plan.sources()):
        raise QueryError("a view reads tables only")
    if ir.subqueries(plan):
        raise QueryError("a view has no subqueries")
    for u in plan.unions:
        storable_view(u.query)


def columns_of(condition: ir.Condition) -> set[str]:
    found: set[str] = set()
    for c in ir.conditions(condition):
        found |= {getattr(c, a) for a in ("column", "left", "right") if hasattr(c, a)}
    return {n.rpartition(".")[2] for n in found}


def rename(condition: ir.Condition, old: str, new: str) -> ir.Condition:
    if isinstance(condition, ir.ConditionGroup):
        return ir.ConditionGroup(tuple((k, rename(c, old, new)) for k, c in condition.items))
    changes = {a: new for a in ("column", "left", "right") if getattr(condition, a, None) == old}
    return replace(condition, **changes)

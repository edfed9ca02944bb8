"""The logical plan: what a query asks for, before any name is resolved.

All values are immutable; the builder copies on write.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import QueryError

OPERATORS = ("=", "!=", "<>", "<", "<=", ">", ">=")


def operator(op: str) -> str:
    op = op.strip().lower() if isinstance(op, str) else op
    if op not in (*OPERATORS, "like"):
        raise QueryError(f"unknown operator {op!r}")
    return "!=" if op == "<>" else op


class Condition:
    """A predicate."""


@dataclass(frozen=True)
class Comparison(Condition):
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class ColumnComparison(Condition):
    left: str
    op: str
    right: str


@dataclass(frozen=True)
class InList(Condition):
    column: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Condition):
    column: str
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Between(Condition):
    column: str
    low: Any
    high: Any
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Condition):
    column: str
    negated: bool = False


@dataclass(frozen=True)
class LikePattern(Condition):
    column: str
    pattern: str


@dataclass(frozen=True)
class Exists(Condition):
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class ScalarComparison(Condition):
    column: str
    op: str
    query: Select


@dataclass(frozen=True)
class Constant(Condition):
    value: bool


@dataclass(frozen=True)
class ConditionGroup(Condition):
    """Conditions folded strictly from left to right; the first connector is ignored, an empty group is true."""

    items: tuple[tuple[str, Condition], ...] = ()

    def add(self, condition: Condition, connector: str = "and") -> ConditionGroup:
        return ConditionGroup((*self.items, (connector, condition)))

    def where(self, column: str, *rest) -> ConditionGroup:
        return self.add(comparison(column, *rest))

    and_where = where

    def or_where(self, column: str, *rest) -> ConditionGroup:
        return self.add(comparison(column, *rest), "or")

    def where_column(self, left: str, op: str, right: str) -> ConditionGroup:
        return self.add(ColumnComparison(left, operator(op), right))

    def or_where_column(self, left: str, op: str, right: str) -> ConditionGroup:
        return self.add(ColumnComparison(left, operator(op), right), "or")

    def where_in(self, column: str, values: Iterable) -> ConditionGroup:
        return self.add(in_condition(column, values, False))

    def where_not_in(self, column: str, values: Iterable) -> ConditionGroup:
        return self.add(in_condition(column, values, True))

    def where_between(self, column: str, low, high) -> ConditionGroup:
        return self.add(Between(column, low, high))

    def where_not_between(self, column: str, low, high) -> ConditionGroup:
        return self.add(Between(column, low, high, True))

    def where_null(self, column: str) -> ConditionGroup:
        return self.add(IsNull(column))

    def where_not_null(self, column: str) -> ConditionGroup:
        return self.add(IsNull(column, True))

    def where_like(self, column: str, pattern: str) -> ConditionGroup:
        return self.add(LikePattern(column, pattern))

    def or_where_like(self, column: str, pattern: str) -> ConditionGroup:
        return self.add(LikePattern(column, pattern), "or")

    def where_group(self, group: ConditionGroup) -> ConditionGroup:
        return self.add(group)

    def or_where_group(self, group: ConditionGroup) -> ConditionGroup:
        return self.add(group, "or")


def as_select(query) -> Select:
    return query if isinstance(query, Select) else query.plan


def in_condition(column: str, values, negated: bool) -> Condition:
    if isinstance(values, Select) or hasattr(values, "plan"):
        return InQuery(column, as_select(values), negated)
    if isinstance(values, (str, bytes)):
        raise QueryError("IN takes a list of values or a query")
    return InList(column, tuple(values), negated)


def comparison(column: str, *rest) -> Condition:
    if len(rest) == 1:
        return Comparison(column, "=", rest[0])
    if len(rest) != 2:
        raise QueryError("a comparison takes (column, value) or (column, operator, value)")
    op = operator(rest[0])
    return LikePattern(column, rest[1]) if op == "like" else Comparison(column, op, rest[1])


@dataclass(frozen=True)
class TableSource:
    name: str
    alias: str


@dataclass(frozen=True)
class QuerySource:
    query: Select
    alias: str
    #: Name of the common table expression it was taken from.
    cte: str | None = None

    @property
    def name(self) -> str:
        return self.cte or self.alias


@dataclass(frozen=True)
class Join:
    kind: str
    source: TableSource | QuerySource
    on: ConditionGroup


@dataclass(frozen=True)
class Union:
    query: Select
    all: bool


@dataclass(frozen=True)
class Select:
    source: TableSource | QuerySource
    items: tuple = ()
    joins: tuple[Join, ...] = ()
    where: ConditionGroup = field(default_factory=ConditionGroup)
    group_by: tuple[str, ...] = ()
    having: tuple[str, str, Any] | None = None
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    unions: tuple[Union, ...] = ()

    def sources(self) -> list[TableSource | QuerySource]:
        return [self.source, *(j.source for j in self.joins)]

    def with_(self, **changes) -> Select:
        return replace(self, **changes)


def conditions(group: Condition) -> Iterable[Condition]:
    """All conditions of a tree but the groups themselves."""
    if isinstance(group, ConditionGroup):
        for _, item in group.items:
            yield from conditions(item)
    else:
        yield group


def subqueries(select: Select) -> list[Select]:
    groups = [select.where, *(j.on for j in select.joins)]
    return [c.query for g in groups for c in conditions(g) if isinstance(c, (InQuery, Exists, ScalarComparison))]


def table_names(select: Select) -> set[str]:
    """Names of all tables that a query reads."""
    found: set[str] = set()
    for s in select.sources():
        found |= {s.name} if isinstance(s, TableSource) else table_names(s.query)
    for q in [*subqueries(select), *(u.query for u in select.unions)]:
        found |= table_names(q)
    return found

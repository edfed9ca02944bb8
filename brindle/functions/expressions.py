"""Immutable expressions and how each becomes a Spark column.

Arguments that are plain values are literals; ``Func.col`` refers to a column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans.ir import Comparison, comparison

#: White space that TRIM removes (fixed value).
TRIMMED = " \t\n\r\0\x0b"


class Expression:
    """A computed column.  Own classes need ``alias``, ``default_name`` and ``column(resolve)``.

    ``resolve(name)`` gives the Spark column of a name; ``column`` may use any
    Spark function, Pandas UDFs included.
    """

    alias: str | None = None

    def default_name(self) -> str:
        raise NotImplementedError

    def column(self, resolve) -> Column:
        raise NotImplementedError

    @property
    def output(self) -> str:
        return self.alias or self.default_name()

    def as_(self, alias: str):
        return replace(self, alias=alias)  # type: ignore[type-var]

    def references(self) -> list[str]:
        return []


def to_column(value: Any, resolve) -> Column:
    if isinstance(value, Expression):
        return value.column(resolve)
    return F.lit(value)


def names_in(values) -> list[str]:
    return [n for v in values if isinstance(v, Expression) for n in v.references()]


@dataclass(frozen=True)
class ColumnRef(Expression):
    name: str
    alias: str | None = None

    def default_name(self) -> str:
        return self.name.rpartition(".")[2]

    def column(self, resolve) -> Column:
        return resolve(self.name)

    def references(self) -> list[str]:
        return [self.name]


def _number(value: Any, resolve, name: str) -> Column:
    """A numeric argument; text that is no number is an error where it is met."""
    if isinstance(value, bool) or (value is not None and not isinstance(value, (int, float, str, Expression)) and not hasattr(value, "as_tuple")):
        raise QueryError(f"{name} takes a number")
    c = to_column(value, resolve)
    return F.when(c.isNotNull() & c.cast("string").try_cast("double").isNull(), F.raise_error(F.lit(f"{name} takes a number")).cast("double")).otherwise(c.cast("string").try_cast("double")) if isinstance(value, str) else c


def _date(value: Any, resolve, name: str) -> Column:
    c = to_column(value, resolve).cast("string")
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d+)?)?$")
    day = F.substring(c, 1, 10).try_cast("date")
    return F.when(c.isNull(), F.lit(None).cast("date")).when(shape & day.isNotNull(), day).otherwise(F.raise_error(F.lit(f"{name} takes a date")).cast("date"))


def _text(value: Any, resolve) -> Column:
    if isinstance(value, bool):
        return F.lit("1" if value else "0")
    return to_column(value, resolve).cast("string")


@dataclass(frozen=True)
class Call(Expression):
    name: str
    args: tuple
    alias: str | None = None

    def default_name(self) -> str:
        shown = ", ".join(a.output if isinstance(a, Expression) else str(a) for a in self.args)
        return f"{self.name}({shown})"

    def references(self) -> list[str]:
        return names_in(self.args)

    def column(self, resolve) -> Column:
        return getattr(self, "_" + self.name.lower())(resolve, *self.args)

    def _upper(self, r, x):
        return F.upper(_text(x, r))

    def _lower(self, r, x):
        return F.lower(_text(x, r))

    def _length(self, r, x):
        return F.char_length(_text(x, r))

    def _trim(self, r, x):
        return F.btrim(_text(x, r), F.lit(TRIMMED))

    def _ltrim(self, r, x):
        return F.ltrim(_text(x, r), F.lit(TRIMMED))

    def _rtrim(self, r, x):
        return F.rtrim(_text(x, r), F.lit(TRIMMED))

    def _substr(self, r, x, pos, size=None):
        text = _text(x, r)
        args = [] if size is None else [("length", size, 0)]
        for what, value, least in [("position", pos, 1), *args]:
            if not isinstance(value, Expression) and (not isinstance(value, int) or value < least):
                raise QueryError(f"SUBSTR takes a {what} of at least {least}")
        start = to_column(pos, r).cast("int")
        if isinstance(pos, Expression):
            start = F.when(start < 1, F.raise_error(F.lit("SUBSTR takes a position of at least 1")).cast("int")).otherwise(start)
        return F.substr(text, start) if size is None else F.substr(text, start, to_column(size, r).cast("int"))

    def _concat(self, r, *xs):
        return F.concat(*[_text(x, r) for x in xs])

    def _replace(self, r, x, search, new):
        return F.replace(_text(x, r), _text(search, r), _text(new, r))

    def _abs(self, r, x):
        return F.abs(_number(x, r, "ABS"))

    def _round(self, r, x, digits=0):
        if not isinstance(digits, int):
            raise QueryError("ROUND takes a whole number of digits")
        return F.round(_number(x, r, "ROUND").cast("double"), digits)

    def _floor(self, r, x):
        return F.floor(_number(x, r, "FLOOR").cast("double")).cast("double")

    def _ceil(self, r, x):
        return F.ceil(_number(x, r, "CEIL").cast("double")).cast("double")

    def _year(self, r, x):
        return F.year(_date(x, r, "YEAR"))

    def _month(self, r, x):
        return F.month(_date(x, r, "MONTH"))

    def _day(self, r, x):
        return F.dayofmonth(_date(x, r, "DAY"))

    def _coalesce(self, r, *xs):
        return F.coalesce(*[to_column(x, r) for x in xs])

    def _nullif(self, r, a, b):
        from ..operators.predicates import compare, loosely_equal

        left = to_column(a, r)
        if isinstance(a, ColumnRef) and not isinstance(b, Expression):
            same = compare(left, r.kind(a.name), "=", b)
        else:
            same = loosely_equal(left, to_column(b, r))
        return F.when(same, F.lit(None)).otherwise(left)


@dataclass(frozen=True)
class Case(Expression):
    """CASE WHEN: comparisons in order, the first that holds gives the value."""

    branches: tuple[tuple[Comparison, Any], ...] = ()
    default: Any = None
    pending: Comparison | None = None
    alias: str | None = None

    def when(self, column: str, *rest) -> Case:
        if self.pending is not None:
            raise QueryError("WHEN without THEN")
        return replace(self, pending=comparison(column, *rest))

    def then(self, value: Any) -> Case:
        if self.pending is None:
            raise QueryError("THEN without WHEN")
        return replace(self, branches=(*self.branches, (self.pending, value)), pending=None)

    def else_(self, value: Any) -> Case:
        return replace(self, default=value)

    def default_name(self) -> str:
        return "CASE"

    def references(self) -> list[str]:
        return [c.column for c, _ in self.branches] + names_in([v for _, v in self.branches] + [self.default])

    def column(self, resolve) -> Column:
        from ..operators.predicates import compare

        if not self.branches or self.pending is not None:
            raise QueryError("CASE takes WHEN and THEN in pairs")
        out = None
        for c, value in self.branches:
            test, value = compare(resolve(c.column), resolve.kind(c.column), c.op, c.value), to_column(value, resolve)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(to_column(self.default, resolve))


class CaseWhen:
    @staticmethod
    def make() -> Case:
        return Case()


@dataclass(frozen=True)
class Window:
    func: str
    argument: str | None = None
    partition: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    alias: str | None = None

    def partition_by(self, *columns: str) -> Window:
        return replace(self, partition=(*self.partition, *columns))

    def order_by(self, column: str, direction: str = "ASC") -> Window:
        return replace(self, order=(*self.order, (column, str(direction).upper() == "DESC")))

    def order_by_desc(self, column: str) -> Window:
        return self.order_by(column, "DESC")

    def as_(self, alias: str) -> Window:
        return replace(self, alias=alias)

    @property
    def output(self) -> str:
        return self.alias or self.func

    @property
    def ranks(self) -> bool:
        return self.func in ("ROW_NUMBER", "RANK", "DENSE_RANK")


@dataclass(frozen=True)
class Aggregate:
    func: str
    argument: str
    alias: str | None = None

    def as_(self, alias: str) -> Aggregate:
        return replace(self, alias=alias)

    def over(self) -> Window:
        return Window(self.func, self.argument)

    @property
    def output(self) -> str:
        return self.alias or f"{self.func}({self.argument})"

    def column(self, resolve) -> Column:
        return aggregate_column(self.func, self.argument, resolve)


def aggregate_column(func: str, argument: str, resolve) -> Column:
    if func == "COUNT":
        return F.count(F.lit(1)) if argument == "*" else F.count(resolve(argument))
    c, kind = resolve(argument), resolve.kind(argument)
    if func in ("SUM", "AVG"):
        if isinstance(kind, T.StringType):
            c = F.when(c.isNotNull() & c.try_cast("double").isNull(), F.raise_error(F.lit(f"{func} takes numbers")).cast("double")).otherwise(c.try_cast("double"))
        return F.sum(c) if func == "SUM" else F.avg(c)
    return F.min(c) if func == "MIN" else F.max(c)


class Agg:
    """Aggregates of a column; COUNT also of ``*``."""

    @staticmethod
    def count(column: str = "*") -> Aggregate:
        return Aggregate("COUNT", column)

    @staticmethod
    def sum(column: str) -> Aggregate:
        return Aggregate("SUM", column)

    @staticmethod
    def avg(column: str) -> Aggregate:
        return Aggregate("AVG", column)

    @staticmethod
    def min(column: str) -> Aggregate:
        return Aggregate("MIN", column)

    @staticmethod
    def max(column: str) -> Aggregate:
        return Aggregate("MAX", column)


def _call(name: str, least: int, most: int | None):
    def make(*args) -> Call:
        if len(args) < least or (most is not None and len(args) > most):
            raise QueryError(f"{name} takes {least}" + ("" if most == least else f" to {most}" if most else " or more") + " arguments")
        return Call(name, args)

    return staticmethod(make)


class Func:
    """Scalar functions and ranking windows."""

    upper, lower, length = _call("UPPER", 1, 1), _call("LOWER", 1, 1), _call("LENGTH", 1, 1)
    trim, ltrim, rtrim = _call("TRIM", 1, 1), _call("LTRIM", 1, 1), _call("RTRIM", 1, 1)
    substr, concat, replace = _call("SUBSTR", 2, 3), _call("CONCAT", 1, None), _call("REPLACE", 3, 3)
    abs, round = _call("ABS", 1, 1), _call("ROUND", 1, 2)
    floor, ceil = _call("FLOOR", 1, 1), _call("CEIL", 1, 1)
    year, month, day = _call("YEAR", 1, 1), _call("MONTH", 1, 1), _call("DAY", 1, 1)
    coalesce, nullif = _call("COALESCE", 1, None), _call("NULLIF", 2, 2)

    @staticmethod
    def col(name: str) -> ColumnRef:
        return ColumnRef(name)

    @staticmethod
    def row_number() -> Window:
        return Window("ROW_NUMBER")

    @staticmethod
    def rank() -> Window:
        return Window("RANK")

    @staticmethod
    def dense_rank() -> Window:
        return Window("DENSE_RANK")


class Like:
    @staticmethod
    def escape(text: str) -> str:
        """The text as a LIKE pattern that matches only itself."""
        for c in "\\%_":
            text = text.replace(c, "\\" + c)
        return text

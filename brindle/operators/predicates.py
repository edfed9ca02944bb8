"""Conditions as Spark columns.

Typed columns compare natively, so filters reach the Parquet scan.  Only
text against a number (or text that looks like one) decides row by row: both numeric-looking
compare as numbers, else as text.
"""

from __future__ import annotations

import datetime
import decimal
import operator as op_module
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans import ir
from ..types import NUMBER
from .resolve import Scope

_OPS = {"=": op_module.eq, "!=": op_module.ne, "<": op_module.lt, "<=": op_module.le, ">": op_module.gt, ">=": op_module.ge}


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _plain(value):
    """Booleans compare as 1 and 0."""
    return int(value) if isinstance(value, bool) else value


def compare(column: Column, kind: T.DataType, op: str, value) -> Column:
    """``column op value`` for a column of type ``kind`` and a plain value."""
    value, test = _plain(value), _OPS[op]
    if value is None:
        return F.lit(False)
    numeric = isinstance(value, (int, float, decimal.Decimal))
    looks = isinstance(value, str) and re.match(NUMBER, value) is not None
    if isinstance(kind, T.BooleanType):
        column, kind = column.cast("int"), T.IntegerType()
    if isinstance(kind, T.StringType) and (numeric or looks):
        number = F.lit(float(value) if not isinstance(value, int) else value)
        text = column if isinstance(column, Column) else F.col(column)
        return F.when(text.rlike(NUMBER), test(text.try_cast("double"), number)).otherwise(test(text, F.lit(str(value))))
    if is_number(kind) and isinstance(value, str):
        if looks:
            return test(column, F.lit(decimal.Decimal(value)) if "." in value else F.lit(int(value)))
        return test(column.cast("string"), F.lit(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
        try:
            moment = datetime.datetime.fromisoformat(value)
        except ValueError:
            return test(column.cast("string"), F.lit(value))
        if isinstance(kind, T.DateType) and len(value) == 10:
            return test(column, F.lit(moment.date()))
        return test(column.cast("timestamp_ntz"), F.lit(value).cast("timestamp_ntz"))
    return test(column, F.lit(value))


def compare_columns(left: Column, left_kind: T.DataType, op: str, right: Column, right_kind: T.DataType) -> Column:
    """Text meets a number as the number it is; what is none matches nothing."""
    if isinstance(left_kind, T.StringType) and is_number(right_kind):
        left = left.try_cast("double")
    elif is_number(left_kind) and isinstance(right_kind, T.StringType):
        right = right.try_cast("double")
    return _OPS[op](left, right)


def loosely_equal(left: Column, right: Column) -> Column:
    """Equality of columns of any types: as numbers if both look like numbers, else as text."""
    a, b = left.cast("string"), right.cast("string")
    numbers = a.try_cast("double").isNotNull() & b.try_cast("double").isNotNull() & a.rlike(f"{NUMBER}|E") & b.rlike(f"{NUMBER}|E")
    return F.when(numbers, a.try_cast("double") == b.try_cast("double")).otherwise(a == b)


def like(column: Column, pattern: str) -> Column:
    """LIKE where a backslash escapes only ``%``, ``_`` and itself, and is else a letter."""
    return column.like(re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else "\\\\", pattern))


def never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Predicates:
    """Compiles conditions in a scope; ``subquery(select, scope)`` gives (DataFrame, fields) of a subquery."""

    def __init__(self, scope: Scope, subquery):
        self.scope, self.subquery = scope, subquery

    def __call__(self, condition: ir.Condition) -> Column:
        return getattr(self, "_" + type(condition).__name__)(condition)

    def _ConditionGroup(self, c: ir.ConditionGroup) -> Column:
        if not c.items:
            return F.lit(True)
        first, *rest = c.items
        return reduce(lambda left, item: left & self(item[1]) if item[0] == "and" else left | self(item[1]), rest, self(first[1]))

    def _Constant(self, c: ir.Constant) -> Column:
        return F.lit(c.value)

    def _Comparison(self, c: ir.Comparison) -> Column:
        return compare(self.scope.folded(c.column), self.scope.kind(c.column), c.op, c.value)

    def _ColumnComparison(self, c: ir.ColumnComparison) -> Column:
        s = self.scope
        left, right = s(c.left), s(c.right)
        if s.ci(c.left) or s.ci(c.right):
            left, right = (F.collate(x, "UTF8_LCASE") if isinstance(s.kind(n), T.StringType) else x for x, n in ((left, c.left), (right, c.right)))
        return compare_columns(left, s.kind(c.left), c.op, right, s.kind(c.right))

    def _InList(self, c: ir.InList) -> Column:
        column, kind = self.scope.folded(c.column), self.scope.kind(c.column)
        values = [v for v in c.values if v is not None]
        plain = isinstance(kind, T.StringType) and all(isinstance(v, str) and not re.match(NUMBER, v) for v in values)
        plain = plain or (is_number(kind) and all(isinstance(v, (int, float)) for v in values))
        if not values:
            found = F.lit(False)
        elif plain:
            found = column.isin([_plain(v) for v in values])
        else:
            found = reduce(lambda a, b: a | b, [compare(column, kind, "=", v) for v in values])
        return column.isNotNull() & ~found if c.negated else found

    def _Between(self, c: ir.Between) -> Column:
        column, kind = self.scope.folded(c.column), self.scope.kind(c.column)
        inside = compare(column, kind, ">=", c.low) & compare(column, kind, "<=", c.high)
        return column.isNotNull() & ~inside if c.negated else inside

    def _IsNull(self, c: ir.IsNull) -> Column:
        return self.scope(c.column).isNotNull() if c.negated else self.scope(c.column).isNull()

    def _LikePattern(self, c: ir.LikePattern) -> Column:
        column = self.scope.folded(c.column)
        return like(column if isinstance(self.scope.kind(c.column), T.StringType) else column.cast("string"), c.pattern)

    def _one_column(self, query: ir.Select, what: str):
        df, fields = self.subquery(query, self.scope)
        if len(fields) != 1:
            raise QueryError(f"{what} takes a query of one column")
        return df, fields[0]

    def _InQuery(self, c: ir.InQuery) -> Column:
        """A semi join, or for NOT IN an anti join: NULLs of the query are ignored, a NULL column matches neither."""
        df, field = self._one_column(c.query, "IN")
        scope, outer = self.scope, self.scope._field(c.column)[0]
        mine = F.col(f"`{outer.internal}`").outer()
        theirs = F.col(f"`{field.internal}`")
        if scope.ci(c.column):
            mine, theirs = F.collate(mine, "UTF8_LCASE"), F.collate(theirs, "UTF8_LCASE")
        found = df.filter(compare_columns(theirs, field.kind, "=", mine, scope.kind(c.column))).exists()
        return scope(c.column).isNotNull() & ~found if c.negated else found

    def _Exists(self, c: ir.Exists) -> Column:
        found = self.subquery(c.query, self.scope)[0].exists()
        return ~found if c.negated else found

    def _ScalarComparison(self, c: ir.ScalarComparison) -> Column:
        df, field = self._one_column(c.query, "a scalar comparison")
        single = not c.query.group_by and any(hasattr(i, "func") and not hasattr(i, "partition") for i in c.query.items) and not c.query.unions
        value = (df if single else df.limit(1)).scalar()
        column = self.scope.folded(c.column)
        return compare_columns(column, self.scope.kind(c.column), c.op, value, field.kind)

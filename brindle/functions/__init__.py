"""Expressions of the SELECT list: functions, CASE, aggregates and windows."""

from .expressions import Agg, Aggregate, Call, Case, CaseWhen, ColumnRef, Expression, Func, Like, Window

__all__ = ["Agg", "Aggregate", "Call", "Case", "CaseWhen", "ColumnRef", "Expression", "Func", "Like", "Window"]

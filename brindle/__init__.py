"""A relational analytics engine on PySpark with a fluent query builder.

``Engine`` opens databases of typed tables (or takes any DataFrame as a table);
``engine.table(...)`` starts a query, which compiles to one DataFrame plan.
"""

from .engine import Engine
from .errors import BrindleError, ConstraintError, QueryError, SchemaError, StorageError, TransactionError, TypeCastError
from .functions import Agg, CaseWhen, Func, Like
from .plans.ir import ConditionGroup

__all__ = [
    "Agg", "BrindleError", "CaseWhen", "ConditionGroup", "ConstraintError", "Engine", "Func", "Like", "QueryError",
    "SchemaError", "StorageError", "TransactionError", "TypeCastError",
]

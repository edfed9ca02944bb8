"""Exceptions: one base and one class for each kind of failure."""


class BrindleError(Exception):
    """Base of all errors of the engine."""


class SchemaError(BrindleError):
    """A definition of a table, column, index or view is wrong or in use."""


class TypeCastError(BrindleError):
    """A value does not fit the type of its column."""


class ConstraintError(BrindleError):
    """A write violates NOT NULL, UNIQUE, CHECK or a foreign key."""


class QueryError(BrindleError):
    """A query or an expression is not valid."""


class StorageError(BrindleError):
    """A database, table or file is missing or cannot be used."""


class TransactionError(BrindleError):
    """A transaction or savepoint is used out of order."""

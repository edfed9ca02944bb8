"""Tables as declared: column types, constraints and the DSL to declare them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import SchemaError
from .plans.ir import ConditionGroup

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
INTEGERS = ("TINYINT", "SMALLINT", "INT", "BIGINT")
#: Greatest signed and unsigned values; the least signed value is the negative of the greatest.
BOUNDS = {"TINYINT": (127, 255), "SMALLINT": (32767, 65535), "INT": (2147483647, 4294967295), "BIGINT": (9223372036854775807, 18446744073709551615)}
STRINGS = ("CHAR", "VARCHAR", "TEXT", "BINARY", "SET", "ENUM")
FOLDABLE = ("CHAR", "VARCHAR", "TEXT", "ENUM")
TEMPORAL = ("DATE", "DATETIME", "TIMESTAMP")
ACTIONS = ("RESTRICT", "CASCADE", "SET_NULL", "SET_DEFAULT")


def identifier(name: str) -> str:
    if not isinstance(name, str) or not IDENTIFIER.match(name):
        raise SchemaError(f"not a name: {name!r}")
    return name


class ForeignKeyAction:
    RESTRICT, CASCADE, SET_NULL, SET_DEFAULT = ACTIONS


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    type: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    values: tuple[str, ...] = ()
    unsigned: bool = False
    not_null: bool = False
    has_default: bool = False
    default: Any = None
    default_now: bool = False
    unique: bool = False
    primary: bool = False
    auto_increment: bool = False
    ci: bool = False

    def spark_type(self) -> T.DataType:
        t, wide = self.type, self.unsigned
        if t in INTEGERS:
            if t == "BIGINT" and wide and not self.auto_increment:
                return T.DecimalType(20, 0)
            signed = {"TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType()}
            larger = {"TINYINT": T.ShortType(), "SMALLINT": T.IntegerType(), "INT": T.LongType(), "BIGINT": T.LongType()}
            return larger[t] if wide else signed[t]
        if t == "DECIMAL":
            return T.DecimalType(self.precision, self.scale)
        return {"FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.ByteType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "BLOB": T.BinaryType(), "BINARY": T.BinaryType()}.get(t, T.StringType())


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    references: str
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass(frozen=True)
class Check:
    name: str
    condition: ConditionGroup


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnSchema, ...]
    primary: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    indexes: tuple[Index, ...] = ()

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if not names:
            raise SchemaError(f"table {self.name!r} has no column")
        for what, given in (("column", names), ("check", [c.name for c in self.checks]), ("index", [i.name for i in self.indexes])):
            if len(set(given)) < len(given):
                raise SchemaError(f"a {what} of table {self.name!r} is named twice")
        for used in [*self.uniques, self.primary, *(i.columns for i in self.indexes), *((f.column,) for f in self.foreign_keys)]:
            for c in used:
                if c not in names:
                    raise SchemaError(f"table {self.name!r} has no column {c!r}")
        for c in self.columns:
            if c.auto_increment and self.primary_columns() != (c.name,):
                raise SchemaError("an auto-increment column must be the only primary key")
        for f in self.foreign_keys:
            col = self.column(f.column)
            for action in (f.on_delete, f.on_update):
                if action not in ACTIONS:
                    raise SchemaError(f"unknown action {action!r}")
                if action == "SET_NULL" and (col.not_null or col.name in self.primary_columns()):
                    raise SchemaError(f"SET NULL on column {col.name!r}, which takes no NULL")
                if action == "SET_DEFAULT" and not col.has_default:
                    raise SchemaError(f"SET DEFAULT on column {col.name!r}, which has no default")

    def column(self, name: str) -> ColumnSchema:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"table {self.name!r} has no column {name!r}")

    def has_column(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def primary_columns(self) -> tuple[str, ...]:
        return self.primary or tuple(c.name for c in self.columns if c.primary)

    def auto_column(self) -> ColumnSchema | None:
        return next((c for c in self.columns if c.auto_increment), None)

    def unique_groups(self) -> list[tuple[str, ...]]:
        groups = [self.primary_columns()] if self.primary_columns() else []
        groups += [(c.name,) for c in self.columns if c.unique] + list(self.uniques)
        return list(dict.fromkeys(groups))

    def access_paths(self) -> list[tuple[str, tuple[str, ...]]]:
        paths = [(i.name, i.columns) for i in self.indexes]
        if self.primary_columns():
            paths.append(("PRIMARY", self.primary_columns()))
        return paths + [("unique:" + ",".join(g), g) for g in self.unique_groups() if g != self.primary_columns()]

    def requires(self, name: str) -> bool:
        """True if the column takes no NULL."""
        return self.column(name).not_null or name in self.primary_columns()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type()) for c in self.columns])

    def to_dict(self) -> dict:
        from .plans.serial import to_dict as condition

        return {
            "name": self.name, "columns": [asdict(c) for c in self.columns], "primary": self.primary, "uniques": self.uniques,
            "foreign_keys": [asdict(f) for f in self.foreign_keys], "checks": [{"name": c.name, "condition": condition(c.condition)} for c in self.checks],
            "indexes": [asdict(i) for i in self.indexes],
        }

    @staticmethod
    def from_dict(d: dict) -> TableSchema:
        from .plans.serial import from_dict as condition

        return TableSchema(
            d["name"], tuple(ColumnSchema(**{**c, "values": tuple(c["values"])}) for c in d["columns"]), tuple(d["primary"]), tuple(map(tuple, d["uniques"])),
            tuple(ForeignKey(**f) for f in d["foreign_keys"]), tuple(Check(c["name"], condition(c["condition"])) for c in d["checks"]),
            tuple(Index(i["name"], tuple(i["columns"])) for i in d["indexes"]),
        )


class ColumnDefinition:
    """A column in the making; modifiers chain."""

    def __init__(self, schema: ColumnSchema):
        self.schema = schema

    def _with(self, **changes) -> ColumnDefinition:
        self.schema = replace(self.schema, **changes)
        return self

    def unsigned(self):
        if self.schema.type not in (*INTEGERS, "DECIMAL", "FLOAT", "DOUBLE"):
            raise SchemaError("UNSIGNED takes a number")
        return self._with(unsigned=True)

    def not_null(self):
        return self._with(not_null=True)

    def nullable(self):
        return self._with(not_null=False)

    def default(self, value):
        return self._with(default=value, has_default=True)

    def default_now(self):
        if self.schema.type not in TEMPORAL:
            raise SchemaError("a default of now takes a date or time")
        return self._with(default_now=True)

    def unique(self):
        return self._with(unique=True)

    def primary_key(self):
        return self._with(primary=True)

    def auto_increment(self):
        if self.schema.type not in INTEGERS:
            raise SchemaError("AUTO_INCREMENT takes a whole number")
        return self._with(auto_increment=True)

    def ci(self):
        if self.schema.type not in FOLDABLE:
            raise SchemaError("a case-insensitive column is text")
        return self._with(ci=True)


class ForeignKeyDefinition:
    def __init__(self, column: str):
        self.key = ForeignKey(column, "", "")

    def references(self, table: str, column: str):
        self.key = replace(self.key, table=table, references=column)
        return self

    def on_delete(self, action: str):
        self.key = replace(self.key, on_delete=action.upper())
        return self

    def on_update(self, action: str):
        self.key = replace(self.key, on_update=action.upper())
        return self

    def on_delete_cascade(self):
        return self.on_delete("CASCADE")


def _sized(kind: str, most: int):
    def make(self, name: str, length: int = most):
        if not 1 <= length <= most:
            raise SchemaError(f"{kind} takes a length from 1 to {most}")
        return self._add(name, kind, length=length)

    return make


def _simple(kind: str):
    return lambda self, name: self._add(name, kind)


class Blueprint:
    """Declares a table: a method for each type, and its constraints."""

    def __init__(self, table: str):
        self.table = identifier(table)
        self.columns: list[ColumnDefinition] = []
        self.primary_key: tuple[str, ...] = ()
        self.unique_groups: list[tuple[str, ...]] = []
        self.keys: list[ForeignKeyDefinition] = []
        self.checks: list[Check] = []
        self.indexes: list[Index] = []

    def _add(self, name: str, kind: str, **more) -> ColumnDefinition:
        c = ColumnDefinition(ColumnSchema(identifier(name), kind, **more))
        self.columns.append(c)
        return c

    tinyint, smallint, int, bigint = _simple("TINYINT"), _simple("SMALLINT"), _simple("INT"), _simple("BIGINT")
    float, double, boolean = _simple("FLOAT"), _simple("DOUBLE"), _simple("BOOLEAN")
    text, json, blob = _simple("TEXT"), _simple("JSON"), _simple("BLOB")
    date, datetime, timestamp = _simple("DATE"), _simple("DATETIME"), _simple("TIMESTAMP")
    char, varchar, binary = _sized("CHAR", 255), _sized("VARCHAR", 65535), _sized("BINARY", 255)

    def id(self, name: str = "id") -> ColumnDefinition:
        return self.bigint(name).unsigned().primary_key().auto_increment()

    def decimal(self, name: str, precision: int = 10, scale: int = 2) -> ColumnDefinition:
        if not 1 <= scale <= precision <= 38:
            raise SchemaError("DECIMAL takes 1 <= scale <= precision <= 38")
        return self._add(name, "DECIMAL", precision=precision, scale=scale)

    def _members(self, name: str, kind: str, values) -> ColumnDefinition:
        values = tuple(values)
        if not values or len(set(values)) < len(values) or not all(isinstance(v, str) for v in values):
            raise SchemaError(f"{kind} takes different strings")
        return self._add(name, kind, values=values)

    def enum(self, name: str, values) -> ColumnDefinition:
        return self._members(name, "ENUM", values)

    def set(self, name: str, values) -> ColumnDefinition:
        return self._members(name, "SET", values)

    def primary(self, *columns: str) -> None:
        if self.primary_key:
            raise SchemaError("a table has one primary key")
        self.primary_key = columns

    def unique(self, *columns: str) -> None:
        self.unique_groups.append(columns)

    def foreign_key(self, column: str) -> ForeignKeyDefinition:
        self.keys.append(ForeignKeyDefinition(column))
        return self.keys[-1]

    def check(self, name: str, condition: ConditionGroup) -> None:
        self.checks.append(Check(identifier(name), condition))

    def index(self, *columns: str) -> None:
        self.indexes.append(Index("idx_" + "_".join(columns), columns))

    def build(self) -> TableSchema:
        columns = tuple(c.schema for c in self.columns)
        return TableSchema(self.table, columns, self.primary_key, tuple(self.unique_groups), tuple(k.key for k in self.keys), tuple(self.checks), tuple(self.indexes))


class AlterBlueprint(Blueprint):
    """Columns to add, rename and drop."""

    def __init__(self, table: str):
        super().__init__(table)
        self.renamed: list[tuple[str, str]] = []
        self.dropped: list[str] = []

    def rename_column(self, old: str, new: str) -> None:
        self.renamed.append((old, identifier(new)))

    def drop_column(self, name: str) -> None:
        self.dropped.append(name)


def _renamed(columns: tuple[str, ...], old: str, new: str) -> tuple[str, ...]:
    return tuple(new if c == old else c for c in columns)


def rename_column(s: TableSchema, old: str, new: str) -> TableSchema:
    """The schema with a column renamed, in its keys, checks and indexes too."""
    from .plans.serial import rename

    s.column(old)
    if s.has_column(new):
        raise SchemaError(f"table {s.name!r} has a column {new!r}")
    return replace(
        s, columns=tuple(replace(c, name=new) if c.name == old else c for c in s.columns), primary=_renamed(s.primary, old, new),
        uniques=tuple(_renamed(g, old, new) for g in s.uniques),
        foreign_keys=tuple(replace(f, column=new if f.column == old else f.column, references=new if (f.table, f.references) == (s.name, old) else f.references) for f in s.foreign_keys),
        checks=tuple(Check(c.name, rename(c.condition, old, new)) for c in s.checks),
        indexes=tuple(replace(i, columns=_renamed(i.columns, old, new)) for i in s.indexes),
    )


def drop_column(s: TableSchema, name: str) -> TableSchema:
    """The schema without a column that no key, check or index uses."""
    from .plans.serial import columns_of

    col = s.column(name)
    users = {
        "the primary key": name in s.primary_columns(), "a unique constraint": col.unique or any(name in g for g in s.uniques),
        "a foreign key": any(f.column == name for f in s.foreign_keys), "a check": any(name in columns_of(c.condition) for c in s.checks),
        "an index": any(name in i.columns for i in s.indexes),
    }
    for what, used in users.items():
        if used:
            raise SchemaError(f"column {name!r} is part of {what}")
    return replace(s, columns=tuple(c for c in s.columns if c.name != name))


def declare(table: str, define: Callable[[Blueprint], Any]) -> TableSchema:
    blueprint = Blueprint(table)
    define(blueprint)
    return blueprint.build()


__all__ = ["ACTIONS", "AlterBlueprint", "Blueprint", "Check", "ColumnSchema", "ForeignKey", "ForeignKeyAction", "Index", "TableSchema", "declare", "drop_column", "field", "rename_column"]

"""The engine: databases, tables, views, transactions, and where queries start."""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as ddl
from .errors import QueryError, SchemaError, StorageError, TransactionError
from .operators.compile import Compiler
from .plans import ir, serial
from .plans.builder import Query, Table, table_source
from .sources.shared import shared_folder
from .sources.store import GRACE, HIDDEN, Store
from .types import cast_value


class Engine:
    """A connection.  With a ``root`` folder, databases last; without, they are gone with the session.

    ``register`` takes any DataFrame, also a streaming one, as a read-only table.
    ``store`` may be any object with the methods of ``Store``, to keep tables elsewhere; with a ``key`` values are stored encrypted.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, compression: str = "zstd", store: Store | None = None, key: bytes | None = None):
        from .dml import Triggers, Writer

        self.spark, self.durable = spark, root is not None if store is None else store.durable
        self.store = store or Store(spark, root or f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", compression, durable=self.durable, key=key)
        self.database = "main"
        self.external: dict[str, DataFrame] = {}
        self.triggers, self.writer = Triggers(), Writer(self)
        self._transaction: dict | None = None
        self._savepoints: list[tuple[str, dict]] = []

    # catalog access

    @property
    def _db(self) -> dict:
        return self.store.state["databases"][self.database]

    def entry(self, name: str) -> dict:
        if name not in self._db["tables"]:
            raise StorageError(f"no table {name!r}")
        return self._db["tables"][name]

    def schema_of(self, name: str) -> ddl.TableSchema | None:
        return None if name in self.external else self.table_schema(name)

    def table_schema(self, name: str) -> ddl.TableSchema:
        return ddl.TableSchema.from_dict(self.entry(name)["schema"])

    def stored_rows(self, name: str) -> int | None:
        return None if name in self.external else sum(p["rows"] for p in self.entry(name)["parts"])

    def ci_columns(self, name: str) -> set[str]:
        if name in self.external:
            return set()
        return {c.name for c in self.table_schema(name).columns if c.ci}

    def frame(self, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """A table's rows; ``keep`` are hidden columns that are wanted too."""
        if name in self.external:
            if keep:
                raise QueryError(f"{name!r} is read-only")
            return self.external[name]
        e = self.entry(name)
        struct = self.table_schema(name).struct()
        return self.store.read([p["path"] for p in e["parts"]], struct).select(*struct.names, *keep)

    def compile(self, plan: ir.Select) -> DataFrame:
        return Compiler(self)(plan)

    def _save(self) -> None:
        """Commits what has changed, unless a transaction is open."""
        if self._transaction is None:
            self.store.commit()

    def statement(self, run: Callable[[], Any]) -> Any:
        """Runs a change; if it fails, nothing of it stays."""
        if self._transaction is None and self.durable:
            self.store.refresh()
        before, outer = self.store.snapshot(), self.writer.begun()
        try:
            out = run()
            self._save()
            return out
        except Exception:
            self.store.state = before
            raise
        finally:
            self.writer.ended(outer)

    # queries

    def register(self, name: str, df: DataFrame) -> Table:
        self.external[ddl.identifier(name)] = df
        return self.table(name)

    def table(self, reference: str) -> Table:
        source = table_source(reference)
        return Table(self, ir.Select(source))

    def with_(self, name, query: Query | None = None) -> Query:
        """A query that starts with common table expressions; ``from_cte`` gives it a source."""
        return Query(self, ir.Select(ir.TableSource("?", "?"))).with_(name, query)

    # databases

    def databases(self) -> list[str]:
        return sorted(self.store.state["databases"])

    def has_database(self, name: str) -> bool:
        return name in self.store.state["databases"]

    def create_database(self, name: str) -> None:
        if self.has_database(ddl.identifier(name)):
            raise StorageError(f"database {name!r} exists")
        self.statement(lambda: self.store.state["databases"].update({name: {"tables": {}, "views": {}}}))

    def drop_database(self, name: str) -> None:
        if not self.has_database(name):
            raise StorageError(f"no database {name!r}")
        if name == self.database:
            raise StorageError("the database in use cannot be dropped")
        self.statement(lambda: self.store.state["databases"].pop(name))

    def use(self, name: str) -> Engine:
        if not self.has_database(name):
            raise StorageError(f"no database {name!r}")
        self.database = name
        return self

    def current_database(self) -> str:
        return self.database

    # tables

    def tables(self) -> list[str]:
        return sorted(self._db["tables"])

    def has_table(self, name: str) -> bool:
        return name in self._db["tables"]

    def _put(self, s: ddl.TableSchema, name: str | None = None) -> None:
        self.entry(name or s.name)["schema"] = s.to_dict()

    def _check_keys(self, s: ddl.TableSchema) -> None:
        for f in s.foreign_keys:
            parent = s if f.table == s.name else self.table_schema(f.table) if self.has_table(f.table) else None
            if parent is None:
                raise SchemaError(f"a foreign key names no table: {f.table!r}")
            if (f.references,) not in parent.unique_groups():
                raise SchemaError(f"a foreign key takes a unique column: {f.table}.{f.references}")

    def create_table(self, name: str, define: Callable[[ddl.Blueprint], Any]) -> None:
        s = ddl.declare(name, define)
        if self.has_table(name) or name in self._db["views"]:
            raise SchemaError(f"{name!r} exists")
        self._check_keys(s)
        self.statement(lambda: self._db["tables"].update({name: {"schema": s.to_dict(), "parts": [], "counter": 0}}))

    def create_table_if_not_exists(self, name: str, define: Callable[[ddl.Blueprint], Any]) -> bool:
        if self.has_table(name):
            return False
        self.create_table(name, define)
        return True

    def _in_use(self, name: str) -> None:
        for other in self.tables():
            if other != name and any(f.table == name for f in self.table_schema(other).foreign_keys):
                raise SchemaError(f"table {name!r} is referenced by {other!r}")
        self._viewed(name)

    def _viewed(self, name: str) -> None:
        for view, d in self._db["views"].items():
            if name in ir.table_names(serial.from_dict(d)):
                raise SchemaError(f"table {name!r} is used by view {view!r}")

    def drop_table(self, name: str) -> None:
        self.entry(name)
        self._in_use(name)
        self.statement(lambda: self._db["tables"].pop(name))

    def rename_table(self, old: str, new: str) -> None:
        self.entry(old)
        if self.has_table(ddl.identifier(new)) or new in self._db["views"]:
            raise SchemaError(f"{new!r} exists")
        self._viewed(old)

        def run() -> None:
            self._db["tables"][new] = self._db["tables"].pop(old)
            for t in self.tables():
                s = self.table_schema(t)
                keys = tuple(replace(f, table=new) if f.table == old else f for f in s.foreign_keys)
                self._put(replace(s, name=new if t == new else s.name, foreign_keys=keys), t)

        self.statement(run)

    def alter_table(self, name: str, define: Callable[[ddl.AlterBlueprint], Any]) -> None:
        """Drops, renames and adds columns; rows are rewritten to a new version with the new columns filled."""
        plan = ddl.AlterBlueprint(name)
        define(plan)
        s = old = self.table_schema(name)
        df = self.frame(name, HIDDEN)
        for c in plan.dropped:
            self._referenced(name, c)
            s, df = ddl.drop_column(s, c), df.drop(c)
        for a, b in plan.renamed:
            s, df = ddl.rename_column(s, a, b), df.withColumnRenamed(a, b)
        rows = self.stored_rows(name)
        for c in (x.schema for x in plan.columns):
            if s.has_column(c.name):
                raise SchemaError(f"table {name!r} has a column {c.name!r}")
            if c.auto_increment or c.primary or (c.unique and c.has_default and rows > 1):
                raise SchemaError(f"column {c.name!r} cannot be added to a table")
            if c.not_null and not (c.has_default or c.default_now) and rows:
                raise SchemaError(f"column {c.name!r} takes no NULL and has no default")
            value = F.lit(cast_value(c, c.default)) if c.has_default else F.current_timestamp() if c.default_now else F.lit(None)
            df = df.withColumn(c.name, value.cast(c.spark_type()))
            s = replace(s, columns=(*s.columns, c))

        def run() -> None:
            for t in self.tables():
                other = self.table_schema(t)
                for a, b in plan.renamed:
                    keys = tuple(replace(f, references=b) if (f.table, f.references) == (name, a) else f for f in other.foreign_keys)
                    other = replace(other, foreign_keys=keys)
                if t != name:
                    self._put(other, t)
            self._put(s)
            if rows and s.names() != old.names():
                self.writer.rewrite(name, df.select(*s.names(), *HIDDEN))

        self.statement(run)

    def _referenced(self, table: str, column: str) -> None:
        for t in self.tables():
            if any((f.table, f.references) == (table, column) for f in self.table_schema(t).foreign_keys):
                raise SchemaError(f"column {column!r} is referenced by {t!r}")

    def create_index(self, table: str, name: str, *columns: str) -> None:
        s = self.table_schema(table)
        s = replace(s, indexes=(*s.indexes, ddl.Index(ddl.identifier(name), columns)))
        self.statement(lambda: self._put(s))

    def has_index(self, table: str, name: str) -> bool:
        return any(i.name == name for i in self.table_schema(table).indexes)

    def drop_index(self, table: str, name: str) -> None:
        s = self.table_schema(table)
        if not self.has_index(table, name):
            raise SchemaError(f"table {table!r} has no index {name!r}")
        self.statement(lambda: self._put(replace(s, indexes=tuple(i for i in s.indexes if i.name != name))))

    # views

    def create_view(self, name: str, query: Query) -> None:
        if self.has_table(ddl.identifier(name)) or self.has_view(name):
            raise SchemaError(f"{name!r} exists")
        plan = ir.as_select(query)
        serial.storable_view(plan)
        self.compile(plan)  # names must resolve
        self.statement(lambda: self._db["views"].update({name: serial.to_dict(plan)}))

    def drop_view(self, name: str) -> None:
        if not self.has_view(name):
            raise SchemaError(f"no view {name!r}")
        self.statement(lambda: self._db["views"].pop(name))

    def has_view(self, name: str) -> bool:
        return name in self._db["views"]

    def views(self) -> list[str]:
        return sorted(self._db["views"])

    def view(self, name: str) -> Query:
        """The view's own query, which further calls extend."""
        if not self.has_view(name):
            raise SchemaError(f"no view {name!r}")
        return Query(self, serial.from_dict(self._db["views"][name]))

    # transactions: parts are immutable, so a snapshot of the catalog is all that there is to keep

    def begin(self) -> None:
        if self._transaction is not None:
            raise TransactionError("a transaction is open")
        if self.durable:
            self.store.refresh()
        self._transaction, self._savepoints = self.store.snapshot(), []

    def in_transaction(self) -> bool:
        return self._transaction is not None

    def _open(self) -> None:
        if self._transaction is None:
            raise TransactionError("no transaction is open")

    def commit(self) -> None:
        self._open()
        self.store.commit()
        self._transaction, self._savepoints = None, []

    def roll_back(self) -> None:
        self._open()
        self.store.state, self._transaction, self._savepoints = self._transaction, None, []
        if not self.has_database(self.database):
            self.database = "main"

    def savepoint(self, name: str) -> None:
        self._open()
        self._savepoints = [s for s in self._savepoints if s[0] != name] + [(ddl.identifier(name), self.store.snapshot())]

    def _at(self, name: str) -> int:
        self._open()
        found = [i for i, (n, _) in enumerate(self._savepoints) if n == name]
        if not found:
            raise TransactionError(f"no savepoint {name!r}")
        return found[0]

    def roll_back_to(self, name: str) -> None:
        i = self._at(name)
        self.store.state = copy.deepcopy(self._savepoints[i][1])
        self._savepoints = self._savepoints[: i + 1]

    def release_savepoint(self, name: str) -> None:
        self._savepoints = self._savepoints[: self._at(name)]

    def transaction(self, run: Callable[[Engine], Any]) -> Any:
        self.begin()
        try:
            out = run(self)
            self.commit()
            return out
        except Exception:
            if self.in_transaction():
                self.roll_back()
            raise

    # the rest

    def create_trigger(self, table: str, timing: str, event: str, handler: Callable):
        self.entry(table)
        return self.triggers.add(table, timing, event, handler)

    def drop_trigger(self, trigger) -> None:
        self.triggers.drop(trigger)

    def backup(self, target: str) -> None:
        if self.in_transaction():
            raise TransactionError("no backup within a transaction")
        self.store.backup(target)

    def vacuum(self, grace: float = GRACE) -> int:
        """Removes files that are no longer in use and older than ``grace`` seconds."""
        if self.in_transaction():
            raise TransactionError("no vacuum within a transaction")
        return self.store.vacuum(grace)

    def compact(self, name: str) -> None:
        """All rows of a table in one part; writes do this for small parts by themselves."""
        self.entry(name)
        self.statement(lambda: self.writer.rewrite(name, self.writer.clustered(name, self.frame(name, HIDDEN))) if len(self.entry(name)["parts"]) > 1 else None)

    def __getattr__(self, name: str):
        from .plans.builder import CAMEL

        snake = CAMEL.sub(lambda m: "_" + m[1].lower(), name)
        if snake != name and not name.startswith("_") and hasattr(type(self), snake):
            return getattr(self, snake)
        raise AttributeError(name)


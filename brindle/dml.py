"""Writes: each one stages new immutable parts, checks them, and only then is part of the catalog.

Rows have a hidden identity (batch, row) that also is their order.  A write
rewrites the parts that hold affected rows and no others.  Checks are joins and
aggregations that look for one violation.  Only rows that the caller gives, and
rows that triggers must see, are handled on the driver, the latter in batches.

Small parts are merged as they come: ``TIER`` parts of about the same size become one, so a table has
few parts for each power of ``TIER`` in its number of rows, and a row is rewritten a few times at most.
"""

from __future__ import annotations

import datetime
import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .errors import ConstraintError, QueryError
from .operators.compile import Compiler
from .operators.predicates import Predicates, never_null
from .operators.resolve import Field, Scope
from .plans import ir
from .result import InsertResult
from .schema import TableSchema
from .sources.store import BATCH, HIDDEN, ROW
from .types import cast_column, cast_value

ROW_BITS = 33
TIER = 16
#: Parts of more rows are not merged.
LARGE_ROWS = 10_000_000
#: Up to so many identities (16 bytes each) are broadcast.
FEW_IDS = 10_000
#: Rows that triggers see at a time.
TRIGGER_ROWS = 5_000


@dataclass(frozen=True)
class Trigger:
    number: int
    table: str
    timing: str
    event: str
    handler: Callable


class Triggers:
    """Callbacks before and after writes, in the order they were added; they last as long as the engine."""

    def __init__(self):
        self.known: list[Trigger] = []
        self.numbers = itertools.count()

    def add(self, table: str, timing: str, event: str, handler: Callable) -> Trigger:
        timing, event = timing.lower(), event.lower()
        if timing not in ("before", "after") or event not in ("insert", "update", "delete"):
            raise QueryError(f"no such trigger: {timing} {event}")
        self.known.append(Trigger(next(self.numbers), table, timing, event, handler))
        return self.known[-1]

    def drop(self, trigger: Trigger) -> None:
        if trigger not in self.known:
            raise QueryError("no such trigger")
        self.known.remove(trigger)

    def of(self, table: str, event: str, timing: str | None = None) -> list[Trigger]:
        return [t for t in self.known if t.table == table and t.event == event and timing in (None, t.timing)]


def _same(columns) -> Any:
    return reduce(lambda a, b: a & b, columns)


class Writer:
    def __init__(self, engine):
        self.engine = engine
        #: Folders of rows that the running statement holds; None outside of one.
        self.held: list[str] | None = None

    def begun(self) -> bool:
        """A statement begins; whether it is the outermost one."""
        outer = self.held is None
        self.held = [] if outer else self.held
        return outer

    def ended(self, outer: bool) -> None:
        """After the outermost statement nothing reads the rows it held."""
        if outer:
            for path in self.held:
                self.store.files.remove(path)
            self.held = None

    # parts

    @property
    def store(self):
        return self.engine.store

    def _hold(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` written aside, and its number of rows: read again it is the same, whatever becomes of the tables."""
        path, seen = f"{self.store.root}/_aside/{uuid.uuid4().hex}", Observation()
        schema = df.schema
        if self.held is not None:
            self.held.append(path)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        return self.engine.spark.read.schema(schema).parquet(path), seen.get["rows"]

    def _of(self, name: str, ids: DataFrame, n: int) -> DataFrame:
        """The rows of ``n`` identities.  Parts are immutable, so this stays as it is when the table changes."""
        return self.engine.frame(name, HIDDEN).join(F.broadcast(ids) if n < FEW_IDS else ids, list(HIDDEN), "left_semi")

    def _add(self, name: str, df: DataFrame, batches: list[int]) -> dict:
        seen = Observation()
        path = self.store.write(df.observe(seen, F.count(F.lit(1)).alias("rows")), self.engine.database, name)
        rows = seen.get["rows"]  # counted while it was written
        part = {"path": path, "rows": rows, "batches": batches}
        if rows:
            self.engine.entry(name)["parts"].append(part)
        return part

    def rewrite(self, name: str, df: DataFrame) -> None:
        """All rows anew, with their identities."""
        entry = self.engine.entry(name)
        batches = sorted({b for p in entry["parts"] for b in p["batches"]})
        path = self.store.write(df, self.engine.database, name)
        entry["parts"] = [{"path": path, "rows": sum(p["rows"] for p in entry["parts"]), "batches": batches}]

    def clustered(self, name: str, df: DataFrame) -> DataFrame:
        """Rows sorted within each file by the first declared index or the primary key, so that a lookup skips row groups."""
        s = self.engine.table_schema(name)
        keys = s.indexes[0].columns if s.indexes else s.primary_columns()
        return df.sortWithinPartitions(*keys) if keys else df

    def _merge(self, name: str) -> None:
        """Merges parts of about the same size once there are ``TIER`` of them."""
        entry, struct = self.engine.entry(name), self.engine.table_schema(name).struct()
        while True:
            tiers: dict[int, list[dict]] = {}
            for p in entry["parts"]:
                if p["rows"] <= LARGE_ROWS:
                    tiers.setdefault(len(f"{p['rows']:x}"), []).append(p)  # a hexadecimal digit more is TIER times as many
            if not (full := [t for t in tiers.values() if len(t) >= TIER]):
                return
            old = full[0]
            rows = self.store.read([p["path"] for p in old], struct)
            entry["parts"] = [p for p in entry["parts"] if p not in old]
            self._add(name, self.clustered(name, rows.coalesce(max(1, sum(p["rows"] for p in old) // 1_000_000))), sorted({b for p in old for b in p["batches"]}))

    def _swap(self, name: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the parts that hold rows of ``ids``: ``change`` maps their rows."""
        entry = self.engine.entry(name)
        hit = {r[0] for r in ids.select(BATCH).distinct().collect()}  # at most the number of batches
        old = [p for p in entry["parts"] if hit & set(p["batches"])]
        if old:
            struct = self.engine.table_schema(name).struct()
            rows = self.store.read([p["path"] for p in old], struct)
            entry["parts"] = [p for p in entry["parts"] if p not in old]
            self._add(name, change(rows).select(*struct.names, *HIDDEN), sorted({b for p in old for b in p["batches"]}))

    # checks

    def _any(self, df: DataFrame) -> bool:
        return bool(df.limit(1).count())

    def _check(self, name: str, new: DataFrame, others: DataFrame | None, columns: set[str]) -> None:
        """Raises if ``new`` rows break a rule on ``columns``; ``others`` are the table's other rows.

        Each rule is a search for one violation; all are branches of one job.
        """
        s = self.engine.table_schema(name)
        wrong: list[tuple[DataFrame, str]] = []
        required = [c for c in s.names() if s.requires(c) and c in columns]
        if required:
            wrong.append((new.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])), f"a column of {name!r} that takes no NULL has one: {required}"))
        for check in s.checks:
            scope = Scope()
            scope.add(name, [Field(f.name, f.name, f.dataType) for f in new.schema.fields if f.name not in HIDDEN])
            predicate = Predicates(scope, lambda *_: None)(check.condition)
            wrong.append((new.filter(~never_null(predicate)), f"check {check.name!r} of {name!r} does not hold"))
        for group in s.unique_groups():
            if columns & set(group):
                keys, error = new.select(*group).na.drop(), f"{name!r} has rows of equal {', '.join(group)}"
                wrong.append((keys.groupBy(*group).count().filter("count > 1"), error))
                if others is not None:
                    wrong.append((others.select(*group).join(keys, list(group), "left_semi"), error))
        for f in s.foreign_keys:
            if f.column in columns:
                parent = self.engine.frame(f.table).select(F.col(f.references).alias("k"))
                mine = new.select(F.col(f.column).cast(parent.schema["k"].dataType).alias("k")).na.drop()
                wrong.append((mine.join(parent, "k", "left_anti"), f"{name}.{f.column} names no row of {f.table}.{f.references}"))
        if wrong:
            found = reduce(DataFrame.unionAll, [df.limit(1).select(F.lit(i).alias("rule")) for i, (df, _) in enumerate(wrong)]).collect()
            if found:
                raise ConstraintError(wrong[min(r["rule"] for r in found)][1])

    # insert

    def _row(self, s: TableSchema, row: dict) -> dict:
        for c in row:
            if not s.has_column(c):
                raise QueryError(f"table {s.name!r} has no column {c!r}")
        out = {}
        for c in s.columns:
            if c.name in row:
                value = cast_value(c, row[c.name])
            elif c.default_now:
                value = cast_value(c, datetime.datetime.now().replace(microsecond=0))
            else:
                value = cast_value(c, c.default) if c.has_default else None
            if value is None and s.requires(c.name) and not c.auto_increment:
                raise ConstraintError(f"column {c.name!r} takes no NULL")
            out[c.name] = value
        return out

    def insert(self, name: str, rows: list[dict]) -> InsertResult:
        return self.engine.statement(lambda: self._insert(name, rows))

    def _insert(self, name: str, rows: list[dict]) -> InsertResult:
        s, entry, triggers = self.engine.table_schema(name), self.engine.entry(name), self.engine.triggers
        made, auto = [], s.auto_column()
        for row in rows:
            for t in triggers.of(name, "insert", "before"):
                row = t.handler(dict(row)) or row
            row = self._row(s, row)
            if auto is not None:
                if row[auto.name] is None:
                    row[auto.name] = entry["counter"] + 1
                entry["counter"] = max(entry["counter"], int(row[auto.name]))
            made.append(row)
        last = int(made[-1][auto.name]) if made and auto is not None else None
        if not made:
            return InsertResult(0, None)
        before, batch = self.engine.frame(name), self.store.next_batch()
        types = self.store.read([], s.struct()).schema
        df = self.engine.spark.createDataFrame([(*[r[c] for c in s.names()], batch, i) for i, r in enumerate(made)], types)
        self._check(name, df, self._near(s, before, made), set(s.names()))
        self._add(name, df.coalesce(1), [batch])
        self._merge(name)
        for row in made:
            for t in triggers.of(name, "insert", "after"):
                t.handler(dict(row))
        return InsertResult(len(made), last)

    def _near(self, s: TableSchema, rows: DataFrame, made: list[dict]) -> DataFrame:
        """The stored rows that may be equal to few given ones: a filter that reaches the Parquet scan."""
        if len(made) > 200:
            return rows
        tests = [_same([F.col(c) == F.lit(r[c]) for c in g]) for g in s.unique_groups() for r in made if all(r[c] is not None for c in g)]
        return rows.filter(reduce(lambda a, b: a | b, tests)) if tests else rows.limit(0)

    def _numbered(self, df: DataFrame, column: str, start: int) -> DataFrame:
        """Numbers after ``start`` where ``column`` is NULL: a count for each partition, then offsets; no global sort."""
        held = self._hold(df.withColumn("__at", F.monotonically_increasing_id()))[0].withColumn("__part", F.shiftright("__at", ROW_BITS))
        counts = held.groupBy("__part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select("__part", before.alias("__base"))  # one row for each partition
        number = F.lit(start + 1) + F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        return held.join(F.broadcast(offsets), "__part").withColumn(column, F.coalesce(F.col(column), number)).drop("__part", "__base", "__at")

    def insert_select(self, name: str, plan: ir.Select) -> int:
        if name in ir.table_names(plan):
            raise QueryError("INSERT SELECT from the table itself")
        s = self.engine.table_schema(name)
        df = self.engine.compile(plan)
        if extra := set(df.columns) - set(s.names()):
            raise QueryError(f"table {name!r} has no column {sorted(extra)[0]!r}")

        def run() -> int:
            entry, batch, columns = self.engine.entry(name), self.store.next_batch(), []
            for c in s.columns:
                if c.name in df.columns:
                    columns.append(cast_column(c, F.col(f"`{c.name}`"), df.schema[c.name].dataType).alias(c.name))
                else:
                    value = F.lit(cast_value(c, c.default)) if c.has_default else F.current_timestamp() if c.default_now else F.lit(None)
                    columns.append(value.cast(c.spark_type()).alias(c.name))
            rows, auto = df.select(*columns), s.auto_column()
            if auto is not None:
                top = (rows.agg(F.max(auto.name)).first()[0] if auto.name in df.columns else None) or 0
                entry["counter"] = max(entry["counter"], int(top))
                rows = self._numbered(rows, auto.name, entry["counter"])
            before = self.engine.frame(name)
            part = self._add(name, self.clustered(name, rows.withColumn(BATCH, F.lit(batch).cast("long")).withColumn(ROW, F.monotonically_increasing_id())), [batch])
            if not part["rows"]:
                return 0
            new = self.store.read([part["path"]], s.struct())
            if auto is not None:
                entry["counter"] = max(entry["counter"], int(new.agg(F.max(auto.name)).first()[0]))
            self._check(name, new, before, set(s.names()))
            self._merge(name)
            return part["rows"]

        return self.engine.statement(run)

    # single rows that may meet others

    def _conflicts(self, name: str, row: dict) -> DataFrame:
        """Identities of stored rows that are equal to ``row`` on a unique group."""
        s = self.engine.table_schema(name)
        for c in row:
            s.column(c)
        values = {c.name: cast_value(c, row[c.name]) if c.name in row else cast_value(c, c.default) if c.has_default else None for c in s.columns}
        tests = [_same([F.col(c) == F.lit(values[c]) for c in g]) for g in s.unique_groups() if all(values[c] is not None for c in g)]
        rows = self.engine.frame(name, HIDDEN)
        return (rows.filter(reduce(lambda a, b: a | b, tests)) if tests else rows.limit(0)).select(*HIDDEN)

    def insert_ignore(self, name: str, row: dict) -> int:
        return self.engine.statement(lambda: 0 if self._any(self._conflicts(name, row)) else self._insert(name, [row]).row_count)

    def upsert(self, name: str, row: dict) -> int:
        def run() -> int:
            found, n = self._hold(self._conflicts(name, row))
            if n > 1:
                raise ConstraintError("the row meets several others")
            if not n:
                self._insert(name, [row])
                return 1
            s = self.engine.table_schema(name)
            self._assign(name, found, n, {c: cast_value(s.column(c), v) for c, v in row.items()})
            return 2

        return self.engine.statement(run)

    def replace(self, name: str, row: dict) -> int:
        def run() -> int:
            found, n = self._hold(self._conflicts(name, row))
            if n:
                self._delete(name, found, n)
            return n + self._insert(name, [row]).row_count

        return self.engine.statement(run)

    # update

    def _plain(self, plan: ir.Select, what: str, joins: bool = True) -> str:
        wrong = plan.items or plan.group_by or plan.having or plan.distinct or plan.offset or plan.unions or not isinstance(plan.source, ir.TableSource)
        if wrong or (plan.joins and (plan.order_by or plan.limit is not None or not joins)):
            raise QueryError(f"{what} takes WHERE, and either joins or ORDER BY and LIMIT")
        return plan.source.name

    def _matched(self, plan: ir.Select) -> tuple[DataFrame, int]:
        """Identities of the base table's rows that a write is about, and how many they are."""
        compiler = Compiler(self.engine)
        df, scope = compiler.matched(plan, HIDDEN)
        if plan.order_by or plan.limit is not None:
            keys = [compiler._sorted(scope.folded(c), down) for c, down in plan.order_by]
            df = df.orderBy(*keys, *HIDDEN).limit(plan.limit) if plan.limit is not None else df
        ids = df.select(*HIDDEN)
        return self._hold(ids.distinct() if plan.joins else ids)

    def update(self, plan: ir.Select, values: dict) -> int:
        name = self._plain(plan, "UPDATE")
        if not values:
            raise QueryError("UPDATE takes values")
        if plan.joins:
            return self.engine.statement(lambda: self._update_joined(plan, values))

        def run() -> int:
            s = self.engine.table_schema(name)
            cast = {c.rpartition(".")[2]: cast_value(s.column(c.rpartition(".")[2]), v) for c, v in values.items()}
            ids, n = self._matched(plan)
            if n:
                self._assign(name, ids, n, cast)
            return n

        return self.engine.statement(run)

    def _update_joined(self, plan: ir.Select, values: dict) -> int:
        """Each target's matched rows are updated once; the count is of all targets' rows."""
        compiler, scope, df = Compiler(self.engine), Scope(), None
        tables = {}
        for join in [None, *plan.joins]:
            source = plan.source if join is None else join.source
            stored = isinstance(source, ir.TableSource) and source.name not in self.engine.external
            side = compiler.source(source, scope, HIDDEN if stored else ())
            if stored:
                tables[source.alias] = source.name
                side = side.withColumnsRenamed({h: f"{h}@{source.alias}" for h in HIDDEN})
            df = side if join is None else df.join(side, compiler.predicates(scope)(join.on), join.kind)
        if plan.where.items:
            df = df.filter(compiler.predicates(scope)(plan.where))
        targets: dict[str, dict] = {}
        for column, value in values.items():
            alias, _, short = column.rpartition(".")
            alias = alias or plan.source.alias
            if alias not in tables:
                raise QueryError(f"UPDATE names no table: {column!r}")
            targets.setdefault(alias, {})[short] = cast_value(self.engine.table_schema(tables[alias]).column(short), value)
        found = {a: self._hold(df.select(*[F.col(f"`{h}@{a}`").alias(h) for h in HIDDEN]).na.drop().distinct()) for a in targets}
        total = 0
        for alias, cast in targets.items():
            ids, n = found[alias]
            if n:
                self._assign(tables[alias], ids, n, cast)
            total += n
        return total

    def _assign(self, name: str, ids: DataFrame, n: int, values: dict) -> None:
        """Constants for the ``n`` rows of ``ids``."""
        s = self.engine.table_schema(name)
        constants = {c: F.lit(v).cast(s.column(c).spark_type()) for c, v in values.items()}
        old = self._of(name, ids, n)

        def change(rows: DataFrame) -> DataFrame:
            marked = ids.withColumn("__hit", F.lit(True))
            rows = rows.join(F.broadcast(marked) if n < FEW_IDS else marked, list(HIDDEN), "left")
            return rows.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(f"`{c}`")) for c, v in constants.items()})

        self._update(name, ids, old, old.withColumns(constants), set(values), change)

    def _update(self, name: str, ids: DataFrame, old: DataFrame, new: DataFrame, columns: set[str], change: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rows ``old`` become ``new`` (equal identities ``ids``); only ``columns`` differ."""
        triggers, s = self.engine.triggers, self.engine.table_schema(name)
        if triggers.of(name, "update", "before"):
            new, columns, change = self._before_update(name, old, new), set(s.names()), None
        new = new.select(*s.names(), *HIDDEN)
        others = self.engine.frame(name, HIDDEN).join(ids, list(HIDDEN), "left_anti")
        self._swap(name, ids, change or (lambda rows: rows.join(ids, list(HIDDEN), "left_anti").unionByName(new)))
        self._check(name, new, others, columns)
        self._propagate(name, old, new, columns)
        if after := triggers.of(name, "update", "after"):
            for (a, _), (b, _) in zip(self._rows(name, old), self._rows(name, new)):
                for t in after:
                    t.handler(dict(a), dict(b))

    def _rows(self, name: str, df: DataFrame):
        """(values, identity) of rows in their order, a partition at a time on the driver."""
        names = self.engine.table_schema(name).names()
        for r in df.orderBy(*HIDDEN).toLocalIterator():
            yield {c: r[c] for c in names}, [r[h] for h in HIDDEN]

    def _before_update(self, name: str, old: DataFrame, new: DataFrame) -> DataFrame:
        """The rows that the triggers make of ``new``, written aside batch by batch."""
        s, parts = self.engine.table_schema(name), []
        schema = self.store.read([], s.struct()).schema
        pairs = zip(self._rows(name, old), self._rows(name, new))
        while batch := list(itertools.islice(pairs, TRIGGER_ROWS)):
            rows = []
            for (a, identity), (b, _) in batch:
                made = dict(b)
                for t in self.engine.triggers.of(name, "update", "before"):
                    made = t.handler(dict(a), dict(made)) or made
                rows.append((*[cast_value(s.column(c), made[c]) for c in s.names()], *identity))
            parts.append(self._hold(self.engine.spark.createDataFrame(rows, schema))[0])
        return reduce(DataFrame.unionAll, parts)

    def _children(self, name: str):
        for child in self.engine.tables():
            for f in self.engine.table_schema(child).foreign_keys:
                if f.table == name:
                    yield child, f

    def _propagate(self, name: str, old: DataFrame, new: DataFrame, columns: set[str]) -> None:
        for child, f in list(self._children(name)):
            if f.references not in columns:
                continue
            a, b = old.select(*HIDDEN, F.col(f.references).alias("was")), new.select(*HIDDEN, F.col(f.references).alias("now"))
            moved, _ = self._hold(a.join(b, list(HIDDEN)).filter(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))).select("was", "now").distinct())
            rows = self.engine.frame(child, HIDDEN)
            kind = rows.schema[f.column].dataType
            met, n = self._hold(rows.join(moved, F.col(f.column) == F.col("was").cast(kind)))
            if not n:
                continue
            if f.on_update == "RESTRICT":
                raise ConstraintError(f"{name}.{f.references} is named by rows of {child!r}")
            column = self.engine.table_schema(child).column(f.column)
            value = {"CASCADE": F.col("now").cast(kind), "SET_NULL": F.lit(None).cast(kind)}.get(f.on_update)
            if value is None:
                value = F.lit(cast_value(column, column.default)).cast(kind)
            self._update(child, met.select(*HIDDEN), met.drop("was", "now"), met.withColumn(f.column, value).drop("was", "now"), {f.column})

    # delete

    def delete(self, plan: ir.Select) -> int:
        name = self._plain(plan, "DELETE")

        def run() -> int:
            ids, n = self._matched(plan)
            if n:
                self._delete(name, ids, n)
            return n

        return self.engine.statement(run)

    def _delete(self, name: str, ids: DataFrame, n: int) -> None:
        """Deletes rows, then what their foreign keys ask for; rows that are gone are not met again, so cycles end."""
        triggers, gone = self.engine.triggers, self._of(name, ids, n)
        if before := triggers.of(name, "delete", "before"):
            for row, _ in self._rows(name, gone):
                for t in before:
                    t.handler(dict(row))
        self._swap(name, ids, lambda part: part.join(F.broadcast(ids) if n < FEW_IDS else ids, list(HIDDEN), "left_anti"))
        for child, f in list(self._children(name)):
            keys = gone.select(F.col(f.references).alias("__key")).na.drop().distinct()
            mine = self.engine.frame(child, HIDDEN)
            met, few = self._hold(mine.join(keys, mine[f.column] == keys["__key"].cast(mine.schema[f.column].dataType), "left_semi"))
            if not few:
                continue
            if f.on_delete == "RESTRICT":
                raise ConstraintError(f"rows of {name!r} are named by {child}.{f.column}")
            if f.on_delete == "CASCADE":
                self._delete(child, met.select(*HIDDEN), few)
                continue
            column = self.engine.table_schema(child).column(f.column)
            value = None if f.on_delete == "SET_NULL" else cast_value(column, column.default)
            self._update(child, met.select(*HIDDEN), met, met.withColumn(f.column, F.lit(value).cast(column.spark_type())), {f.column})
        if after := triggers.of(name, "delete", "after"):
            for row, _ in self._rows(name, gone):
                for t in after:
                    t.handler(dict(row))

    def truncate(self, name: str) -> None:
        for child, _ in self._children(name):
            raise ConstraintError(f"table {name!r} is referenced by {child!r}")

        def run() -> None:
            self.engine.entry(name).update(parts=[], counter=0)

        self.engine.statement(run)

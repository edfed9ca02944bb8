"""From a logical plan to one DataFrame.

Order of operations: sources and joins, WHERE, grouping or projection, HAVING,
windows, DISTINCT, ORDER BY, OFFSET and LIMIT, and after a union the last three on what was merged.
Columns have unique internal names until the end, so Catalyst may move and prune
everything freely.

Ties of an ORDER BY and of ROW_NUMBER keep the order of the source: a hidden ordinal is the last sort
key.  For stored tables it is the rows' identity, from every joined table; for registered ones it is the order in which
Spark reads them, taken after WHERE so that filters still reach the scan, and only
without joins.  Groups and distinct rows stand where their first row does.  Ties of a union have no order.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import Aggregate, ColumnRef, Expression, Window
from ..functions.expressions import aggregate_column
from ..plans import ir
from ..sources.store import HIDDEN
from .predicates import Predicates, compare
from .ranking import ONE_TASK_BYTES, estimated_bytes, rank_all
from .resolve import Field, Scope

#: A join whose sides compare in other ways than by equality is dealt out where the product of its sides' estimated sizes is beyond this, with so much for a task.
PAIR_BYTES = 1 << 36
#: Up to this estimated size the smaller side of such a join is sent to all tasks; at most so many tasks share the larger.
SENT_BYTES, MOST_TASKS = 16 << 20, 4096
JOINS = {"inner": "inner", "left": "left", "right": "right"}
ORDINAL = "__ordinal"


@dataclass(frozen=True)
class Output:
    name: str
    internal: str
    ci: bool = False

    @property
    def column(self) -> Column:
        return F.col(f"`{self.internal}`")


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


class Outputs:
    """Resolves names among output columns, then, if given, in a scope."""

    def __init__(self, types: dict[str, T.DataType], outputs: list[Output], scope: Scope | None):
        self.outputs, self.scope, self.types = {o.name: o for o in outputs}, scope, types

    def output(self, name: str) -> Output | None:
        return self.outputs.get(name) or (self.outputs.get(name.rpartition(".")[2]) if self.scope is None or self.scope.find(name) is None else None)

    def __call__(self, name: str) -> Column:
        if self.scope is not None and self.scope.find(name) is not None:
            return self.scope(name)
        if (o := self.output(name)) is None:
            raise QueryError(f"unknown column {name!r}")
        return o.column

    def kind(self, name: str) -> T.DataType:
        if self.scope is not None and self.scope.find(name) is not None:
            return self.scope.kind(name)
        return self.types[self.outputs[name if name in self.outputs else name.rpartition(".")[2]].internal]


class Compiler:
    def __init__(self, engine):
        self.engine, self.numbers = engine, count()

    def __call__(self, plan: ir.Select) -> DataFrame:
        df, fields = self.select(plan)
        return df.select(*[F.col(f"`{f.internal}`").alias(f.name) for f in fields])

    def _name(self, hint: str) -> str:
        return f"{hint.replace('`', '')}#{next(self.numbers)}"

    # sources

    def source(self, source, scope: Scope, keep: tuple[str, ...] = ()) -> DataFrame:
        """A source with unique column names; ``keep`` are hidden columns that stay."""
        if isinstance(source, ir.TableSource):
            df, ci = self.engine.frame(source.name, keep), self.engine.ci_columns(source.name)
            names = [f.name for f in df.schema.fields if f.name not in keep]
            held = {n: n for n in names}
        else:
            df, fields = self.select(source.query)
            names, held, ci = [f.name for f in fields], {f.name: f.internal for f in fields}, set()
        kinds = {f.name: f.dataType for f in df.schema.fields}
        fields = [Field(n, self._name(f"{source.alias}.{n}"), kinds[held[n]], n in ci) for n in names]
        scope.add(source.alias, fields)
        return df.select(*[F.col(f"`{held[f.name]}`").alias(f.internal) for f in fields], *keep)

    def dealt(self, df: DataFrame, right: DataFrame, join: ir.Join, scope: Scope) -> tuple[DataFrame, DataFrame]:
        """Both sides of a join that can return far more rows than it reads: one is sent whole, the other is dealt out over
        many tasks, as its few files or keys would else bring the work into as few.  Rows of an outer join that need no partner are dealt out."""
        tests = [c for how, c in join.on.items if how == "and" or c is join.on.items[0][1]]
        equal = [c for c in tests if isinstance(c, ir.ColumnComparison) and c.op == "="]
        of_one_side = (ir.Comparison, ir.InList, ir.Between, ir.IsNull, ir.LikePattern)
        by_key = equal and len(tests) == len(join.on.items) and all(c in equal or isinstance(c, of_one_side) for c in tests)
        if by_key or df.isStreaming or right.isStreaming:
            return df, right
        sizes = estimated_bytes(df), estimated_bytes(right)
        flip = join.kind == "right" or (join.kind == "inner" and sizes[0] < sizes[1])
        large, small, most, least = (right, df, *sizes[::-1]) if flip else (df, right, *sizes)
        least_tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
        if most * least < PAIR_BYTES or least > SENT_BYTES or most >= least_tasks * ONE_TASK_BYTES:
            return df, right
        tasks = min(MOST_TASKS, max(least_tasks, most * least // PAIR_BYTES))
        # Rows with the same key stand together: what they meet stays in the processor's cache, and the result compresses well.
        # The hash deals a key that many rows have out over many tasks.
        fields = [scope._field(n)[0] for c in equal for n in (c.left, c.right)]
        own, theirs = ([F.col(f"`{f.internal}`") for f in fields if f.internal in d.columns] for d in (large, small))
        hashed = [F.col(f"`{f.name}`") for f in large.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
        large = large.repartitionByRange(tasks, *own, F.xxhash64(*hashed)) if hashed else large.repartition(tasks)
        small = F.broadcast(small.repartitionByRange(least_tasks, *theirs) if theirs else small)
        return (small, large) if flip else (large, small)

    def sources(self, plan: ir.Select, scope: Scope, ordinal: bool = False, first: bool = False) -> tuple[DataFrame, list[str]]:
        """FROM and JOIN, and the columns that tell the order of stored rows; with ``first`` joined rows keep the order in which Spark makes them."""
        order: list[str] = []

        def side(source) -> DataFrame:
            if not (ordinal and isinstance(source, ir.TableSource) and self.engine.schema_of(source.name) is not None):
                return self.source(source, scope)
            names = {h: f"{h}{len(order)}" for h in HIDDEN}
            df = self.source(source, scope, HIDDEN).withColumnsRenamed(names)
            order.extend(names.values())
            return df

        df = side(plan.source)
        for join in plan.joins:
            right = side(join.source)
            if scope.outer is None and not first:
                df, right = self.dealt(df, right, join, scope)
            df = df.join(right, self.predicates(scope)(join.on), JOINS[join.kind])
        return df, order

    def predicates(self, scope: Scope) -> Predicates:
        return Predicates(scope, self.select)

    def matched(self, plan: ir.Select, keep: tuple[str, ...] = (), joined: bool = True) -> tuple[DataFrame, Scope]:
        """Rows that a write is about: FROM, JOIN and WHERE, with hidden columns of the base table."""
        scope = Scope()
        df = self.source(plan.source, scope, keep)
        for join in plan.joins if joined else ():
            df = df.join(self.source(join.source, scope), self.predicates(scope)(join.on), JOINS[join.kind])
        return (df.filter(self.predicates(scope)(plan.where)) if plan.where.items else df), scope

    # select

    def select(self, plan: ir.Select, outer: Scope | None = None) -> tuple[DataFrame, list[Field]]:
        df, outputs, scope, kinds = self.body(plan, outer)
        if plan.unions:
            df, outputs = self.unions(plan, df, outputs)
            scope, kinds = None, _types(df)
        df = self.finish(plan, df, outputs, scope)
        return df, [Field(o.name, o.internal, kinds[o.internal]) for o in outputs]

    def body(self, plan: ir.Select, outer: Scope | None):
        scope = Scope(outer)
        grouped = bool(plan.group_by) or any(isinstance(i, Aggregate) for i in plan.items)
        if plan.having and not grouped:
            raise QueryError("HAVING without groups or aggregates")
        first = grouped and any(isinstance(i, (str, Expression)) for i in plan.items)
        numbered = any(isinstance(i, Window) and i.func == "ROW_NUMBER" for i in plan.items)
        ordinal = first or (outer is None and not plan.unions and (bool(plan.order_by) or numbered))
        df, order = self.sources(plan, scope, ordinal, first)
        # Spark cannot tell the types of a query that refers to one around it; they are those without the filter.
        base = df if outer is not None else None
        if plan.where.items:
            df = df.filter(self.predicates(scope)(plan.where))
        if order:
            df = df.withColumn(ORDINAL, F.array(*order)).drop(*order)
        elif first or (ordinal and not plan.joins and not df.isStreaming):
            df = df.withColumn(ORDINAL, F.array(F.monotonically_increasing_id()))
        df, outputs, kinds = self.grouped(plan, df, scope, base) if grouped else self.projected(plan, df, scope, base)
        windows = [i for i in plan.items if isinstance(i, Window)]
        if windows:
            df, outputs, kinds = self.windowed(df, outputs, windows, None if grouped else scope, outer, kinds)
        names = [o.name for o in outputs]
        if twice := {n for n in names if names.count(n) > 1}:
            raise QueryError(f"output column {sorted(twice)[0]!r} is named twice")
        return df, outputs, None if grouped else scope, kinds

    def _plain(self, plan: ir.Select) -> list[tuple[str, str]]:
        """(column, output name) of plain columns."""
        return [(i, i.rpartition(".")[2]) if isinstance(i, str) else (i.name, i.output) for i in plan.items if isinstance(i, (str, ColumnRef))]

    def projected(self, plan: ir.Select, df: DataFrame, scope: Scope, base: DataFrame | None):
        plain = self._plain(plan)
        computed = [i for i in plan.items if isinstance(i, Expression) and not isinstance(i, ColumnRef)]
        star = not plain and not computed and all(not isinstance(i, (str, Expression)) for i in plan.items)
        chosen = [(f"{a}.{f.name}", f.name) for a, f in scope.fields()] if star else plain
        outputs = [(Output(name, self._name(name), scope.ci(c)), scope(c)) for c, name in chosen]
        outputs += [(Output(e.output, self._name(e.output)), e.column(scope)) for e in computed]
        columns = [c.alias(o.internal) for o, c in outputs]
        df = df.select("*", *columns)
        return df, [o for o, _ in outputs], _types(df if base is None else base.select(*columns))

    def grouped(self, plan: ir.Select, df: DataFrame, scope: Scope, base: DataFrame | None):
        computed = {i.output: i for i in plan.items if isinstance(i, Expression) and not isinstance(i, ColumnRef)}
        keys: list[tuple[Output, Column]] = []
        known: set[str] = set()
        for name in plan.group_by:
            if name in computed and scope.find(name) is None:
                keys.append((Output(name, self._name(name)), computed.pop(name).column(scope)))
            else:
                short = name.rpartition(".")[2]
                known.add(scope._field(name)[0].internal)
                keys.append((Output(short, self._name(short), scope.ci(name)), scope(name)))
        rest: list[tuple[Output, Column]] = []
        for c, name in self._plain(plan):
            if scope._field(c)[0].internal in known and name == c.rpartition(".")[2]:
                continue
            rest.append((Output(name, self._name(name), scope.ci(c)), F.min_by(scope(c), ORDINAL)))
        rest += [(Output(n, self._name(n)), F.min_by(e.column(scope), ORDINAL)) for n, e in computed.items()]
        rest += [(Output(a.output, self._name(a.output)), a.column(scope)) for a in plan.items if isinstance(a, Aggregate)]
        by = [c.alias(o.internal) for o, c in keys]
        aggregates = [c.alias(o.internal) for o, c in rest]
        if by and plan.order_by and ORDINAL in df.columns:
            aggregates.append(F.min(ORDINAL).alias(ORDINAL))

        def group(rows: DataFrame) -> DataFrame:
            if not by:
                return rows.select(*aggregates)
            return rows.groupBy(*by).agg(*aggregates) if aggregates else rows.select(*by).distinct()

        kinds = _types(group(df if base is None else base.withColumn(ORDINAL, F.array(F.lit(0).cast("long")))))
        df = group(df)
        outputs = [o for o, _ in keys + rest]
        if plan.having:
            name, op, value = plan.having
            found = {o.name: o for o in outputs}.get(name)
            if found is None:
                raise QueryError(f"HAVING names no output column: {name!r}")
            df = df.filter(compare(found.column, kinds[found.internal], op, value))
        return df, outputs, kinds

    def windowed(self, df: DataFrame, outputs: list[Output], windows: list[Window], scope: Scope | None, outer: Scope | None, kinds: dict):
        resolve = Outputs(kinds, outputs, scope)
        added: list[tuple[Output, Column]] = []
        for w in windows:
            out = Output(w.output, self._name(w.output))
            if w.ranks and w.order and not w.partition and outer is None and not df.isStreaming and estimated_bytes(df) > ONE_TASK_BYTES:
                tie = F.col(ORDINAL) if ORDINAL in df.columns else F.array(F.monotonically_increasing_id())
                df = rank_all(df, w.func, [(resolve(c), down) for c, down in w.order], out.internal, tie)
                added.append((out, out.column))
                continue
            if w.ranks:
                if not w.order:
                    raise QueryError(f"{w.func} takes an ORDER BY")
                tie = [F.col(ORDINAL)] if w.func == "ROW_NUMBER" and ORDINAL in df.columns else []
                spec = W.partitionBy(*[resolve(c) for c in w.partition]).orderBy(*[self._sorted(resolve(c), down) for c, down in w.order], *tie)
                added.append((out, {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[w.func]().over(spec).cast("long")))
            elif w.partition or outer is not None:
                # Aggregates are over whole partitions, whatever their order.
                spec = W.partitionBy(*[resolve(c) for c in w.partition])
                added.append((out, aggregate_column(w.func, w.argument, resolve).over(spec)))
            else:
                # One value for all rows: two-phase aggregation instead of a window in a single task.
                added.append((out, df.agg(aggregate_column(w.func, w.argument, resolve)).scalar()))
        df = df.select("*", *[c.alias(o.internal) for o, c in added if o.internal not in df.columns])
        if outer is None:
            kinds = _types(df)
        else:
            kinds = kinds | {o.internal: T.LongType() if w.ranks or w.func == "COUNT" else resolve.kind(w.argument) for (o, _), w in zip(added, windows)}
        return df, outputs + [o for o, _ in added], kinds

    def _sorted(self, column: Column, down: bool) -> Column:
        return column.desc_nulls_last() if down else column.asc_nulls_first()

    def unions(self, plan: ir.Select, df: DataFrame, outputs: list[Output]):
        names = [o.name for o in outputs]
        merged = df.select(*[o.column.alias(o.name) for o in outputs])
        # Duplicates that any UNION removes are gone after the last one, so that one alone does it.
        last = max((i for i, u in enumerate(plan.unions) if not u.all), default=-1)
        for i, u in enumerate(plan.unions):
            side, fields = self.select(u.query)
            if {f.name for f in fields} != set(names):
                raise QueryError(f"union of different columns: {names} and {[f.name for f in fields]}")
            merged = merged.unionByName(side.select(*[F.col(f"`{f.internal}`").alias(f.name) for f in fields]))
            if i == last:
                merged = merged.distinct()
        return merged, [Output(n, n) for n in names]

    def finish(self, plan: ir.Select, df: DataFrame, outputs: list[Output], scope: Scope | None) -> DataFrame:
        own = [o.column for o in outputs]
        tie = [F.col(ORDINAL)] if plan.order_by and ORDINAL in df.columns else []
        if plan.distinct:
            df, scope = df.groupBy(*own).agg(F.min(ORDINAL).alias(ORDINAL)) if tie else df.select(*own).distinct(), None
        if plan.order_by:
            df = df.orderBy(*[self._sorted(self._key(c, outputs, scope), down) for c, down in plan.order_by], *tie)
        if plan.offset:
            df = df.offset(plan.offset)
        if plan.limit is not None:
            df = df.limit(plan.limit)
        return df.select(*own)

    def _key(self, name: str, outputs: list[Output], scope: Scope | None) -> Column:
        """An output column by its name, then by its bare name, then a source column."""
        named = {o.name: o for o in outputs}
        found = named.get(name)
        if found is None and "." in name and (scope is None or scope.find(name) is None):
            found = named.get(name.rpartition(".")[2])
        if found is not None:
            return F.collate(found.column, "UTF8_LCASE") if found.ci else found.column
        if scope is None:
            raise QueryError(f"ORDER BY names no output column: {name!r}")
        return scope.folded(name)


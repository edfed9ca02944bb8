"""Names: which source column a name means.  Unknown and ambiguous names are errors at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError


@dataclass(frozen=True)
class Field:
    """A column of a source: its name there, its unique name in the plan, its type and case rule."""

    name: str
    internal: str
    kind: T.DataType
    ci: bool = False


class Scope:
    """The sources of one SELECT; ``outer`` is the scope around a subquery."""

    def __init__(self, outer: Scope | None = None):
        self.sources: dict[str, dict[str, Field]] = {}
        self.outer = outer

    def add(self, alias: str, fields: list[Field]) -> None:
        if alias in self.sources:
            raise QueryError(f"source {alias!r} is named twice")
        self.sources[alias] = {f.name: f for f in fields}

    def find(self, name: str) -> Field | None:
        """The field of an exact or a unique bare name, or None."""
        alias, dot, column = name.rpartition(".")
        if dot:
            return self.sources.get(alias, {}).get(column)
        found = [s[name] for s in self.sources.values() if name in s]
        if len(found) > 1:
            raise QueryError(f"column {name!r} is ambiguous")
        return found[0] if found else None

    def _field(self, name: str) -> tuple[Field, bool]:
        if (own := self.find(name)) is not None:
            return own, False
        alias, dot, _ = name.rpartition(".")
        if dot and alias not in self.sources and self.outer is not None and (far := self.outer.find(name)) is not None:
            return far, True
        raise QueryError(f"unknown column {name!r}")

    def __call__(self, name: str) -> Column:
        field, far = self._field(name)
        column = F.col(f"`{field.internal}`")
        return column.outer() if far else column

    def kind(self, name: str) -> T.DataType:
        return self._field(name)[0].kind

    def ci(self, name: str) -> bool:
        """A bare name folds case if any source's column of that name does."""
        if "." not in name:
            return any(s[name].ci for s in self.sources.values() if name in s)
        return self._field(name)[0].ci

    def folded(self, name: str) -> Column:
        """The column as predicates and sorts compare it."""
        return F.collate(self(name), "UTF8_LCASE") if self.ci(name) else self(name)

    def fields(self) -> list[tuple[str, Field]]:
        return [(alias, f) for alias, s in self.sources.items() for f in s.values()]

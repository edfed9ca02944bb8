"""Results of queries and of inserts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .errors import QueryError


class ResultSet:
    """Rows of a query as dicts; the DataFrame is run when rows are first asked for."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._rows: list[dict[str, Any]] | None = None

    def rows(self) -> list[dict[str, Any]]:
        if self._rows is None:
            self._rows = [r.asDict() for r in self.df.collect()]
        return self._rows

    all = to_array = toArray = rows

    def first(self) -> dict[str, Any] | None:
        if self._rows is None:
            found = self.df.take(1)
            return found[0].asDict() if found else None
        return self._rows[0] if self._rows else None

    def count(self) -> int:
        return self.df.count() if self._rows is None else len(self._rows)

    __len__ = count

    def is_empty(self) -> bool:
        return self.first() is None

    def is_not_empty(self) -> bool:
        return not self.is_empty()

    isEmpty, isNotEmpty = is_empty, is_not_empty

    def __bool__(self) -> bool:
        return True

    def pluck(self, column: str) -> list:
        if column not in self.df.columns:
            raise QueryError(f"no output column {column!r}")
        return [r[0] for r in self.df.select(f"`{column}`").collect()]

    def to_json(self) -> str:
        return json.dumps(self.rows(), default=str, ensure_ascii=False)

    toJson = json_serialize = to_json

    def __iter__(self) -> Iterator[dict[str, Any]]:
        if self._rows is not None:
            yield from self._rows
        else:
            for r in self.df.toLocalIterator(prefetchPartitions=True):
                yield r.asDict()


@dataclass(frozen=True)
class InsertResult:
    row_count: int
    last_insert_id: int | None = None

    def rowCount(self) -> int:  # noqa: N802 - the spelling that users know
        return self.row_count

    def lastInsertId(self) -> int | None:  # noqa: N802
        return self.last_insert_id

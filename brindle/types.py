"""Values and columns cast to declared types; what does not fit is an error, never rounded or cut."""

from __future__ import annotations

import datetime
import decimal
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TypeCastError
from .schema import BOUNDS, INTEGERS, ColumnSchema

WHOLE = re.compile(r"^[+-]?\d+$")
#: What looks like a number (a fixed value).
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
DECIMAL = re.compile(NUMBER)


def _fail(c: ColumnSchema, value: Any, why: str = ""):
    raise TypeCastError(f"column {c.name!r} ({c.type}) does not take {value!r}" + (f": {why}" if why else ""))


def bounds(c: ColumnSchema) -> tuple[int, int]:
    signed, unsigned = BOUNDS[c.type]
    return (0, unsigned) if c.unsigned else (-signed, signed)


def _integer(c: ColumnSchema, v: Any) -> int | decimal.Decimal:
    if isinstance(v, bool):
        v = int(v)
    elif isinstance(v, float) and v.is_integer():
        v = int(v)
    elif isinstance(v, decimal.Decimal) and v == v.to_integral_value():
        v = int(v)
    elif isinstance(v, str) and WHOLE.match(v.strip()):
        v = int(v)
    if not isinstance(v, int):
        _fail(c, v)
    low, high = bounds(c)
    if not low <= v <= high:
        _fail(c, v, "out of range")
    return decimal.Decimal(v) if isinstance(c.spark_type(), T.DecimalType) else v


def _decimal(c: ColumnSchema, v: Any) -> decimal.Decimal:
    text = str(int(v)) if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v).strip()
    if isinstance(v, float) and "e" in text:
        text = format(decimal.Decimal(text), "f")
    if not DECIMAL.match(text):
        _fail(c, v)
    d = decimal.Decimal(text)
    if c.unsigned and d < 0:
        _fail(c, v, "out of range")
    whole, _, part = text.lstrip("+-").partition(".")
    if len(part) > c.scale or len(whole.lstrip("0")) > c.precision - c.scale:
        _fail(c, v, f"it has more digits than ({c.precision},{c.scale})")
    return d.quantize(decimal.Decimal(1).scaleb(-c.scale), context=decimal.Context(prec=60))


def _float(c: ColumnSchema, v: Any) -> float:
    if isinstance(v, (bool, int, float, decimal.Decimal)) or (isinstance(v, str) and re.match(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", v.strip())):
        f = float(v)
        if c.unsigned and f < 0:
            _fail(c, v, "out of range")
        return f
    return _fail(c, v)


def _boolean(c: ColumnSchema, v: Any) -> int:
    if v in (True, False, "0", "1") and not isinstance(v, float):
        return int(v)
    return _fail(c, v)


def _text(c: ColumnSchema, v: Any) -> str:
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, (str, int, float, decimal.Decimal)):
        s = str(v)
        if c.length is not None and len(s) > c.length:
            _fail(c, v, f"longer than {c.length}")
        return s
    return _fail(c, v)


def _bytes(c: ColumnSchema, v: Any) -> bytes:
    b = bytes(v) if isinstance(v, (bytes, bytearray)) else _text(ColumnSchema(c.name, "TEXT"), v).encode()
    if c.length is not None and len(b) > c.length:
        _fail(c, v, f"longer than {c.length} bytes")
    return b


def _enum(c: ColumnSchema, v: Any) -> str:
    s = _text(c, v)
    return s if s in c.values else _fail(c, v, "not a member")


def _set(c: ColumnSchema, v: Any) -> str:
    members = v if isinstance(v, (list, tuple, set, frozenset)) else [] if v == "" else str(v).split(",")
    members = list(dict.fromkeys(members))
    if any(m not in c.values for m in members):
        _fail(c, v, "not members")
    return ",".join(members)


def _date(c: ColumnSchema, v: Any) -> datetime.date:
    if isinstance(v, datetime.datetime):
        return v.date()
    if isinstance(v, datetime.date):
        return v
    try:
        if isinstance(v, str) and re.match(r"^\d{4}-\d{2}-\d{2}$", v):
            return datetime.date.fromisoformat(v)
    except ValueError:
        pass
    return _fail(c, v)


def _moment(c: ColumnSchema, v: Any) -> datetime.datetime:
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None, microsecond=0)
    try:
        if isinstance(v, str) and re.match(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", v):
            return datetime.datetime.fromisoformat(v)
    except ValueError:
        pass
    return _fail(c, v)


def _json(c: ColumnSchema, v: Any) -> str:
    try:
        value = json.loads(v) if isinstance(v, str) else v
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, TypeError):
        return _fail(c, v, "not JSON")


_CASTS = {
    **dict.fromkeys(INTEGERS, _integer), "DECIMAL": _decimal, "FLOAT": _float, "DOUBLE": _float, "BOOLEAN": _boolean, "CHAR": _text, "VARCHAR": _text,
    "TEXT": _text, "BLOB": _bytes, "BINARY": _bytes, "ENUM": _enum, "SET": _set, "DATE": _date, "DATETIME": _moment, "TIMESTAMP": _moment, "JSON": _json,
}


def cast_value(c: ColumnSchema, value: Any) -> Any:
    """The stored form of a value; NULL is left to the constraints."""
    return None if value is None else _CASTS[c.type](c, value)


def cast_column(c: ColumnSchema, column: Column, kind: T.DataType) -> Column:
    """The stored form of a column of type ``kind``; a row that does not fit fails the job."""
    target = c.spark_type()
    bad = F.raise_error(F.concat(F.lit(f"column '{c.name}' ({c.type}) does not take "), F.coalesce(column.cast("string"), F.lit("?")))).cast(target)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast(target)
    if isinstance(kind, T.BooleanType):
        column = column.cast("int")
    if c.type in INTEGERS:
        low, high = bounds(c)
        wide = column.cast("string").try_cast(T.DecimalType(38, 9))
        good = wide.isNotNull() & (wide == F.floor(wide)) & wide.between(F.lit(decimal.Decimal(low)), F.lit(decimal.Decimal(high)))
        made = wide.cast(target)
    elif c.type == "DECIMAL":
        wide = column.cast("string").try_cast(T.DecimalType(38, min(18, c.scale + 6)))
        made = wide.try_cast(target)
        good = made.isNotNull() & (made == wide)
    elif c.type in ("FLOAT", "DOUBLE"):
        made = column.cast("string").try_cast("double")
        good = made.isNotNull()
    elif c.type == "BOOLEAN":
        made = column.cast("string").try_cast("int").cast("byte")
        good = made.isin(0, 1)
    elif c.type == "DATE":
        made = column.cast("string").try_cast("date")
        good = made.isNotNull()
    elif c.type in ("DATETIME", "TIMESTAMP"):
        made = F.date_trunc("second", column.cast("string").try_cast("timestamp_ntz")).cast("timestamp_ntz")
        good = made.isNotNull()
    elif isinstance(target, T.BinaryType):
        made = column.cast("string").cast("binary") if not isinstance(kind, T.BinaryType) else column
        good = F.octet_length(made) <= c.length if c.length else F.lit(True)
    else:
        made = column.cast("string")
        good = F.lit(True)
        if c.length is not None:
            good = F.char_length(made) <= c.length
        if c.type == "ENUM":
            good = made.isin(*c.values)
        elif c.type == "SET":
            made = F.array_join(F.array_distinct(F.split(made, ",")), ",")
            good = (made == "") | (F.size(F.array_except(F.split(made, ","), F.array(*map(F.lit, c.values)))) == 0)
    return F.when(column.isNull(), F.lit(None).cast(target)).when(F.coalesce(good, F.lit(False)), made).otherwise(bad)

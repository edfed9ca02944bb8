"""Values cast to declared types, on the driver and as columns alike."""

import datetime
import decimal

import pytest

from brindle.errors import TypeCastError
from brindle.schema import ColumnSchema
from brindle.types import cast_column, cast_value

D = decimal.Decimal
GOOD = [
    (ColumnSchema("c", "TINYINT"), "127", 127), (ColumnSchema("c", "INT", unsigned=True), 4294967295, 4294967295), (ColumnSchema("c", "BIGINT", unsigned=True), "18446744073709551615", D(18446744073709551615)),
    (ColumnSchema("c", "DECIMAL", precision=6, scale=2), "12.5", D("12.50")), (ColumnSchema("c", "BOOLEAN"), "1", 1), (ColumnSchema("c", "VARCHAR", length=3), "abc", "abc"),
    (ColumnSchema("c", "ENUM", values=("x", "y")), "y", "y"), (ColumnSchema("c", "SET", values=("a", "b")), "b,a,b", "b,a"), (ColumnSchema("c", "DATE"), "2024-02-29", datetime.date(2024, 2, 29)),
    (ColumnSchema("c", "DATETIME"), "2024-02-29 01:02:03", datetime.datetime(2024, 2, 29, 1, 2, 3)), (ColumnSchema("c", "DOUBLE"), "1e3", 1000.0), (ColumnSchema("c", "TEXT"), None, None),
]
BAD = [
    (ColumnSchema("c", "TINYINT"), "-128"), (ColumnSchema("c", "INT"), "1.5"), (ColumnSchema("c", "DECIMAL", precision=4, scale=2), "1.234"), (ColumnSchema("c", "DECIMAL", precision=4, scale=2), "123.4"),
    (ColumnSchema("c", "BOOLEAN"), "2"), (ColumnSchema("c", "VARCHAR", length=3), "abcd"), (ColumnSchema("c", "ENUM", values=("x",)), "z"), (ColumnSchema("c", "SET", values=("a",)), "a,z"),
    (ColumnSchema("c", "DATE"), "2023-02-29"), (ColumnSchema("c", "DATETIME"), "2024-01-01 25:00:00"),
]


@pytest.mark.parametrize("column,value,want", GOOD, ids=str)
def test_good(spark, column, value, want):
    assert cast_value(column, value) == want
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(cast_column(column, df["v"], df.schema["v"].dataType).alias("v")).first()[0] == want


@pytest.mark.parametrize("column,value", BAD, ids=str)
def test_bad(spark, column, value):
    with pytest.raises(TypeCastError):
        cast_value(column, value)
    df = spark.createDataFrame([(value,)], "v string")
    with pytest.raises(Exception, match="does not take"):
        df.select(cast_column(column, df["v"], df.schema["v"].dataType)).collect()


def test_json_and_bytes():
    assert cast_value(ColumnSchema("c", "JSON"), '{"a": [1, 2]}') == '{"a":[1,2]}'
    assert cast_value(ColumnSchema("c", "BINARY", length=2), b"ab") == b"ab"
    with pytest.raises(TypeCastError):
        cast_value(ColumnSchema("c", "JSON"), "{")

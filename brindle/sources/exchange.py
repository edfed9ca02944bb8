"""Import and export: one JSON document for each table, JSON lines, CSV and encrypted values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StorageError
from ..operators.ranking import estimated_bytes

#: Estimated size up to which a table is written as one document.
ONE_DOCUMENT_BYTES = 256 << 20


def read_table_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a document ``{"schema": ..., "auto_increment": ..., "rows": [...]}``."""
    if schema is not None:
        whole = spark.read.schema(T.StructType([T.StructField("rows", T.ArrayType(schema))])).json(path, multiLine=True)
    else:
        whole = spark.read.json(path, multiLine=True)
    return whole.select(F.inline("rows"))


def write_table_json(df: DataFrame, path: str, schema: dict, counter: int = 0) -> None:
    """The same document from a table's rows: one file, so for tables that one task can hold; larger ones are refused."""
    if (size := estimated_bytes(df)) > ONE_DOCUMENT_BYTES:
        raise StorageError(f"a table of about {size} bytes does not go into one document; write JSON lines")
    rows = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    head = json.dumps({"schema": schema, "auto_increment": counter})[:-1] + ', "rows": '
    whole = df.coalesce(1).agg(F.concat(F.lit(head), F.to_json(rows, {"ignoreNullFields": "false"}), F.lit("}")).alias("value"))
    whole.write.text(path)


def write_json_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("compression", compression).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def encrypted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """Text columns as AES-GCM ciphertext (base64); the key has 16, 24 or 32 bytes."""
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c).cast("string"), F.lit(key))) for c in columns})


def decrypted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    return df.withColumns({c: F.aes_decrypt(F.unbase64(F.col(c)), F.lit(key)).cast("string") for c in columns})

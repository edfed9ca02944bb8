"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licenses, lm, packing, pii, quality, simhash, toxicity
from ._common import crc_mod, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_file() -> str:
    """The public tokenizer's path; the file itself is never copied."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, spans_col="spans")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",")
    return found.select("doc_id", "text", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_replaced"), F.coalesce(kinds, F.lit("")).alias("kinds"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")})
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("row.doc_id", *[f"q.{c}" for c in base], "base_failed", "kept")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs.withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2), machine, ("doc_id", "held_out"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path: their source, then a directory of 64 ids, stands for one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan(docs, keep=("doc_id",))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    model, counts = lm.train(docs.filter("not held_out"))
    return lm.score(docs, model, counts, ("doc_id", "held_out"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"))
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    known = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], known.schema)
    return chat.digest(known.unionByName(added))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_chat_formatting": op10_chat_formatting,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Sketches, hashes with a seed, keyed permutations, token ids and trained models have no SQL.
SQL: dict[str, str] = {
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS a FROM documents), i AS (SELECT item_id, {_WORDS} AS a FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(10, len(a)) AS n, array_to_string(a[k:k + least(10, len(a)) - 1], ' ') AS w FROM i, unnest(range(1, len(a) - least(10, len(a)) + 2)) AS t(k) WHERE len(a) > 0),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT doc_id, k, n, array_to_string(a[k:k + n - 1], ' ') AS w FROM d, sizes, unnest(range(1, len(a) - n + 2)) AS t(k)),
        hits AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.w = iw.w),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.a) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op10_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (SELECT *, 4 + length(role) + 2 + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>')) + 9 AS size FROM c),
        s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
}

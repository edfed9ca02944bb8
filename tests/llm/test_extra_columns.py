"""Extra columns with the operators' own names, of any type and full of NULLs, change no result."""

import pytest
from brindle.llm import chat, decontam, langid, licenses, lm, packing, pii, quality, simhash, toxicity
from brindle.llm.queries import tokenizer_file
from pyspark.sql import functions as F

TEXTS = [(1, "the cat sat on the mat by the sea"), (2, "der hund und die katze am see"), (2, "der hund und die katze am see"), (3, None), (None, "")]
CLASHING = ["fp", "row", "q", "kept", "rid", "hits", "ids", "n", "part", "local", "score", "predicted", "lang_pred", "base", "model", "rest", "known", "license", "dir", "share", "spans", "node", "component", "root", "salt", "__text"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None) for i, t in TEXTS], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(None).cast("double" if k % 2 else "array<string>").alias(c) for k, c in enumerate(CLASHING)])


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = [sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) for df in (a, b)]
    assert rows[0] == rows[1]


def test_reports(spark, docs, wide):
    items = spark.createDataFrame([(1, "the cat sat on the mat by the sea today")], "item_id long, text string")
    same(simhash.near_duplicates(docs), simhash.near_duplicates(wide))
    same(decontam.report(docs, items), decontam.report(wide, items))
    same(packing.pieces(docs, tokenizer_file()), packing.pieces(wide, tokenizer_file()))
    same(licenses.scan(docs.withColumn("path", F.lit("a/b"))), licenses.scan(wide.withColumn("path", F.lit("a/b"))))
    rows = [df.transform(lambda d: quality.assess(d, {"doc_id": F.col("doc_id")})).select("row.doc_id", "q.n_words", "kept") for df in (docs, wide)]
    same(*rows)


def test_models(docs, wide):
    model = langid.fit(docs)
    same(langid.predict(docs, model), langid.predict(wide, model))
    machine = toxicity.train(["such an idiot here"] * 8, ["such a day here"] * 8)
    same(toxicity.score(docs, machine), toxicity.score(wide, machine))
    learned, counts = lm.train(wide)
    same(lm.score(docs, learned, counts), lm.score(wide, learned, counts))


def test_row_keepers_return_all_columns(spark, wide):
    none = spark.createDataFrame([], "item_id long, text string")
    for made in (quality.filter_quality(wide), simhash.deduplicate(wide), decontam.clean(wide, none), decontam.clean(wide, none, remove="spans"), pii.pseudonymise(wide)):
        assert made.dtypes == wide.dtypes
        made.collect()
    assert simhash.deduplicate(wide).count() == 3 and decontam.clean(wide, none).count() == len(TEXTS)


def test_chat_ignores_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    more = turns.select("*", *[F.lit(None).cast("string").alias(c) for c in ("turns", "example", "formatted", "n_turns", "has", "v")])
    same(chat.digest(turns), chat.digest(more))
    same(chat.format_examples(turns), chat.format_examples(more))

"""The pipeline's stages, each on what the one before has kept, against brute force."""

import brute
import corpus_pipeline
from brindle.llm import _common, pii
from brindle.llm._common import stored
from brute import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), "test")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    all_docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    good, single, clean, private = kept
    assert set(good) <= {d for d, t in all_docs.items() if not brute.quality(t)[5]}
    # One of each group stays: at the similarity of 0.8, up to what signatures cannot tell near it.
    least, most = (set(brute.similar_groups(good, j).values()) for j in (0.75, 0.85))
    assert least <= set(single) <= most and set(single) == set(brute.similar_groups(good, 0.8).values())
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(clean) == {d for d, w in zip(single, brute.contamination(single.values(), items)) if not w[4]}
    names = pii.Pseudonyms()
    assert private == {d: names(t)[0] for d, t in clean.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p["doc_id"] for p in pieces} == set(private)


def test_run(spark):
    before = set(_common._written)
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    left = [p.rpartition("/")[2].rpartition("-")[0] for p in set(_common._written) - before]
    assert sorted(left) == ["stage-pii", "tokens"]  # files of earlier stages are gone


PROSE = [" ".join(f"word{(i * k) % 97}" for k in range(1, 80)) for i in range(1, 31)]


def through(spark, rows, schema):
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), "test")
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, kept boolean, c0 string, fp string, ids array<int>"


def test_awkward_rows(spark):
    more = (1, None, None, "x", None, [1])
    rows = [(i, t, "en", "web", *more) for i, t in enumerate(PROSE)]
    rows += [(100, None, "en", "web", *more), (101, "", "en", "web", *more), (102, "short", None, None, *more), (None, PROSE[0], None, None, *more), (None, None, None, None, *more)]
    rows += [(3, PROSE[3], "en", "web", *more)] * 3 + [(200, " ".join(f"w{k:05d}" for k in range(30_000)), "en", None, *more)]
    docs, pieces = through(spark, rows, SCHEMA)
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == [*range(len(PROSE)), 200]
    assert {r["doc_id"] for r in pieces.collect()} == {*range(len(PROSE)), 200}


def test_empty_table(spark):
    docs, pieces = through(spark, [], SCHEMA)
    assert docs.count() == 0 and pieces.count() == 0


def test_every_text_rejected(spark):
    docs, pieces = through(spark, [(1, None, None, None, 1, 1, None, "x", None, [1]), (2, "", "en", "web", 1, 1, None, "x", None, [1])], SCHEMA)
    assert docs.count() == 0 and pieces.count() == 0

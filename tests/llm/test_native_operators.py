"""Quality rules, near-duplicates and decontamination against brute force, with awkward rows."""

import random

import brute
import pytest
from brindle.llm import decontam, quality, queries, simhash
from brindle.llm._common import components
from brute import SMALL
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
rng = random.Random(3)
LONG = " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(30_000))
AWKWARD = [None, "", " ", "\n\n", "one", "Two words", "a b c", "a b c a b c", "A\tB\x0bC\x0c d\r\ne", "É É É É", "x\x00y z", "🙂 " * 60, "same line\nsame line\nother\n\nsame line", "# * $ % & | < >", "a " * 70, LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, kept boolean, c0 int, rid int"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 4 else None, 1, "x", None, 7, k) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def test_quality_base_columns(spark):
    found = quality.assess(frame(spark, AWKWARD), {"doc_id": F.col("doc_id")}).collect()
    got = {r["row"]["doc_id"]: (*(r["q"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r["base_failed"]) for r in found}
    assert got == {i: brute.quality(t) for i, t in enumerate(AWKWARD)}
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_quality_whole_table(spark):
    docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op2_quality_rules(spark, SMALL).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == {d: brute.quality(t) for d, t in docs.items()}
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect())
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(good) >= 0.97 * len(good)


def test_quality_kept_against_brute_force(spark):
    """Fences from exact quantiles of all rows, bucket by bucket; sketches are within their accuracy of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality.assess(docs, {c: F.col(c) for c in ("doc_id", "lang", "source")}).select("row.*", quality.rates(F.col("q")).alias("rate"), "base_failed", "kept").collect()
    good = [r for r in found if not r["base_failed"]]
    levels = [{}, {}, {}]
    for r in good:
        for level, key in zip(levels, ((r["lang"], r["source"]), r["lang"], None)):
            level.setdefault(key, []).append(r["rate"])
    checked = 0
    for r in found:
        if r["base_failed"]:
            assert not r["kept"]
            continue
        own = next(x for x in (levels[0][r["lang"], r["source"]], levels[1][r["lang"]], levels[2][None]) if len(x) >= quality.MIN_ROWS or x is levels[2][None])
        sides = []
        for m, (side, least) in quality.MEASURES.items():
            values = sorted(x[m] for x in own)
            rank = lambda tenths: values[-(-len(values) * tenths // 10) - 1]  # noqa: B023, E731
            distance = max(least, quality.SPREAD * abs(rank(5) - rank(1 if side > 0 else 9)))
            slack = quality.ACCURACY * (2 * quality.SPREAD + 1) * max(rank(9), 1e-9)
            beyond = side * (r["rate"][m] - rank(5)) - distance
            sides.append(0 if abs(beyond) <= slack else 1 if beyond > 0 else -1)
        if 1 in sides or 0 not in sides:
            assert r["kept"] == (1 not in sides)
            checked += 1
    assert checked > 0.9 * len(good)


def test_quality_is_repeatable(spark):
    """Fences and verdicts are the same for any partitions and in any run."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = []
    for n in (1, 7, 7):
        measured = docs.repartition(n).select("lang", "source", quality.base_measures(F.col("text")).alias("q"))
        fences = quality.fences(measured.withColumn("rate", quality.rates(F.col("q"))).filter(~quality.base_failed(F.col("q"))))
        kept = quality.assess(docs.repartition(n), {"doc_id": F.col("doc_id")}).select("row.doc_id", "kept")
        seen.append((sorted(map(repr, fences.collect())), sorted(map(tuple, kept.collect()))))
    assert seen[0] == seen[1] == seen[2]


def test_quality_sketch_quantiles(spark):
    """A quantile lies within the accuracy of the exact one, zeros included."""
    r = random.Random(9)
    rate = {m: [0.0 if r.random() < 0.3 else r.lognormvariate(0, 2) for _ in range(500)] for m in quality.MEASURES}
    rows = [("en", "s", tuple(rate[m][i] for m in quality.MEASURES)) for i in range(500)]
    kinds = ", ".join(f"{m}: double" for m in quality.MEASURES)
    df = spark.createDataFrame(rows, f"lang string, source string, rate struct<{kinds}>")
    fence = quality.fences(df, spread=0.0, min_rows=1).first()["fence"]
    for m, (side, least) in quality.MEASURES.items():
        assert fence[m] - side * least == pytest.approx(sorted(rate[m])[249], rel=1.01 * quality.ACCURACY)


def test_quality_thresholds_adapt(spark):
    """A source whose habit is long words keeps them; an outlier in another source goes."""
    plain = [" ".join(f"{w}{k}x{j}" for j, w in enumerate(WORDS * 4)) for k in range(260)]
    long = [t.replace("x", "averylonginfix") for t in plain]
    docs = spark.createDataFrame([(i, t, "en", "plain") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "long") for i, t in enumerate(long)] + [(5000, long[0], "en", "plain")], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.filter_quality(docs).collect()}
    assert kept == {*range(260), *range(1000, 1260)}


def test_quality_empty_and_salted(spark, monkeypatch):
    assert quality.filter_quality(frame(spark, [])).columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert quality.filter_quality(frame(spark, [])).count() == 0
    docs = frame(spark, [f"{LONG[k:k + 3000]}" for k in range(0, 60000, 3000)])
    want = sorted(r["doc_id"] for r in quality.filter_quality(docs).collect())
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    assert sorted(r["doc_id"] for r in quality.filter_quality(docs).collect()) == want


def test_simhash_against_brute_force(spark):
    texts = [*AWKWARD, "a b c", LONG + " end"]
    rows = simhash.near_duplicates(frame(spark, texts)).collect()
    prints = {i: brute.fingerprint(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute.components(prints)


def test_simhash_whole_table(spark):
    docs = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    prints = {d: brute.fingerprint(t) for d, t in docs.items()}
    groups = brute.components(prints)
    assert sorted(map(tuple, queries.op3_simhash_near_dedup(spark, SMALL).collect())) == sorted((d, f"{prints[d]:016x}", groups[d]) for d in docs)


def test_similarity_against_brute_force(spark):
    """Texts with a Jaccard of 0.8 or more on words in fives meet; those well below do not."""
    r = random.Random(8)
    texts = []
    for _ in range(40):
        base = [f"{r.choice(WORDS)}{r.randrange(300)}" for _ in range(r.choice([30, 120, 600]))]
        for edits in (0, 0, 1, 2, len(base) // 60, len(base) // 40, len(base) // 5):
            own = list(base)
            for _ in range(edits):
                own[r.randrange(len(own))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    rows = simhash.with_signature(frame.withColumnRenamed("node", "rid"), "text", ("rid",))
    nodes = rows.groupBy("whole").agg(F.min("rid").alias("node"), F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).withColumn("key", F.xxhash64("whole")).cache()
    found = components(simhash.similar(simhash.candidates(nodes), nodes, frame))
    of = {x["node"]: x["component"] for x in found.collect()}
    kept = sorted(x["node"] for x in nodes.select("node").collect())
    sets = {i: brute.shingles(texts[i]) for i in kept}
    pairs = missed = 0
    for a in kept:
        for b in kept:
            if a < b:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                together = of.get(a, a) == of.get(b, b)
                if j >= 0.8:
                    pairs, missed = pairs + 1, missed + (not together)
                assert not (j < 0.5 and together)
                assert together or j < 0.9
    assert pairs > 80 and missed <= 0.02 * pairs
    groups = brute.similar_groups({i: texts[i] for i in kept}, 0.8)
    assert sum(of.get(i, i) != groups[i] for i in kept) <= 0.02 * len(kept)


def test_deduplicate_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = [sorted(r["doc_id"] for r in simhash.deduplicate(docs.repartition(n)).select("doc_id").collect()) for n in (1, 7)]
    assert kept[0] == kept[1] and len(kept[0]) < docs.count()


def test_deduplicate_loses_no_link_in_large_bands(spark):
    """Pairs about the limit in a family whose texts are nearly similar (0.76): most share only bands of the whole family."""
    r = random.Random(11)
    shared, texts = [f"word{k}" for k in range(204)], []
    for pair in range(200):
        both = shared + [f"pair{pair}x{k}" for k in range(6)]
        texts += [" ".join(both + [f"own{pair}x{side}x{k}" for k in range(25 + pair % 2)]) for side in range(2)]
    r.shuffle(texts)
    groups = brute.similar_groups(dict(enumerate(texts)), 0.8)
    kept = sorted(x["doc_id"] for x in simhash.deduplicate(frame(spark, texts)).select("doc_id").collect())
    assert kept == sorted(set(groups.values())) and len(kept) == 300


@pytest.mark.parametrize("split, sample", [(1, 1), (1000, 10_000)])
def test_candidates_are_whole(spark, monkeypatch, split, sample):
    """Every pair of 0.8 or more is a candidate, however bands are dealt out and whatever the sample knows; the limit is included."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    r = random.Random(12)
    shared = [f"w{k}" for k in range(60)]
    texts = [" ".join([*shared[: r.randrange(5, 60)], *(f"own{r.randrange(9)}" for _ in range(r.randrange(6)))]) for _ in range(150)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "few words", "a a a a a a a", "a a a a a a a a a", ""]
    texts = list(dict.fromkeys(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    known = simhash.frequent_shingles(rows, "text")
    nodes = simhash.with_signature(rows, "text", ("node",), frequent=known).withColumn("key", F.col("node")).cache()
    sets = {x["node"]: brute.shingles(texts[x["node"]]) for x in nodes.select("node").collect() if texts[x["node"]].strip()}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    pairs = simhash.candidates(nodes).cache()
    assert want <= set(map(tuple, pairs.collect()))
    assert set(map(tuple, simhash.similar(pairs, nodes, rows).collect())) == want
    groups = {x["node"]: x["component"] for x in simhash.similar_groups(nodes, rows).collect()}
    brute_groups = brute.similar_groups({i: texts[i] for i in sets}, 0.8)
    assert {i: groups.get(i, i) for i in sets} == brute_groups and len(want) > 100


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_simhash_links_are_whole_for_any_bucket(spark, bucket):
    """Dense clusters: midpoints and pairs tell the same components."""
    r = random.Random(5)
    prints = []
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(25):
            prints.append(centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    found = simhash.groups(fps, bucket=bucket).collect()
    of = {x["fp"]: x["component_id"] for x in found}
    assert {i: of[f] for i, f in enumerate(signed)} == brute.components(dict(enumerate(prints)))


def test_simhash_keeps_one_of_each_group(spark):
    docs = frame(spark, ["a b c d", "A b  c d", "other words here now", None, "", "a b c d"], [5, 3, 9, None, 8, 3])
    rows = simhash.deduplicate(docs).select("doc_id", "rid").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(3, 1), (9, 2), (8, 4)], key=str)
    assert simhash.deduplicate(frame(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(120)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(121)}, **{i: 1000 for i in range(1000, 1051)}}


ITEMS = [(1, "the quick brown fox jumps over the lazy dog today and more"), (2, "short item"), (3, None), (4, "..."), (2, "short item"), (10, "Jumps over the lazy dog today and more words follow here"), (None, "only hit"), (5, "short item")]
DOCS = [None, "", "nothing", "The QUICK, brown fox; jumps over the lazy dog today!! and more", "x short item y short item", "short-item", "jumps over the lazy dog today and more words follow here", "an only hit", "the quick brown fox jumps over the lazy dog", LONG]


@pytest.mark.parametrize("limits", [{}, {"SET_BYTES": 10}, {"SET_WINDOWS": 0}, {"SET_WINDOWS": 0, "BROADCAST_BYTES": 0}])
def test_decontamination_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(decontam, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, DOCS)
    want = brute.contamination(DOCS, ITEMS)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.report(docs, items).collect()}
    assert got == dict(enumerate(want))
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [i for i, w in enumerate(want) if not w[4]]
    spans = {r["doc_id"]: r["text"] for r in decontam.clean(docs, items, remove="spans").collect()}
    assert spans[0] is None and spans[2] == "nothing" and spans[4].split() == ["x", "y"] and spans[7].strip() == "an" and spans[9] == LONG
    assert not any(w[4] for w in brute.contamination(spans.values(), ITEMS))


def test_decontamination_of_large_sets_stores_no_windows(spark, monkeypatch):
    """Beyond the plan's set hashes are looked up: what is stored is about the text once, not each window of it."""
    from brindle.llm import _common

    def size(path):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()

    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontam.report(docs, items).collect()))
    monkeypatch.setattr(decontam, "SET_WINDOWS", 0)
    before = set(_common._written)
    assert sorted(map(tuple, decontam.report(docs, items).collect())) == want
    made = sum(size(p) for p in set(_common._written) - before if "windows" not in p)
    assert made < 1.3 * size(f"{SMALL}/documents.parquet")


def test_decontamination_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.report(frame(spark, []), items).count() == 0
    assert [r["contaminated"] for r in decontam.report(frame(spark, ["short item"]), items.limit(0)).collect()] == [False]
    assert decontam.report(frame(spark, ["short item", "short item"], [None, None]), items).count() == 2


def test_decontamination_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, brute.contamination([d["text"] for d in docs], items))}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op4_decontamination(spark, SMALL).collect()} == want


def test_native_operators_run_no_python(spark):
    for df in (queries.op2_quality_rules(spark, SMALL), queries.op4_decontamination(spark, SMALL)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quality_fences_of_few_rows(spark):
    """Fewer than MIN_ROWS rows in all have the fence of everything."""
    clean = [" ".join(f"word{(i * k) % 97}" for k in range(1, 80)) for i in range(1, 21)]
    junk = " ".join(f"word{k} ###$$$" for k in range(1, 80))
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate([*clean, junk])], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality.filter_quality(docs).select("doc_id").collect()} == set(range(20))
    assert quality.filter_quality(docs.limit(0)).count() == 0

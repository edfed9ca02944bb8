"""Language identification, toxicity and language-model scoring: exact parts, properties, held-out quality."""

import math
import random
import zlib

import brute
import numpy as np
import pytest
from brindle.llm import langid, lm, queries, toxicity
from brute import SMALL

LARGER = "/root/testdata/sf0.01"


def held(d, modulus, r):
    return zlib.crc32(str(d).encode()) % modulus == r


def test_langid_held_out(spark):
    lang = dict(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect())
    rows = queries.op9_language_id(spark, LARGER).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: held(d, 5, 0) for d in lang}
    tested = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(tested) >= 0.98 * len(tested) and all(0 <= r["score"] <= 1 for r in rows)


def test_langid_rows(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "text", None), (5, "12 !", "en"), (6, "the cat", "en")] * 3, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert set(model.languages) == {"en", "de"}
    texts = [None, "", "123 ...", "the cat", "und der hund", "é", "the " * 300_000]
    got = model(texts)
    assert [g[0] for g in got[:5]] == ["und", "und", "und", "en", "de"] and got[5][0] in ("en", "de") and got[6][0] == "en"
    assert langid.fit(docs.limit(0))(["x"])[0][:2] == ("und", 0.0)
    asked = spark.createDataFrame([(None, "the cat", 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, score int")
    assert [r["lang_pred"] for r in langid.predict(asked, model).collect()] == ["en", "und", "und"]
    assert langid.predict(asked.limit(0), model).count() == 0


def test_langid_does_not_depend_on_partitions(spark):
    """Rows of one hot text, more texts than the sample, 1 and 7 partitions: the same model and the same results."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    hot = docs.limit(1).crossJoin(spark.range(400).select("id")).select("doc_id", "text", "lang")
    docs = docs.unionByName(hot)
    models = [langid.fit(docs.repartition(n), sample=100) for n in (1, 7)]
    assert (models[0].centres == models[1].centres).all() and models[0].languages == models[1].languages and (models[0].bounds == models[1].bounds).all()
    rows = [sorted(map(tuple, langid.predict(docs.repartition(n), m).distinct().collect())) for n, m in zip((1, 7), models)]
    assert rows[0] == rows[1]


def test_langid_is_the_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    for r in docs.limit(60).collect():
        if r["text"] and langid.has_letter(r["text"]):
            data = f" {r['text'].lower()} ".encode().translate(langid.LETTERS)
            x = np.zeros(langid.DIMS)
            full = langid.counts(r["text"])
            assert full.sum() == 3 * len(data) - 3
            x[:] = np.log(1 + full) * model.idf
            near = x @ model.centres.astype(np.float64) / np.linalg.norm(x)
            lang, score, _ = model.one(r["text"])
            assert score == pytest.approx(near.max(), abs=1e-4) and near[[c for c, n in enumerate(model.languages) if n == lang]].max() == pytest.approx(near.max(), abs=1e-5)


def kernel(a, b, p=3):
    """The gap-weighted subsequence kernel by its definition."""
    from itertools import combinations

    def phi(s):
        out = {}
        for t in combinations(range(len(s)), p):
            if t[-1] - t[0] < toxicity.SPAN:
                key = "".join(s[i] for i in t)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (t[-1] - t[0] + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda u, v: sum(w * v.get(k, 0) for k, w in u.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_string_kernel_is_the_definition():
    words = ["idiot", "idxiot", "stupid", "ororon", "abc", "aaaaaa", "worthles", "idi"]
    columns = toxicity.dense(words)
    got = toxicity.kernel_to(words, columns)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(kernel(a, b), abs=1e-5), (a, b)


def synthetic(n, seed):
    r = random.Random(seed)
    syllables = ["ha", "on", "the", "er", "ti", "re", "an", "sh", "ble", "is", "st", "ou", "nd", "in"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(r.randrange(20, 90))) for _ in range(n)]
    insults = ["idiot", "scum", "worthless", "moron"]
    toxic = []
    for t in texts[: n // 2]:
        w = t.split()
        w.insert(r.randrange(len(w)), r.choice(insults) + r.choice(["", ".", ","]))
        toxic.append(" ".join(w))
    return toxic, texts[n // 2 :]


def test_toxicity_tolerates_gaps_and_insertions():
    machine = toxicity.train(*synthetic(600, 1))
    bad, good = synthetic(200, 2)
    assert np.mean(np.array(machine(bad)) >= 0.3) > 0.97 and np.mean(np.array(machine(good)) >= 0.3) < 0.03
    variants = ["you id-iot here", "such a w.o.r.t.h.l.e.s.s thing", "you i d i o t now", "what an idiiot", "the m0ron", "an ID*IOT", "worthhless person"]
    assert [v for v, s in zip(variants, machine(variants)) if s < 0.3] == []
    calm = machine([None, "", "   ", "the shed is on the hill", "!" * 50])
    assert max(calm) < 0.3 and min(calm) >= 0


def plain_value(machine, word):
    """The greatest value of a word's windows by the definition of the features."""
    from itertools import combinations

    codes = [c for c in map(toxicity._letter, word) if c]
    best = 0.0
    for low in range(max(1, len(codes) - toxicity.WINDOW + 1)):
        window = codes[low : low + toxicity.WINDOW]
        phi = {}
        for t in combinations(range(len(window)), 3):
            if t[-1] - t[0] < toxicity.SPAN:
                key = tuple(window[i] for i in t)
                phi[key] = phi.get(key, 0) + toxicity.DECAY ** (t[-1] - t[0] + 1)
        if phi:
            total = sum(v * machine.weights[(a * toxicity.ALPHABET + b) * toxicity.ALPHABET + c] for (a, b, c), v in phi.items())
            best = max(best, total / math.sqrt(sum(v * v for v in phi.values())))
    return best


def test_toxicity_scores_by_definition():
    """Scores are exact, also of words whose letters come again."""
    machine = toxicity.train(*synthetic(400, 6))
    texts = ["the idiot is here", "aaaaaaaa onon onononon", "mississippi scumscum", "worthhhhless", "idid id id-idid toto moromoro", "plain words only", ""]
    for text, score in zip(texts, machine(texts)):
        f = min(1.0, max((plain_value(machine, w) for w in toxicity.instances(text)), default=0.0) + machine.bias)
        assert score == pytest.approx(1 / (1 + math.exp(-(machine.slope * f + machine.shift))), abs=1e-6), text


def test_toxicity_rows(spark):
    assert toxicity.train([], [])(["x", None]) == [0.0, 0.0]
    machine = toxicity.train(*synthetic(300, 3))
    docs = spark.createDataFrame([(1, "you idiot", 1), (None, None, 1), (1, "you idiot", 1), (2, "fine words " * 40_000, 1), (2, "fine words", 1)], "doc_id long, text string, score int")
    rows = toxicity.score(docs, machine).collect()
    assert [r["predicted"] for r in rows] == [1, 0, 1, 0, 0] and rows[0]["score"] == rows[2]["score"]
    assert toxicity.score(docs.limit(0), machine).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (None, 1), (3, 0)], "doc_id long, toxic int")
    bad, good = toxicity.sample(docs, labels)
    assert (bad, good) == (([] if held(2, 4, 2) else ["fine words"]), [])  # texts beyond FIT_BYTES are scored, not learned from


def test_toxicity_whole_table(spark):
    labels = dict(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic").collect())
    rows = queries.op6_toxicity(spark, LARGER).collect()
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    clean = [r["predicted"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(clean) <= 0.02 * len(clean)
    # Two in five toxic documents of this table have no insult that another one has.
    unseen = [r["predicted"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1]
    assert len(unseen) > 5 and sum(unseen) >= 0.5 * len(unseen)
    insults = {"idiot", "scum", "trash", "clown", "loser"}
    texts = dict(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect())
    assert all(r["predicted"] for r in rows if insults & {w.strip(".,") for w in (texts[r["doc_id"]] or "").lower().split()})


def test_lm_base_is_exact_and_training_beats_its_start(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.base_scores(docs)
    rows = queries.op8_lm_scoring(spark, LARGER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n_tokens, n_known, n, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n_tokens, n_known, n, held(r["doc_id"], 7, 2))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    # Before training the score is the base (the next test), so the gain is all the training's.
    own = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) + 0.25 * sum(r["n_tokens"] for r in own)


def test_lm_starts_at_the_base_and_each_update_helps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    mine = docs.filter("doc_id % 5 <> 0")
    start, counts = lm.train(mine, epochs=0)
    rows = lm.score(docs, start, counts).collect()
    assert all(r["score"] == pytest.approx(r["base_score"], abs=1e-6 * (100 + abs(r["base_score"]))) for r in rows)
    squares, network = np.zeros(start.network.weights.shape), start.network
    other = docs.filter("doc_id % 5 = 0")
    logs = [sum(r["score"] for r in lm.score(other, start, counts).collect())]
    for _ in range(2):
        lm.update(network, mine.select("text"), 1, squares, lm.RATE)
        logs.append(sum(r["score"] for r in lm.score(other, start, counts).collect()))
    assert logs[0] < logs[1] < logs[2]


def test_lm_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    found = []
    for n in (1, 7):
        model, counts = lm.train(docs.repartition(n))
        found.append((model, sorted((r["doc_id"], r["score"], r["base_score"]) for r in lm.score(docs.repartition(n), model, counts).collect())))
    assert (found[0][0].network.weights == found[1][0].network.weights).all() and np.abs(found[0][0].network.weights).max() > 0.4
    assert all(x[0] == y[0] and x[1] == pytest.approx(y[1], rel=1e-12) and x[2] == pytest.approx(y[2], rel=1e-12) for x, y in zip(found[0][1], found[1][1]))


def test_lm_sums_are_a_tree(spark, monkeypatch):
    """Many partial sums meet in several levels and are exact."""
    monkeypatch.setattr(lm, "FAN", 2)
    texts = spark.createDataFrame([(str(i),) for i in range(100)], "text string").repartition(40)

    def fill(batches, total):
        for batch in batches:
            for t in batch:
                total[int(t)] += 1 << 40
                total[7] -= 3

    want = np.full(130, 1 << 40, np.int64)
    want[100:] = 0
    want[7] -= 300
    assert (lm._summed(texts, 40, 130, fill, blocks=9) == want).all()
    x = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 1000)
    assert (lm.unpack(lm.pack(x)) == x).all()


def test_lm_is_a_distribution(spark):
    """Probabilities of all outcomes after a history sum to one."""
    r = random.Random(4)
    words = ["w%d" % i for i in range(700)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=60))) for i in range(60)], "doc_id long, text string")
    model, counts = lm.train(docs)
    assert np.abs(model.network.weights).max() > 0.4
    seen = [bytes(x["word"]).decode() for x in counts.collect()]
    assert len(seen) > lm.OWN * lm.MEMBERS  # words of their own and shared members
    asked = spark.createDataFrame([(i, f"w1 w2 {w}") for i, w in enumerate([*seen, "unseen"])] + [(-1, "w1 w2"), (-2, None)], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in lm.score(asked, model, counts).collect()}

    def third(text):
        t = lm.Tokens([text])
        return (model.values(t) + model.log_count[model.head(t.hash)])[2]

    total = 10 ** third("w1 w2") + sum(10 ** third(f"w1 w2 {w}") for w in seen) + 10**-model.log_all
    assert total == pytest.approx(1, abs=1e-4)
    t = lm.Tokens(["w1 w2"])
    assert got[-1] == pytest.approx((model.values(t) + model.log_count[model.head(t.hash)]).sum(), abs=1e-9) and got[-2] < 0
    assert got[len(seen)] == pytest.approx(got[-1] - third("w1 w2") - model.log_all + _end_after(model, "w1 w2 unseen"), abs=1e-9)


def _end_after(model, text):
    t = lm.Tokens([text])
    return (model.values(t) + model.log_count[model.head(t.hash)])[-1]


def test_lm_batches_are_bounded_in_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "BATCH_BYTES", 10)
    texts = ["abc", None, "", "defgh", "x" * 50, "y", "z" * 10, "w" * 11, None]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = [b.column(1).to_pylist() for b in lm._batches(iter([whole, whole.slice(0, 0)]), 4, 1)]
    assert [t for p in parts for t in p] == texts and all(len(p) <= 4 for p in parts)
    assert all(sum(len(t or "") for t in p) <= 10 or len([t for t in p if t]) == 1 for p in parts)


def test_lm_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (3, ""), (4, "x " * 100_000), (5, "É é A\x0bb")], "doc_id long, text string")
    model, counts = lm.train(docs.filter("doc_id = 1"))
    rows = lm.score(docs, model, counts).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 3, 3, 5, 100_001]
    assert {r["train_tokens"] for r in rows} == {6}
    assert lm.score(docs.limit(0), model, counts).count() == 0
    empty, none = lm.train(docs.limit(0))
    assert {r["score"] for r in lm.score(docs, empty, none).collect()} == {0.0}


def test_lm_tail_is_joined(spark):
    """With a head of three words the scores are the same."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(40)
    model, counts = lm.train(docs)
    want = {r["doc_id"]: r for r in lm.score(docs, model, counts).collect()}
    model.head = lm.Head(np.append(model.head.hashes[:3], lm.END), np.append(model.head.counts[:3], model.head.counts[-1]))
    model.log_count = np.log10(model.head.counts + 1)
    got = {r["doc_id"]: r for r in lm.score(docs, model, counts).collect()}
    assert got.keys() == want.keys()
    for d, r in got.items():
        assert r["n_known"] == want[d]["n_known"] and r["base_score"] == pytest.approx(want[d]["base_score"], rel=1e-12) and r["score"] == pytest.approx(want[d]["score"], rel=1e-12)


def test_lm_gradient_takes_every_token(spark):
    """One epoch gives each group's sum over all its tokens, ends and short texts too, of what a loop over tokens gives."""
    texts = ["a", "", "a b", "c a b d", None, *[" ".join("w%d" % (i * k % 23) for k in range(5 + i)) for i in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = lm.train(docs, epochs=0)
    network = model.network
    rng = np.random.default_rng(2)
    network.weights[:] = rng.normal(size=network.weights.shape) * 0.3
    t = lm.Tokens(texts)
    leaf, keys = network.leaves(t.hash, t.cell), t.features()
    y, m = leaf // lm.MEMBERS, leaf % lm.MEMBERS
    both = ((y, lm.rows_of(keys), np.broadcast_to(network.class_share, (len(y), lm.CLASSES))), (m, lm.rows_of(keys, y), network.member_share[y]))
    want = np.zeros((2, lm.MEMBERS, lm.FEATURES << lm.BITS))
    for k, (target, rows, share) in enumerate(both):
        for i in range(len(target)):
            at = [r[i] for r in rows]
            z = network.weights[k][at].sum(axis=0, dtype=np.float64) + share[i]
            g = -np.exp(z) / np.exp(z).sum()
            g[target[i]] += 1
            for a in at:
                want[k, :, a] += g
    got = np.zeros(network.weights.size)
    network.gradient(iter([texts[:20], texts[20:]]), got)
    got = got.reshape(want.shape)
    assert (got == np.rint(got)).all() and np.abs(got / lm.SCALE - want).max() < len(y) / lm.SCALE
    assert np.abs(got / lm.SCALE - want).mean() < 0.02
    groups = docs.selectExpr(f"pmod(xxhash64(text), {lm.GROUPS}) as g", "text").groupBy("g").count().collect()
    assert sum(r["count"] for r in groups) == len(texts)
    end = network.leaves.end
    assert got[1, end % lm.MEMBERS].any()  # so few words are all in one class

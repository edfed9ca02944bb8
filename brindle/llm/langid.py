"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams (one to three bytes of its lowered
letters; the rest are spaces), weighted by log term frequency and inverse
document frequency and normalised.  Each language has several centroids, found
by spherical k-means; a text takes the language of the centroid of
greatest cosine.  A text farther from its centroid than nearly all of that
centroid's own texts is marked as rejected.

Document frequencies count all training documents.  Centroids are fitted on a sample
of up to ``SAMPLE`` different texts a language: those of least hash, so the sample, and with it the model, does not
depend on partitions.  Its vectors, not its texts, meet in a task for each language, so
that task's memory is bounded.  A text's score is computed from that text alone.

Defined results: ``und`` with score 0 for null texts, for texts without a
letter, and for all texts if nothing was learned; rows with a null language are
not learned from; a text of any length is taken whole, in parts; equal texts, and so repeated rows, have equal results; ties go to the language that
sorts first; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 13
DIMS = 1 << BITS
CENTROIDS = 4
#: Bound of the fit: so many different texts of each language.
SAMPLE = 1000
ROUNDS = 12
#: Share of a centroid's own texts that lie beyond its rejection distance.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
PART = 1 << 22
#: ASCII letters and all bytes of other characters stay, the rest are spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    data = f" {text.lower()} ".encode("utf-8", "surrogatepass").translate(LETTERS)
    total = np.zeros(DIMS, np.int64)
    for low in range(0, len(data), PART):
        b = np.frombuffer(data[low : low + PART + 2], np.uint8).astype(np.uint32)
        end = min(PART, len(data) - low)
        one = b * np.uint32(2654435761)
        two = (one[:-1] ^ np.uint32(0x9E3779B9)) + b[1:] * np.uint32(2246822519)
        three = (two[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(3266489917) + b[2:] * np.uint32(668265263)
        for h in (one, two, three):
            total += np.bincount((h[:end] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS), minlength=DIMS)
    return total


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams that occur, how often)."""
    found = counts(text)
    dims = np.nonzero(found)[0]
    return dims, found[dims]


def weighted(dims: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of a text's n-grams as a unit vector."""
    x = np.log1p(n) * idf[dims]
    return (x / max(1e-9, float(np.sqrt((x * x).sum())))).astype(np.float32)


def _training(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null and lang is not null").select("text", "lang")


def _frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies and the number of documents, over all of ``training``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found += counts(text) > 0
                n += 1
        dims = np.append(np.nonzero(found)[0], -1)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(np.append(found[dims[:-1]], n), pa.int64())], ["dim", "n"])

    # At most DIMS + 1 rows come to the driver, however many documents there are.
    rows = training.select("text").mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS), 0
    for dim, count in rows:
        if dim < 0:
            n = count
        else:
            df[dim] = count
    return df, n


def fit_centroids(x: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the unit vectors ``x`` and the least cosine of nearly all of each one's own."""
    rng = np.random.default_rng(7)
    chosen = [int(rng.integers(len(x)))]
    for _ in range(min(k, len(x)) - 1):  # the farthest from those chosen so far
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    near = x @ centres.T
    own = near.argmax(axis=1)
    bounds = [np.quantile(near[own == j, j], REJECTED_SHARE) if (own == j).any() else 0.0 for j in range(len(centres))]
    return centres, np.array(bounds)


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, bounds: np.ndarray):
        self.idf, self.languages, self.bounds = idf, languages, bounds
        #: A row for each n-gram, so that a text takes those of its own.
        self.centres = np.ascontiguousarray(centres.T)

    def one(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        dims, n = sparse(text)
        near = (self.centres[dims] * weighted(dims, n, self.idf)[:, None]).sum(axis=0)
        best = int(near.argmax())
        return self.languages[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.bounds[best])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        return [self.one(t) for t in texts]


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from the texts and non-null languages of ``docs`` (columns text, lang)."""
    training = _training(docs)
    df, n = _frequencies(training)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    # Each different text counts once; those of least hash are drawn, about twice the sample of each language.
    hashed = training.withColumn("h", F.xxhash64("text"))
    rank = F.shiftrightunsigned("h", 1)
    sizes = {r["lang"]: r["n"] for r in hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros(0))
    limits = {lang: min((1 << 63) - 1, (1 << 63) * 2 * sample // size) for lang, size in sizes.items()}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]
    drawn = hashed.filter(rank <= limit).select("lang", "h", "text").distinct()

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [(lang, h, *sparse(t)) for lang, h, t in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(t)]
            lang, h, dims, n = zip(*known) if known else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array([d.astype(np.int32).tobytes() for d in dims], pa.binary()), pa.array([x.astype(np.int64).tobytes() for x in n], pa.binary())], ["lang", "h", "dims", "n"])

    def clusters(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "dims", "n"])[:sample]
        x = np.zeros((len(group), DIMS), np.float32)
        for i, (dims, n) in enumerate(zip(group["dims"], group["n"])):
            at = np.frombuffer(dims, np.int32)
            x[i, at] = weighted(at, np.frombuffer(n, np.int64), idf)
        centres, bounds = fit_centroids(x, k)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tolist() for c in centres], "bound": bounds})

    vectors = drawn.mapInArrow(vector, "lang string, h long, dims binary, n binary")
    rows = vectors.groupBy("lang").applyInPandas(clusters, "lang string, centre array<float>, bound double").collect()  # k rows a language
    rows.sort(key=lambda r: (r["lang"], r["bound"], r["centre"]))
    return Model(idf, [r["lang"] for r in rows], np.array([r["centre"] for r in rows], np.float32).reshape(-1, DIMS), np.array([r["bound"] for r in rows]))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred, score and rejected; only the text decides."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # DIMS floats for each centroid
    frame = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                lang, score, far = zip(*shared.value(batch.columns[-1].to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], schema.names)

    return frame.mapInArrow(run, schema)

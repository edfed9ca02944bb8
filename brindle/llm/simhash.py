"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the
hashes of its word shingles.  Fingerprints that differ in at most ``distance``
bits are linked.  They are split into ``blocks`` blocks; a close pair agrees in
``blocks - distance`` of these at least, so fingerprints are joined on each
choice of that many blocks and the Hamming distance of what meets is verified.

Only distinct fingerprints are joined: copies are grouped before, however many
there are.  A bucket of up to ``BUCKET`` fingerprints is joined with itself.
The fingerprints of larger buckets are never paired: two differ in
at most two bits exactly if they share a midpoint, that is a value one bit away
or equal, so each emits its 65 midpoints, and what meets at one
(65 fingerprints at most) is linked as a star.  No link is lost.

``deduplicate`` is about texts whose sets of five-word shingles have a similarity
(Jaccard) of 0.8 or more.  Such texts differ in about ten of 64 bits, and no choice of pigeonhole blocks both finds
them and parts the others, so what the blocks find is verified and an exact join finds the rest.  All shingles have
one order, those a bounded sample of the texts knows as frequent last; two similar texts share one of the first
shingles of each (a fifth of them, ``bands``), and the places of the first that they share bound what else
they can share.  First each text meets the hub of each band; then, in bands of any size, all texts
that these links have not joined yet meet.  The sample and the order change the time only.  A lower bound of the difference
(512 counts of shingles, ``sig``) leaves out pairs, and the shingles decide the others: no link is lost and none is guessed.
The time is square in the texts of a band only as far as they are in different groups.

Defined results: a null or empty text and one without words have fingerprint
zero and are linked as any other; with fewer words than a shingle, the whole
sequence is the shingle; a text of any length is taken whole, in parts; null ids never name a component unless all its ids are
null; repeated rows are linked; an empty table gives no rows; extra columns are
kept by ``deduplicate`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import components, discard, stored

SEED = 42
SHINGLE = 3
DISTANCE = 2
BLOCKS = 5
BUCKET = 32
#: Hashes whose bits are counted at once; a longer text is counted in parts.
PART = 1 << 15
#: For whole texts: words of a shingle, least similarity, and counters of shingles.
WIDE_SHINGLE, SIMILARITY, COUNTERS = 5, 0.8, 512
#: Texts of the sample, at about, and shingles known as frequent, at most; both concern the time only.
SAMPLE, FREQUENT = 10_000, 1 << 16
#: Bands looked back on, so that two texts that share many meet in few.
BEFORE = 4
#: Rows of a band that meet the others in one part.
SPLIT = 1000


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only


def _digests(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles as rows of eight bytes, in parts."""
    from xxhash import xxh64_digest

    if words and len(words) <= shingle:
        yield np.frombuffer(xxh64_digest(b" ".join(words), SEED), np.uint8).reshape(1, 8)
        return
    n = len(words) - shingle + 1
    for low in range(0, n, PART):
        columns = [words[low + k : min(n, low + PART) + k] for k in range(shingle)]
        yield np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in map(b" ".join, zip(*columns))]), np.uint8).reshape(-1, 8)


def _majority(parts: list[np.ndarray]) -> int:
    """The fingerprint of hashes as a signed 64-bit integer."""
    counts, n = np.zeros(64, np.int64), 0
    for x in parts:
        counts += np.unpackbits(x, axis=1).sum(axis=0, dtype=np.int32)
        n += len(x)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return _majority(_digests(_words(text), shingle))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The different hashes of parts, in order."""
    return np.unique(np.concatenate([x.view(">u8").ravel() for x in parts]).astype(np.uint64)) if parts else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> bytes:
    """Their number (four bytes) and how many fall to each counter (a byte, 255 for more)."""
    counts = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=COUNTERS)
    return len(hashes).to_bytes(4, "big") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def prefix(hashes: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first of the hashes in the order of all shingles, so many that similar texts share one."""
    if not len(hashes):
        return hashes
    if frequent is not None and len(frequent[0]):
        known, counts = frequent
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _fingerprints(column) -> pa.Array:
    return pa.array([fingerprint(t) for t in column.to_pylist()], pa.int64())


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` of each row."""
    frame = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _fingerprints(batch.columns[-1])], [*keep, "fp"])

    return frame.mapInArrow(run, schema)


def _keys(blocks: int, distance: int) -> list[tuple[int, int]]:
    """(number, mask) of each choice of blocks that a close pair may share."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    out = []
    for number, chosen in enumerate(combinations(masks, blocks - distance)):
        mask = sum(chosen)
        out.append((number, mask - (1 << 64) if mask >> 63 else mask))
    return out


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp``, enough to tell all components.

    Buckets of up to ``bucket`` give each of their links; larger ones give stars of links.
    """
    if distance != 2:
        raise ValueError("midpoints tell fingerprints of distance two at most")
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in _keys(blocks, distance)])
    keyed = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stored(sizes, "buckets")
    few = keyed.join(sizes.filter(F.col("n") <= bucket).drop("n"), ["k", "v"])
    a, b = few.alias("a"), few.alias("b")
    close = (
        a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")))
        .filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )
    many = keyed.join(sizes.filter(F.col("n") > bucket).drop("n"), ["k", "v"]).select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    met = many.select("fp", F.explode(points).alias("mid")).groupBy("mid").agg(F.collect_set("fp").alias("s")).filter(F.size("s") > 1)
    stars = met.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).filter("a <> b")
    return close.unionByName(stars).distinct()


def groups(fingerprinted: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """(fp, component_id, root): for each distinct fingerprint the smallest id that it reaches."""
    fps = stored(fingerprinted.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    found = components(links(fps, **kw))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``."""
    prints = stored(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "prints")
    found = groups(prints, **kw)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def frequent_shingles(docs: DataFrame, text_col: str, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that texts of a sample, drawn by hash, have in common, in order, and in how many each is."""
    some = max(1, -(-docs.count() // SAMPLE))
    drawn = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter(F.pmod("h", F.lit(some)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(list(_digests(_words(text), shingle))).view(np.int64))], ["s"])

    shared = drawn.groupBy("h").agg(F.first("text").alias("text")).select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    found = shared.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()
    known, counts = np.array([r["s"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(known)
    return known[order], counts[order]


def with_signature(
    docs: DataFrame, text_col: str, keep: tuple[str, ...], shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, frequent: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """The columns ``keep``, whole (128 bits that tell a text's words), fp, sig and bands of each row."""
    frame = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep).schema.add("whole", "binary").add("fp", "long").add("sig", "binary").add("bands", T.ArrayType(T.LongType()))

    def of(text: str | None) -> tuple[bytes, int, bytes, np.ndarray]:
        from xxhash import xxh3_128_digest

        words = _words(text)
        parts = list(_digests(words, shingle))
        hashes = _distinct(parts)
        return xxh3_128_digest(b" ".join(words)), _majority(parts), signature(hashes), prefix(hashes, similarity, frequent).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                *found, bands = zip(*map(of, batch.columns[-1].to_pylist()))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, bands)], dtype=np.int32), np.concatenate(bands))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, k) for x, k in zip(found, (pa.binary(), pa.int64(), pa.binary()))), lists], schema.names)

    return frame.mapInArrow(run, schema)


def bands(texts: DataFrame) -> DataFrame:
    """(band, key, n, i, alone, before): texts (key, sig, bands) in each band of several.

    Their number of shingles, the band's place among them, how many bands of the text are its own and the last ``BEFORE`` bands of several before this.
    """
    n = F.conv(F.hex(F.substring("sig", 1, 4)), 16, 10).cast("long")
    keyed = texts.select("key", n.alias("n"), F.size("bands").alias("all"), F.posexplode("bands").alias("i", "band"))
    several = keyed.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    own = Window.partitionBy("key")
    before = F.collect_list("band").over(own.orderBy("i").rowsBetween(-BEFORE, -1))
    return keyed.join(several, "band").select("band", "key", "n", "i", (F.col("all") - F.count("*").over(own)).alias("alone"), before.alias("before"))


def _possible(a: str, b: str, similarity: float):
    """Whether this may be the first band that two texts share and they may be similar: no more than what follows is shared."""
    most = F.least(F.expr(f"{a}.n - {a}.i"), F.expr(f"{b}.n - {b}.i"))
    return (most * (1 + similarity) >= similarity * F.expr(f"{a}.n + {b}.n") - 1e-6) & ~F.arrays_overlap(f"{a}.before", f"{b}.before")


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hubs(met: DataFrame) -> DataFrame:
    """(band, hub): in each band the text that has the fewest bands of its own, likely the one that others are copied from."""
    return met.groupBy("band").agg(F.min(F.struct("alone", "key", "n", "i", "before")).alias("hub"))


def leading(texts: DataFrame, met: DataFrame, similarity: float = SIMILARITY, **kw) -> DataFrame:
    """(a, b): keys of different texts (key, fp) that share a fingerprint's block, or one of the bands ``met`` with its hub, a < b.

    A text has a bounded number of them in each block and band; ``candidates`` has the rest.
    """
    by_print = texts.groupBy("fp").agg(F.min("key").alias("least"))
    same = texts.join(by_print, "fp").select(F.col("least").alias("a"), F.col("key").alias("b"))
    near = links(by_print.select("fp"), **kw)
    ends = [by_print.select(F.col("fp").alias(c), F.col("least").alias(f"n{c}")) for c in ("a", "b")]
    close = near.join(ends[0], "a").join(ends[1], "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    star = met.alias("x").join(_hubs(met), "band").filter(_possible("x", "hub", similarity)).select(F.col("hub.key").alias("a"), F.col("x.key").alias("b"))
    return _pairs(same.unionByName(close).unionByName(star))


def candidates(texts: DataFrame, similarity: float = SIMILARITY, met: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(a, b): keys of all texts (key, sig, bands) that may be similar, a < b.

    After ``leading`` only those in different ``groups`` (key, group) and without a band's hub.  In each band the texts
    outside its largest group meet all others; large bands are dealt out in parts.
    """
    met = bands(texts) if met is None else met
    if groups is None:
        own = met.withColumn("group", F.col("key"))
    else:
        own = met.join(_hubs(met).select("band", F.col("hub.key").alias("hub")), "band").filter("key <> hub").drop("hub").join(groups, "key")
    own = stored(own, "band-groups")
    sizes = own.groupBy("band", "group").agg(F.count("*").alias("c")).groupBy("band")
    sizes = sizes.agg(F.max(F.struct("c", "group")).alias("m"), F.sum("c").alias("rows"), F.count("*").alias("k")).filter("k > 1")
    several = own.join(sizes.select("band", F.col("m.group").alias("main"), F.ceil(F.col("rows") / SPLIT).alias("parts")), "band")
    some = several.filter("group <> main").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
    every = several.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = F.expr("x.band = y.band and x.part = y.part and x.group <> y.group and (y.group = y.main or x.key < y.key)")
    meet = some.alias("x").join(every.alias("y"), both & _possible("x", "y", similarity))
    return _pairs(meet.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")))


def alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): nodes of the texts (key, node, sig) of those ``pairs`` whose counters do not differ by more than similar texts may."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(texts.select(F.col("key").alias(c), F.col("node").alias(f"n{c}"), F.col("sig").alias(f"s{c}")), c)
    both = both.select("na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 4 + COUNTERS) for k in (2, 3)]
                number = sum(np.ascontiguousarray(x[:, :4]).view(">u4").ravel().astype(np.int64) for x in sides)
                apart = np.abs(sides[0][:, 4:].astype(np.int16) - sides[1][:, 4:]).sum(axis=1, dtype=np.int64)
                may = apart * (1 + similarity) <= number * (1 - similarity) + 1e-6
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(may))

    return both.mapInArrow(run, "a long, b long")


def jaccard(a: str | None, b: str | None, shingle: int = WIDE_SHINGLE) -> float:
    """The similarity of the sets of shingles of two texts."""
    x, y = (_distinct(list(_digests(_words(t), shingle))) for t in (a, b))
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def similar(pairs: DataFrame, texts: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(a, b): nodes of the texts (key, node, sig) of those ``pairs`` that are similar; ``rows`` (node, text) has the texts."""
    near = stored(alike(pairs, texts, similarity), "alike")
    # Only texts that such a pair needs are moved.
    ids = stored(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "near")
    needed = stored(rows.join(ids, "node", "left_semi").select("node", "text"), "near-texts")
    for c in ("a", "b"):
        near = near.join(needed.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(a.as_py(), b.as_py(), shingle) >= similarity for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def similar_groups(texts: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, **kw) -> DataFrame:
    """(node, component): the groups that all similar pairs of the texts make; texts without one are left out."""
    met = stored(bands(texts), "bands")
    found = stored(similar(stored(leading(texts, met, similarity, **kw), "pairs"), texts, rows, similarity, shingle), "links")
    first = components(found)
    groups = texts.select("key", "node").join(first, "node", "left").select("key", F.coalesce("component", "node").alias("group"))
    rest = stored(candidates(texts, similarity, met, groups), "pairs")
    if rest.isEmpty():
        return first
    return components(found.unionByName(similar(rest, texts, rows, similarity, shingle)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, **kw) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (nulls last), the first of these if they are repeated."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    # Row numbers are stored with the rows: computed anew they might change.
    rows = stored(plain.withColumn("rid", F.monotonically_increasing_id()), "rows")
    prints = stored(with_signature(rows, text_at, ("rid", id_at), shingle, similarity, frequent_shingles(rows, text_at, shingle)), "prints")
    # Copies are one text from here on, however many there are.
    first = F.min(F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).alias("id"), "rid")).alias("m")
    texts = stored(prints.groupBy("whole").agg(first, F.min("rid").alias("node"), F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).withColumn("key", F.xxhash64("whole")).drop("whole"), "texts")
    discard(prints)
    whole = rows.select(F.col("rid").alias("node"), F.col(text_at).alias("text"))
    found = similar_groups(texts, whole, similarity, shingle, **kw)
    kept = texts.select("node", "m").join(found, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("m").alias("m")).select("m.rid")
    return rows.join(kept, "rid", "left_semi").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

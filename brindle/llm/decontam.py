"""Benchmark decontamination.

Test items are normalised to words (A-Z lowered; runs of letters, digits and
non-ASCII characters) and cut into windows of ``n`` words; an item of fewer
words is one window.  The hashes of all windows are a hash set that goes to the
executors.  Every document's windows are looked up in it where the
text is scanned; what hits is verified by its words, not by its hash.

The test set is bounded by its purpose, and its size is checked, in rows and in bytes: up to
``SET_WINDOWS`` windows of ``SET_BYTES`` in all, the set is part of the plan.  Beyond, the documents' windows
are looked up as 8-byte hashes by a semi join, broadcast up to ``BROADCAST_BYTES`` and shuffled
beyond, and only the windows that hit are cut from the text.  The result is the same.

Defined results: null texts and texts without words have no hits; a text of any length is scanned whole; null items
and items without words have no windows; an item with a null id counts for hits
but is not named; repeated items with the same id count once; an empty table gives no
rows, an empty benchmark no hits; documents with equal or null ids are separate.
``clean`` keeps all columns, whatever their names; ``report`` ignores further ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold_case, let, stored

WINDOW = 10
#: Java regexes of what parts words: in lowered texts, and in texts as they are.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARTS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SET_WINDOWS = 50_000
SET_BYTES = 16 << 20
BROADCAST_BYTES = 64 << 20
HITS = "array<struct<pos:int,len:int,window:string>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(fold_case(F.coalesce(text, F.lit(""))), PARTS), "")


def item_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, len, window, h): the distinct windows of each item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w"))
    sized = items.filter(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    starts = sized.select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    cut = starts.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("x"))
    return cut.select("item_id", "len", F.array_join("x", " ").alias("window"), F.xxhash64("x").alias("h")).distinct()


class Windows:
    """The windows of a benchmark, stored, with the bounded parts that plans carry."""

    def __init__(self, benchmark: DataFrame, n: int = WINDOW, **kw):
        self.table = stored(item_windows(benchmark, n, **kw), "windows")
        #: At most n numbers.
        self.lengths = sorted(r["len"] for r in self.table.select("len").distinct().collect())
        size = self.table.agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + 24).alias("bytes")).first()
        self.count, self.bytes = size["n"], size["bytes"] or 0
        self.hashes: dict[int, list[int]] | None = None
        self.texts: list[str] | None = None
        if self.count <= SET_WINDOWS and self.bytes <= SET_BYTES:
            rows = self.table.select("len", "h", "window").distinct().collect()
            self.hashes = {k: sorted({r["h"] for r in rows if r["len"] == k}) for k in self.lengths}
            self.texts = sorted({r["window"] for r in rows})

    def candidates(self, words: Column) -> Column:
        """The windows of a text whose hashes are in the set of the plan."""

        def of(length: int) -> Column:
            members = self.hashes[length]
            places = F.filter(F.sequence(F.lit(1), F.size(words) - length + 1), lambda i: F.xxhash64(F.slice(words, i, length)).isin(members))
            return F.when(F.size(words) >= length, _cut(words, F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"))))).otherwise(F.array().cast(HITS))

        return reduce(lambda a, b: F.concat(a, b), [of(k) for k in self.lengths], F.array().cast(HITS))

    def looked_up(self, rows: DataFrame, text: Column) -> DataFrame:
        """(rid, pos, len, window): the windows of ``rows`` whose hashes are in the benchmark, by a semi join on hashes."""

        def of(words: Column, length: int) -> Column:
            places = F.transform(F.sequence(F.lit(1), F.size(words) - length + 1), lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice(words, i, length)).alias("h")))
            return F.when(F.size(words) >= length, places).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))

        hashes = let(words_of(text), lambda w: reduce(lambda a, b: F.concat(a, b), [of(w, k) for k in self.lengths]))
        known = self.table.select("len", "h").distinct()
        small = self.count * 12 <= BROADCAST_BYTES
        hits = rows.select("rid", F.inline(hashes)).join(F.broadcast(known) if small else known, ["len", "h"], "left_semi")
        # At most one hit for each place of a text and length.
        found = stored(hits.groupBy("rid").agg(F.collect_list(F.struct("pos", "len")).alias("at")), "hits")
        return rows.join(found, "rid").select("rid", F.inline(let(words_of(text), lambda w: _cut(w, F.col("at")))))

    def joined(self, rows: DataFrame) -> DataFrame:
        """The verified hits among ``rows``: equal windows, with their items."""
        known = self.table.select("window", "item_id")
        return rows.join(F.broadcast(known) if self.bytes <= BROADCAST_BYTES else known, "window")


def _cut(words: Column, places: Column) -> Column:
    """``places`` (pos, len) with the words that stand there."""
    return F.transform(places, lambda p: F.struct(p["pos"].alias("pos"), p["len"].alias("len"), F.array_join(F.slice(words, p["pos"], p["len"]), " ").alias("window")))


def scan(docs: DataFrame, windows: Windows, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, n_words) of all rows, and (rid, pos, len, window) of what may hit; stored, so that row numbers stay."""
    rid, text = F.monotonically_increasing_id().alias("rid"), F.col(text_col)
    if windows.hashes is not None:
        found = docs.select(rid, F.col(id_col).alias("doc_id"), let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), windows.candidates(w).alias("hits"))).alias("x"))
        scanned = stored(found.select("rid", "doc_id", F.col("x.n").alias("n_words"), F.col("x.hits").alias("hits")), "scan")
        return scanned.drop("hits"), scanned.filter(F.size("hits") > 0).select("rid", F.inline("hits"))
    rows = stored(docs.select(rid, F.col(id_col).alias("doc_id"), text.alias("text")), "rows")
    return rows.select("rid", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words")), windows.looked_up(rows, F.col("text"))


def _covered(spans: Column) -> Column:
    """Words in sorted spans (pos, len), those in several once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["pos"]))).alias("n"))

    return F.aggregate(spans, zero, add)["n"]


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, **kw) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row for each row of ``docs``."""
    windows = Windows(benchmark, n)
    scanned, rows = scan(docs, windows, **kw)
    found = (
        windows.joined(rows).groupBy("rid")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"), F.collect_set("item_id").alias("items"))
        .select("rid", _covered(F.col("spans")).alias("n_hit"), F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"))
    )
    all_rows = scanned.join(found, "rid", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return all_rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with their hit words taken out.

    With a benchmark of up to ``SET_WINDOWS`` windows each row is judged where
    it is read, without a shuffle.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    windows = Windows(benchmark, n)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = F.col(f"c{docs.columns.index(text_col)}")
    if windows.texts is not None:
        texts = windows.texts
        judged = plain.withColumn("hits", let(words_of(text), lambda w: F.filter(windows.candidates(w), lambda x: x["window"].isin(texts))))
    else:
        rows = stored(plain.withColumn("rid", F.monotonically_increasing_id()), "rows")
        hits = windows.joined(windows.looked_up(rows, text)).groupBy("rid").agg(F.collect_set(F.struct("pos", "len")).alias("hits"))
        judged = rows.join(hits, "rid", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<pos:int,len:int>>")))
    if remove == "documents":
        return judged.filter(F.size("hits") == 0).select(*[F.col(a).alias(c) for a, c in zip(names, docs.columns)])
    left = F.when(F.size("hits") == 0, text).otherwise(_without_spans(text, F.col("hits")))
    return judged.select(*[(left if c == text_col else F.col(a)).alias(c) for a, c in zip(names, docs.columns)])


def _without_spans(text: Column, hits: Column) -> Column:
    """The text without the words of ``hits``; what stands between words is kept."""
    spaces = F.regexp_extract_all(text, F.lit("(" + PARTS_ANY_CASE + ")"), F.lit(1))
    words = F.array_remove(F.split(text, PARTS_ANY_CASE), "")

    def build(x: Column) -> Column:
        w, s, h = x["w"], x["s"], x["h"]
        first = F.when(text.rlike("^" + PARTS_ANY_CASE), F.lit(1)).otherwise(F.lit(0))
        kept = F.transform(w, lambda v, i: F.concat(F.when(F.exists(h, lambda t: (i + 1 >= t["pos"]) & (i + 1 < t["pos"] + t["len"])), F.lit("")).otherwise(v), F.coalesce(F.get(s, i + first), F.lit(""))))
        return F.concat(F.when(first == 1, F.get(s, F.lit(0))).otherwise(F.lit("")), F.array_join(kept, ""))

    return let(F.struct(words.alias("w"), spaces.alias("s"), hits.alias("h")), build)

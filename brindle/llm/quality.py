"""Quality rules with adaptive thresholds.

A document is measured in one pass of built-in functions.  For each language and source
a mergeable quantile sketch of every measure is counted: bins whose borders grow by a fixed factor, so a
quantile is known within ``ACCURACY`` of its value.  Counts add up exactly, in any order, so thresholds do not depend
on partitions, retries or runs.  A source with a third of all rows is a few hundred counts a
task when it is shuffled.
The sketches of sources are added up to sketches of languages, and those to one of
everything; a bucket with fewer than ``min_rows`` measured rows takes its
parent's, and everything has fences however few its rows.  Fences replace fixed cut-offs: a measure may lie ``spread`` times the
distance of the median and the tenth of the better side beyond the median, and no fence is nearer to the median than a least distance of its measure.  This half of a
distribution is clean while less than half of a bucket is junk.  Documents are
then joined with their bucket's fences.

Defined results: a null text has no words and fails; a text of any length is measured whole; null languages and sources
are buckets of their own; an empty table gives no rows; extra columns are kept
by ``filter_quality`` whatever their names; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, let, stored

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"'()+-/:;=?@[\\]^_`{}~#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: measure: (+1 if high values are bad, -1 if low ones; least distance from the median that can fail).
MEASURES = {
    "symbol_rate": (1, 0.03),
    "punctuation_rate": (1, 0.08),
    "upper_rate": (1, 0.25),
    "repeat_rate": (1, 0.2),
    "dup_line_rate": (1, 0.2),
    "word_length": (1, 2.0),
    "short_word_length": (-1, 2.0),
}
SPREAD = 6.0
MIN_ROWS = 200
#: Relative accuracy of a quantile, and the factor between borders of bins that it takes.
ACCURACY = 0.01
FACTOR = (1 + ACCURACY) / (1 - ACCURACY)
#: The bin of zero, below those of all other values.
ZERO = -(1 << 30)
#: Fences of up to so many bytes are broadcast; more are joined with salts.
BROADCAST_BYTES = 32 << 20
SALTS = 32
MINIMUM_WORDS, MOST_REPEATED = 50, 50


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more: sort windows by hash, join touching windows."""

    def in_order(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (F.get(pairs, k + 1)["h"].eqNullSafe(p["h"])) | (F.get(pairs, k - 1)["h"].eqNullSafe(p["h"])))
        starts = F.array_sort(F.transform(twice, lambda p: p["i"]))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    def of(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, in_order))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, of))


def _without(text: Column, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, "")).cast("long")


def base_measures(text: Column) -> Column:
    """Struct of the base columns of a text and what the rates need."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    chars = F.char_length(text).cast("long")
    duplicates = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    per_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))
    return let(
        F.struct(per_word.alias("w"), duplicates.alias("l")),
        lambda s: F.struct(
            s["w"]["n"].alias("n_words"),
            _without(text, WHITE).alias("word_chars"),
            (chars - _without(text, SYMBOLS)).alias("n_symbols"),
            s["l"]["d"].alias("n_dup_lines"),
            s["w"]["r"].alias("n_repeat_words"),
            s["l"]["n"].alias("n_lines"),
            (chars - _without(text, PUNCTUATION)).alias("n_punctuation"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ),
    )


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MINIMUM_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


def rates(q: Column) -> Column:
    def share(a: str, b: str) -> Column:
        return F.when(q[b] > 0, q[a].cast("double") / q[b]).otherwise(F.lit(0.0))

    return F.struct(
        share("n_symbols", "word_chars").alias("symbol_rate"),
        share("n_punctuation", "word_chars").alias("punctuation_rate"),
        share("n_upper", "word_chars").alias("upper_rate"),
        # Smoothed, so that one heading that comes again at the end of a short text is no outlier.
        (q["n_repeat_words"].cast("double") / (q["n_words"] + 20)).alias("repeat_rate"),
        (q["n_dup_lines"].cast("double") / (q["n_lines"] + 6)).alias("dup_line_rate"),
        share("word_chars", "n_words").alias("word_length"),
        share("word_chars", "n_words").alias("short_word_length"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, m, bin, n): how many rows of ``measured`` (lang, source, rate) have measure ``m`` in each bin."""
    rate = F.col("rate")
    cells = F.array(*[F.struct(F.lit(i).alias("m"), F.when(rate[m] > 0, F.ceil(F.log(rate[m]) / log(FACTOR)).cast("int")).otherwise(F.lit(ZERO)).alias("bin")) for i, m in enumerate(MEASURES)])
    return measured.select("lang", "source", F.inline(cells)).groupBy("lang", "source", "m", "bin").agg(F.count("*").alias("n"))


def fences(measured: DataFrame, spread: float = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, fence): bounds of each measure in each bucket of ``measured`` (lang, source, rate).

    Rows that fail the base rules are not in the sketches.
    """
    low = stored(sketches(measured), "sketches")
    mid = low.groupBy("lang", "m", "bin").agg(F.sum("n").alias("n"))
    top = mid.groupBy("m", "bin").agg(F.sum("n").alias("n"))

    def bounds(df: DataFrame, name: str, *keys: str, least_rows: int = min_rows) -> DataFrame:
        # A sketch has a bounded number of bins, whatever its number of rows.
        found = df.groupBy(*keys, "m").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("sketch"), F.sum("n").alias("n"))

        def quantile(tenths: int) -> Column:
            def add(a: Column, x: Column) -> Column:
                upto = a["upto"] + x["n"]
                return F.struct(upto.alias("upto"), F.when(a["bin"].isNull() & (upto * 10 >= F.col("n") * tenths), x["bin"]).otherwise(a["bin"]).alias("bin"))

            bin = F.aggregate("sketch", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("bin")), add)["bin"]
            return F.when(bin == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(FACTOR), bin) * (2 / (1 + FACTOR)))

        found = found.select(*keys, "m", "n", quantile(5).alias("middle"), quantile(1).alias("one"), quantile(9).alias("nine"))
        cols = []
        for i, (m, (side, least)) in enumerate(MEASURES.items()):
            fence = F.col("middle") + side * F.greatest(F.lit(least), spread * F.abs(F.col("middle") - F.col("one" if side > 0 else "nine")))
            cols.append(F.max(F.when(F.col("m") == i, fence)).alias(m))
        return found.groupBy(*keys).agg(*cols, F.max("n").alias("n")).select(*keys, F.when(F.col("n") >= least_rows, F.struct(*MEASURES)).alias(name))

    per_source = bounds(low, "s", "lang", "source").alias("a")
    per_lang = bounds(mid, "l", "lang").alias("b")
    joined = per_source.join(per_lang, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").select("a.lang", "a.source", "s", "l")
    # The sketch of everything is one row: a scalar subquery, NULL if there is no bucket.
    everything = bounds(top, "t", least_rows=1).select("t").scalar()
    return joined.select("lang", "source", F.coalesce("s", "l", everything).alias("fence"))


def passes(rate: Column, fence: Column) -> Column:
    """True if no measure is beyond its fence; without any fence every row passes."""
    tests = [(rate[m] <= fence[m]) if side > 0 else (rate[m] >= fence[m]) for m, (side, _) in MEASURES.items()]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(True))


def assess(docs: DataFrame, keep: dict[str, Column], lang_col: str = "lang", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """(row, q, base_failed, kept): the columns of ``keep`` as struct ``row`` and the verdict on each row."""
    measured = docs.select(
        F.struct(*[c.alias(n) for n, c in keep.items()]).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), base_measures(F.col(text_col)).alias("q")
    )
    measured = stored(measured, "measured").withColumn("rate", rates(F.col("q")))
    found = stored(fences(measured.filter(~base_failed(F.col("q"))), **kw), "fences")
    a, b = measured.alias("a"), found.alias("b")
    same = F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    size = found.select(F.sum(F.coalesce(F.octet_length("lang"), F.lit(0)) + F.coalesce(F.octet_length("source"), F.lit(0)) + 16 + 8 * len(MEASURES)).alias("bytes")).first()["bytes"] or 0
    if size <= BROADCAST_BYTES:
        joined = a.join(F.broadcast(b), same, "left")
    else:
        a = measured.withColumn("salt", F.pmod(F.xxhash64("q", "lang"), F.lit(SALTS)).cast("int")).alias("a")
        b = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
        joined = a.join(b, same & (F.col("a.salt") == F.col("b.salt")), "left")
    failed = base_failed(F.col("a.q"))
    return joined.select("a.row", "a.q", failed.alias("base_failed"), (~failed & passes(F.col("a.rate"), F.col("b.fence"))).alias("kept"))


def filter_quality(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: f"c{docs.columns.index(kw.pop(c + '_col', c))}" for c in ("lang", "source", "text")}
    found = assess(plain, {n: F.col(n) for n in names}, at["lang"], at["source"], at["text"], **kw)
    return found.filter("kept").select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns)])

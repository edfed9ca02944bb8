"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(member | class, history) * P(word | member).
Both softmaxes look their weights up by hashed features of the history: the word
before, the two before as a pair, and the words two and three before alone (skips);
those of the second are hashed together with the class.  The most frequent words
and the end are members of their own.  All others are classed by their first and
last letters, clustered by the frequent words they stand beside, and dealt to a
class's ``MEMBERS`` members by their hash; such a member's words share its probability by their counts.

Training starts at the base (weights of zero over fixed logs of shares), so before
training ``score`` is ``base_score``.  Each update is one distributed step of
AdaGrad: tasks give the gradients of their tokens, which are summed as a
tree.  The texts are dealt into ``GROUPS`` groups by hash and each update takes one of them, so an epoch
takes the gradient at every token of every training document once.  Gradients are whole
numbers (``SCALE``-ths), so their sums are exact and the model does not depend
on partitions, batches or cores.

Counts cover all training documents.  Those of the ``HEAD`` most frequent words go to the
executors; all others are joined.  Words are told by 64 bits of hash in the head, by
their bytes in the join.  Scoring works in sparse numpy batches.

The model's outcomes are those of the base: the V training tokens and one more
for all unknown words, with the base's probability 1 / (N + V + 1).

Defined results: a null or empty text has the end as its only token; a text of any length is taken whole, in
parts of bounded memory; null ids are scored and, as their remainder is null, not learned from; repeated rows are scored alike; without training documents every token
has probability 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored

CLASSES, MEMBERS = 32, 32
#: Classes whose members are single words; the last of these is the end.
OWN = 16
LEAVES = CLASSES * MEMBERS
MARKS = 32
FEATURES, BITS = 4, 14
HEAD = 1 << 18
CELLS = 1 << 16
GROUPS, EPOCHS = 4, 1
RATE = 0.5
SCALE = 512
#: Documents and bytes of text that are handled at once.
BATCH, BATCH_BYTES = 128, 4 << 20
PART = 1024
#: Tokens whose gradient is held before it is summed by feature.
WIDE = 1 << 16
HALF = float(1 << 27)
#: Partial sums that one task of the tree adds up.
FAN = 64
#: Bound of a weight: the sum of four is one that exp takes in single precision.
BOUND = 16.0
END = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 20

#: Masks that keep the first 0 to 8 bytes of a little-endian number.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Tokens:
    """Words of texts as arrays: a hash and a cell of letters for each, with each text's end after its words."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        self.data = b" ".join(parts) + b" "
        b = np.frombuffer(self.data, np.uint8)
        white = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.diff(np.r_[True, white].astype(np.int8))
        self.start, self.stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        eights = np.lib.stride_tricks.as_strided(np.frombuffer(self.data + bytes(8), np.uint8), (len(b) + 1, 8), (1, 1))
        size = self.stop - self.start
        with np.errstate(over="ignore"):
            h = size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            todo, low = np.arange(len(size)), 0
            while len(todo):  # eight bytes of each word that is as long
                part = eights[self.start[todo] + low].view(np.uint64).ravel() & MASKS[np.minimum(size[todo] - low, 8)]
                x = (h[todo] ^ part) * np.uint64(0xBF58476D1CE4E5B9)
                h[todo] = x ^ (x >> np.uint64(31))
                low += 8
                todo = todo[size[todo] > low]
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
        last = self.stop - 1
        one, two, three, four = (b[at].astype(np.int64) for at in (self.start, np.minimum(self.start + 1, last), np.maximum(self.start, last - 1), last))
        cell = ((one * 31 + two) & 255) << 8 | ((three * 31 + four) & 255)
        ends = np.cumsum([len(p) + 1 for p in parts])
        words = np.searchsorted(self.start, ends)  # how many words stand before each text's end
        self.sizes = np.diff(np.r_[0, words]) + 1
        self.hash, self.cell = np.insert(h, words, END), np.insert(cell, words, -1)
        self.word = np.insert(np.arange(len(h)), words, -1)  # place of each token among the words, -1 for an end
        self.text = np.repeat(np.arange(len(parts)), self.sizes)
        self.place = np.arange(len(self.hash)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def bytes_of(self, tokens: np.ndarray) -> list[bytes]:
        at = self.word[tokens]
        return [self.data[a:z] for a, z in zip(self.start[at].tolist(), self.stop[at].tolist())]

    def features(self) -> list[np.ndarray]:
        """Hashed features of the history of each token; before a text's start stand nothing's features."""
        at = np.arange(len(self.hash))

        def before(k: int) -> np.ndarray:
            out = self.hash[np.maximum(at - k, 0)]
            out[self.place < k] = np.uint64(12345 + k)
            return out

        one, two, three = before(1), before(2), before(3)
        with np.errstate(over="ignore"):
            return [one * np.uint64(0x9E3779B97F4A7C15), one * np.uint64(0xC2B2AE3D27D4EB4F) + (two ^ np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93), two * np.uint64(0xA0761D6478BD642F), three * np.uint64(0xE7037ED1A0B428DB)]


def rows_of(keys: list[np.ndarray], classes: np.ndarray | None = None) -> list[np.ndarray]:
    """The row of weights of each feature, or of each feature within a class."""
    out = []
    for i, k in enumerate(keys):
        if classes is not None:
            with np.errstate(over="ignore"):
                k = (k ^ (k >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + classes.astype(np.uint64) * END
                k = (k ^ (k >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append((k >> np.uint64(64 - BITS)).astype(np.int64) + (i << BITS))
    return out


def _hash_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and cell of single words."""
    t = Tokens([w.decode("utf-8", "surrogatepass") for w in words])
    keep = t.word >= 0
    return t.hash[keep], t.cell[keep]


class Head:
    """The most frequent words: from a hash to the place in the list, by an open table of hashes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        #: For each first bits of a hash, where to begin to look.
        self.first = np.searchsorted(self.sorted, np.arange(1 << SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = self.first[(h >> np.uint64(64 - SLOTS)).astype(np.int64)]
        found = np.full(len(h), -1)
        todo = np.arange(len(h))
        while len(todo):
            todo = todo[at[todo] < len(self.sorted)]
            seen = self.sorted[at[todo]]
            hit = seen == h[todo]
            found[todo[hit]] = self.order[at[todo[hit]]]
            todo = todo[seen < h[todo]]
            at[todo] += 1
        return found


class Leaves:
    """The leaf (class and member) of a token: its own for frequent words and the end, else by its cell and its hash."""

    def __init__(self, frequent: np.ndarray, of_cell: np.ndarray | None = None):
        self.own, self.of_cell = np.append(frequent, END), of_cell
        self.order = np.argsort(self.own)
        self.sorted = self.own[self.order]
        self.end = len(self.own) - 1

    def single(self, h: np.ndarray) -> np.ndarray:
        """The place among frequent words, or -1."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)

    def __call__(self, h: np.ndarray, cell: np.ndarray) -> np.ndarray:
        own = self.single(h)
        return np.where(own >= 0, own, (OWN + self.of_cell[cell]) * MEMBERS + (h >> np.uint64(59)).astype(np.int64))


def _batches(batches: Iterator[pa.RecordBatch], size: int = BATCH, text: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``size`` rows and about ``BATCH_BYTES`` in column ``text``; a longer text is one of its own."""
    for whole in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < whole.num_rows:
            most = (upto[low - 1] if low else 0) + BATCH_BYTES
            high = min(low + size, max(low + 1, int(np.searchsorted(upto, most, side="right"))))
            yield whole.slice(low, high - low)
            low = high


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c): counts of all words of all texts, as bytes; partial counts are made where texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out():
            words = list(counts)
            for low in range(0, len(words), 50_000):
                part = words[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], ["word", "c"])

        for batch in _batches(batches):
            for text in batch.column(0).to_pylist():
                counts.update((text or "").encode("utf-8", "surrogatepass").lower().split())
            if len(counts) > 500_000:
                yield from out()
                counts.clear()
        yield from out()

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, compressed: signs in the lowest bit, bytes of equal weight together."""
    z = (x << 1) ^ (x >> 63)
    return zlib.compress(z.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    z = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return (z >> 1 & 0x7FFFFFFFFFFFFFFF) ^ -(z & 1)


def _summed(texts: DataFrame, partitions: int, size: int, fill, blocks: int = 128) -> np.ndarray:
    """The sum of what ``fill(batches of texts, total)`` adds up in each task: ``size`` whole numbers, added in blocks as a tree.

    A task takes ``GROUPS`` partitions, so tasks grow with the input and partial sums stay a fixed share of it.
    """
    step = -(-size // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        fill((batch.column(0).to_pylist() for batch in _batches(batches)), total)
        shard = TaskContext.get().partitionId() // FAN
        for i in range(blocks):
            part = pack(total[i * step : (i + 1) * step].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([shard], pa.int64()), pa.array([part], pa.binary())], ["block", "shard", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = unpack(group["sums"].iloc[0])
        for x in group["sums"].iloc[1:]:
            total = total + unpack(x)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "shard": [group["shard"].iloc[0] // FAN], "sums": [pack(total)]})

    schema = "block int, shard long, sums binary"
    left = max(1, -(-partitions // GROUPS))
    parts = texts.coalesce(left).mapInArrow(run, schema)
    while True:
        parts = parts.groupBy("block", "shard").applyInPandas(add, schema)
        left = -(-left // FAN)
        if left == 1:
            break
    out = np.zeros(size, np.int64)
    for r in parts.collect():  # ``size`` numbers
        got = unpack(r["sums"])
        out[r["block"] * step : r["block"] * step + len(got)] = got
    return out


def _cluster(beside: np.ndarray, k: int = CLASSES - OWN, rounds: int = 25) -> np.ndarray:
    """A cluster for each cell: weighted spherical k-means of what stands beside it."""
    weight = beside.sum(axis=1)
    x = np.sqrt((beside + 0.0) / np.maximum(weight, 1)[:, None])
    use = np.nonzero(weight >= 20)[0]
    out = np.zeros(len(beside), np.int64)
    if len(use) >= k:
        rng = np.random.default_rng(3)
        y, w = x[use], weight[use]
        chosen = [int(np.argmax(w))]
        near = y @ y[chosen[0]]
        for _ in range(k - 1):
            gap = np.maximum(0, 1 - near) * w
            chosen.append(int(rng.choice(len(y), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(y))))
            near = np.maximum(near, y @ y[chosen[-1]])
        centres = y[chosen]
        for _ in range(rounds):
            own = (y @ centres.T).argmax(axis=1)
            for j in range(k):
                if (own == j).any():
                    c = (y[own == j] * w[own == j, None]).sum(axis=0)
                    centres[j] = c / max(1e-9, np.linalg.norm(c))
        out[:] = (x @ centres.T).argmax(axis=1)
    # A cell with little beside it takes the cluster of its last letters, weighed over their cells.
    by_last = np.zeros((256, k))
    np.add.at(by_last, (use & 255, out[use]), weight[use])
    rare = np.nonzero(weight < 20)[0]
    out[rare] = by_last[rare & 255].argmax(axis=1)
    return out


class Network:
    """The two softmaxes: weights by feature, and fixed logs of the shares of classes and members."""

    def __init__(self, leaves: Leaves, tokens: np.ndarray, words: np.ndarray):
        self.leaves = leaves
        self.mass = (tokens + words).reshape(CLASSES, MEMBERS)  # as in the base: counts and one for each different word
        total = self.mass.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_share = np.where(total[:, 0] > 0, np.log(total[:, 0] / max(1, total.sum())), -1e4).astype(np.float32)
            self.member_share = np.where(self.mass > 0, np.log(self.mass / total), -1e4).astype(np.float32)
        #: Rows of both softmaxes: those of classes, then those of members.
        self.weights = np.zeros((2, FEATURES << BITS, MEMBERS), np.float32)

    def parts(self, t: Tokens, leaf: np.ndarray) -> Iterator[tuple[slice, list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]]]:
        """(which tokens, for both softmaxes (outcomes, logits, rows)) in parts that fit a core's cache; logits hold until the next part."""
        y, keys = leaf // MEMBERS, t.features()
        both = ((y, rows_of(keys)), (leaf % MEMBERS, rows_of(keys, y)))
        logits, more = np.empty((2, PART, MEMBERS), np.float32), np.empty((PART, MEMBERS), np.float32)
        for low in range(0, len(leaf), PART):
            part = slice(low, min(low + PART, len(leaf)))
            n, out = part.stop - low, []
            for k, (outcome, rows) in enumerate(both):
                z, x, own = logits[k, :n], more[:n], [r[part] for r in rows]
                np.take(self.weights[k], own[0], axis=0, out=z, mode="clip")
                for r in own[1:]:
                    np.take(self.weights[k], r, axis=0, out=x, mode="clip")
                    z += x
                if k:
                    np.take(self.member_share, y[part], axis=0, out=x, mode="clip")
                    z += x
                else:
                    z += self.class_share
                out.append((outcome[part], z, own))
            yield part, out

    def log_leaf(self, t: Tokens, leaf: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's leaf."""
        logs, each = np.empty(len(leaf)), np.arange(PART)
        with np.errstate(divide="ignore", invalid="ignore"):  # leaves of unknown words may be empty; their logs are not used
            for part, both in self.parts(t, leaf):
                own, total = 0.0, 1.0
                for y, z, _ in both:
                    own = own + z[each[: len(y)], y].astype(np.float64)
                    np.exp(z, out=z)
                    total = total * z.sum(axis=1).astype(np.float64)
                logs[part] = own - np.log(total)
        return logs

    def gradient(self, batches: Iterator[list], total: np.ndarray) -> None:
        """Add the gradient of all tokens of all batches of texts, in ``SCALE``-ths, to ``total`` (softmax, outcome, row)."""
        slots, half, n = 1 << BITS, MEMBERS // 2, 0
        # Two outcomes in one double: sums of WIDE tokens stay below HALF / 2, so both are exact.
        held, rows = np.empty((2, half, WIDE)), np.empty((2, FEATURES, WIDE), np.int64)
        sums = total.reshape(2, MEMBERS, FEATURES << BITS)

        def add() -> None:
            for k in range(2):
                for i in range(FEATURES):
                    own, at = rows[k, i, :n] - i * slots, slice(i * slots, (i + 1) * slots)
                    for c in range(half):
                        both = np.bincount(own, held[k, c, :n], slots)
                        high = np.rint(both * (1 / HALF))
                        sums[k, c, at] += both - high * HALF
                        sums[k, c + half, at] += high

        for t in map(Tokens, batches):
            for _, both in self.parts(t, self.leaves(t.hash, t.cell)):
                size = len(both[0][0])
                if n + size > WIDE:
                    add()
                    n = 0
                for k, (y, z, own) in enumerate(both):
                    np.exp(z, out=z)
                    z *= (-SCALE / z.sum(axis=1))[:, None]
                    np.rint(z, out=z)
                    z[np.arange(size), y] += SCALE
                    held[k, :, n : n + size] = z[:, half:].T
                    held[k, :, n : n + size] *= HALF
                    held[k, :, n : n + size] += z[:, :half].T
                    rows[k, :, n : n + size] = own
                n += size
        add()


class Model:
    """All that executors need to score texts."""

    def __init__(self, head: Head, network: Network, n: int, v: int):
        self.head, self.network, self.n, self.v = head, network, n, v
        with np.errstate(divide="ignore"):
            self.log_mass = np.log10(np.maximum(1, network.mass.ravel()))
        self.log_all = np.log10(n + v + 1)
        self.log_known = np.log10(1 - 1 / (n + v + 1)) if n else 0.0
        self.log_count = np.log10(head.counts + 1)

    def values(self, t: Tokens) -> np.ndarray:
        """Log10 probability of each token, if it is known, without log10 of its count and one."""
        leaf = self.network.leaves(t.hash, t.cell)
        return self.network.log_leaf(t, leaf) / np.log(10) - self.log_mass[leaf] + self.log_known


def train(training: DataFrame, epochs: int = EPOCHS, rate: float = RATE) -> tuple[Model, DataFrame]:
    """The model learned from the texts of ``training``, and the stored counts (word, c) of all its words."""
    counts = stored(word_counts(training), "counts")
    size = training.select(F.spark_partition_id().alias("part")).agg(F.count("*").alias("docs"), F.max("part").alias("last")).first()
    docs, partitions = size["docs"], (size["last"] or 0) + 1
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (total["n"] or 0) + docs, total["v"] + (docs > 0)
    # Words by size of their count, in about 2,000 bins at most; the head is the bins from the top that fit.
    size = F.floor(F.log2("c") * 32).cast("int")
    left, cut = HEAD, 1 << 30
    for r in sorted(counts.groupBy(size.alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        cut = r["bin"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 20_000):
            h, _ = _hash_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1)], ["h", "c"])

    top = counts.filter(size >= cut).mapInArrow(hashed, "h long, c long").collect()  # HEAD pairs of numbers at most, however long the words are
    top_hash, top_count = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.float64)
    order = np.lexsort((top_hash, -top_count))
    top_hash, top_count = top_hash[order], top_count[order]
    head = Head(np.append(top_hash, END), np.append(top_count, docs))
    leaves, marks, texts = Leaves(top_hash[: OWN * MEMBERS - 1]), Leaves(top_hash[: MARKS - 1]), training.select("text")

    def beside(batches: Iterator[list], out: np.ndarray) -> None:
        for t in map(Tokens, batches):
            own = marks.single(t.hash)
            for a, b in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                use = (own[a] < 0) & (own[b] >= 0) & (t.text[a] == t.text[b])
                np.add.at(out, t.cell[a][use] * MARKS + own[b][use], 1.0)

    leaves.of_cell = _cluster(_summed(texts, partitions, CELLS * MARKS, beside).reshape(CELLS, MARKS)) if docs else np.zeros(CELLS, np.int64)
    # Tokens and different words of each leaf, over all words.
    shared = training.sparkSession.sparkContext.broadcast(leaves)

    def of_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(LEAVES), np.zeros(LEAVES)
        for batch in _batches(batches, 20_000):
            y = shared.value(*_hash_of(batch.column(0).to_pylist()))
            tokens += np.bincount(y, batch.column(1).to_numpy(), LEAVES)
            words += np.bincount(y, minlength=LEAVES)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEAVES), pa.int32()), pa.array(tokens), pa.array(words)], ["k", "tokens", "words"])

    tokens, words = np.zeros(LEAVES), np.zeros(LEAVES)
    for k, a, b in counts.mapInArrow(of_leaves, "k int, tokens double, words double").groupBy("k").agg(F.sum("tokens"), F.sum("words")).collect():
        tokens[k], words[k] = a, b
    tokens[leaves.end], words[leaves.end] = docs, docs > 0
    shared.destroy()
    network = Network(leaves, tokens, words)
    squares = np.zeros(network.weights.shape)
    for k in range(epochs * GROUPS if docs else 0):
        group = texts.filter(F.pmod(F.xxhash64("text"), F.lit(GROUPS)) == k % GROUPS)
        update(network, group, partitions, squares, rate)
    return Model(head, network, n, v), counts


def update(network: Network, texts: DataFrame, partitions: int, squares: np.ndarray, rate: float) -> None:
    """One distributed step of AdaGrad on every token of every text; ``squares`` sums the squared gradients so far."""
    shared = texts.sparkSession.sparkContext.broadcast(network)
    g = _summed(texts, partitions, network.weights.size, lambda batches, out: shared.value.gradient(batches, out))
    shared.destroy()
    g = g.reshape(2, MEMBERS, FEATURES << BITS)
    for k in range(2):
        own = g[k].T / SCALE
        squares[k] += own * own
        network.weights[k] = np.clip(network.weights[k] + rate * own / (np.sqrt(squares[k]) + 1), -BOUND, BOUND)


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep).schema
    rest_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("m", T.DoubleType())]))
    for name, kind in (("rid", "long"), ("n_tokens", "long"), ("known", "long"), ("base", "double"), ("model", "double"), ("rest", rest_type)):
        schema = schema.add(name, kind)
    struct = pa.struct([("word", pa.binary()), ("m", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in _batches(batches, text=len(keep)):
            t = Tokens(batch.columns[-1].to_pylist())
            place = m.head(t.hash)
            value = m.values(t)
            known = place >= 0
            count = np.where(known, m.log_count[place], 0.0)
            k = len(t.sizes)
            per = lambda x: np.bincount(t.text, x, k)
            tail = np.nonzero(~known)[0]
            words, at = t.bytes_of(tail), np.r_[0, np.cumsum(np.bincount(t.text[tail], minlength=k))]
            rest = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(value[tail])], fields=list(struct)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.arange(row, row + k)), pa.array(t.sizes.astype(np.int64)), pa.array(per(known.astype(float)).astype(np.int64)), pa.array(per(count) - t.sizes * m.log_all), pa.array(per(np.where(known, value + count, 0.0))), rest],
                schema.names,
            )
            row += k

    if not model.n:
        zero = F.lit(0.0)
        return frame.select(*keep, (F.size(F.array_remove(F.split(F.coalesce("__text", F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    first = stored(frame.mapInArrow(run, schema), "scored")
    rare = first.filter(F.size("rest") > 0).select("rid", F.inline("rest"))
    # A known word beyond the head is rare; should an unknown one be hot, Spark splits its side of the join.
    joined = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log_c"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("m") + F.log10(F.col("c") + 1.0)).otherwise(F.lit(-float(model.log_all)))).alias("value"),
    )
    out = first.drop("rest").join(joined, "rid", "left")
    return out.select(
        *keep, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_c", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("value", F.lit(0.0))).alias("score"),
    )

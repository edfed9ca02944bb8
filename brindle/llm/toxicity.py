"""Toxicity by a string-kernel support vector machine.

The kernel is the gap-weighted subsequence kernel: two strings are alike if
they share subsequences of three letters; one that stretches over more letters
weighs less (``DECAY`` for each), so inserted and changed letters lower a match but do not
lose it.  Signs inside a word are dropped and digits in the place of letters are read as
these; runs of single letters are read as one word.

Training (Nyström): landmarks are strings that cover labelled toxic
documents better than others, with common and confusable harmless words; the
kernel to them, whitened by the landmarks' own kernel, gives the features of a
linear support vector machine.  It is trained on the words of labelled sentences:
words of sentences of harmless documents are negative, and of each toxic document the
words that score highest are its witnesses (multiple-instance learning), if they are like a landmark and harmless documents
do not have them as often; documents may be labelled toxic for other reasons.  Of
documents that share most words only one is learned from.  Each round makes the harmless words that score highest
negatives and landmarks too.  A document's
score is that of its worst word, calibrated by a logistic curve.  As subsequences have explicit
features, the trained machine is one weight for each subsequence.

The fit uses a sample of labelled rows, about ``TOXIC`` and ``HARMLESS`` documents, drawn by a hash of
the id, of texts of up to ``FIT_BYTES`` bytes; every document is scored by all words of its whole text.  The value of a window with unit features is at most that with the least length its letters can have, so words are
ordered by this bound and exact values are computed until a text's greatest one is exact.

Defined results: null and empty texts have the score of a text without a
suspicious word; a text of any length is scored whole; repeated rows have equal results, and of several texts of one id the least is learned from; labels of null are ignored, of several labels of an id the highest counts;
without labels of both kinds every score is the share of toxic labels; equal texts have equal
scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod

#: Bounds of the labelled sample, in documents and in bytes of each.
TOXIC, HARMLESS = 1500, 2500
FIT_BYTES = 100_000
LANDMARKS, BACKGROUND = 64, 64
#: Rounds of training, and the harmless words that each adds to the landmarks.
ROUNDS, HARD = 4, 24
#: A toxic document's witnesses are its words of at least this share of its greatest value.
NEAR = 0.9
#: Kernel to a landmark from which a word can be a first witness.
LIKE = 0.6
DECAY = 0.6
SPAN = 7
WINDOW = 8
GRAM = 5
THRESHOLD = 0.3
ALPHABET = 48
CACHE_WORDS = 400_000
#: In training, bounds above this are replaced by exact values when words are ordered.
HIGH = 0.5
#: (second, third): places of a subsequence's letters after its first.
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Code points below this are looked up, others are told by a remainder.
TABLE = 0x300


def _letter(c: str) -> int:
    c = STANDS_FOR.get(c, c)
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (ALPHABET - 27) if c.isalpha() else 0


CODES = np.array([_letter(chr(i)) for i in range(TABLE)], np.int32)


class Words:
    """Letters of many words end to end, without signs, and their windows of up to ``WINDOW`` letters."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(points < TABLE, CODES[np.minimum(points, TABLE - 1)], 27 + (points % (ALPHABET - 27)).astype(np.int32))
        breaks = points == 10
        word = np.cumsum(breaks)
        keep = (codes > 0) & ~breaks
        self.codes, self.word, self.n = codes[keep].astype(np.int64), word[keep], len(words)
        size = np.bincount(self.word, minlength=self.n)
        ends = np.cumsum(size)
        place = np.arange(len(self.codes)) - (ends - size)[self.word]
        starts = np.nonzero(place <= np.maximum(0, size[self.word] - WINDOW))[0]
        self.start, self.end = starts, np.minimum(starts + WINDOW, ends[self.word[starts]])
        self.owner = self.word[starts]

    def subsequences(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(letters after the first, places of the first letters, codes of the subsequences)."""
        c, w, n = self.codes, self.word, len(self.codes)
        for a, b in PATTERNS:
            if n > b:
                at = np.nonzero(w[: n - b] == w[b:])[0]
                yield b, at, (c[at] * ALPHABET + c[at + a]) * ALPHABET + c[at + b]

    def norms(self, windows: np.ndarray) -> np.ndarray:
        """The exact lengths of the features of windows."""
        rows, cols, vals = [], [], []
        for k in range(WINDOW):  # windows may overlap: each of their first letters in turn
            at = self.start[windows] + k
            live = at < self.end[windows]
            for a, b in PATTERNS:
                use = live & (at + b < self.end[windows])
                i = at[use]
                rows.append(np.nonzero(use)[0])
                cols.append((self.codes[i] * ALPHABET + self.codes[i + a]) * ALPHABET + self.codes[i + b])
                vals.append(np.full(len(i), DECAY ** (b + 1)))
        r, c, v = map(np.concatenate, (rows, cols, vals))
        key = r * ALPHABET**3 + c
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        squares = np.add.reduceat(v, first) ** 2 if len(first) else v
        return np.sqrt(np.maximum(1e-12, np.bincount(key[first] // ALPHABET**3, squares, len(windows))))

    def scores(self, weights: np.ndarray, high: float = HIGH) -> tuple[np.ndarray, np.ndarray]:
        """For each word the greatest value of its windows, and which window has it; values up to ``high`` are bounds."""
        value = np.zeros(len(self.start))
        for b, at, codes in self.subsequences():
            total = np.zeros(len(self.codes) + 1)
            total[at + 1] = weights[codes] * DECAY ** (b + 1)
            total = np.cumsum(total)
            value += total[np.maximum(self.end - b, self.start)] - total[self.start]
        value /= NORMS[self.end - self.start]
        # Letters that come again make a window's features longer, which only lowers a value.
        inexact = np.nonzero(value > high)[0]
        if len(inexact):
            value[inexact] *= NORMS[(self.end - self.start)[inexact]] / self.norms(inexact)
        best, where = np.zeros(self.n), np.full(self.n, -1)
        order = np.argsort(value, kind="stable")
        order = order[value[order] > 0]
        best[self.owner[order]], where[self.owner[order]] = value[order], order
        return best, where


def _norm(n: int) -> float:
    """Length of the features of n different letters."""
    return math.sqrt(sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in PATTERNS)) or 1.0


NORMS = np.array([_norm(n) for n in range(WINDOW + 1)])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of each word's first window: (word, subsequence, weight)."""
    w = Words(words)
    first = np.full(w.n, -1)
    first[w.owner[::-1]] = np.arange(len(w.owner))[::-1]
    rows, cols, vals = [], [], []
    norm = np.ones(w.n)
    has = first >= 0
    norm[has] = np.maximum(w.norms(first[has]), 1e-6)
    for b, at, codes in w.subsequences():
        own = w.word[at]
        inside = (at >= w.start[first[own]]) & (at + b < w.end[first[own]])
        rows.append(own[inside]), cols.append(codes[inside])
        vals.append(np.full(int(inside.sum()), DECAY ** (b + 1)) / norm[own[inside]])
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def dense(words: list[str]) -> np.ndarray:
    """(subsequence x word): the features as columns, for a bounded number of words."""
    out = np.zeros((ALPHABET**3, len(words)), np.float32)
    r, c, v = features(words)
    np.add.at(out, (c, r), v)
    return out


def kernel_to(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Kernel of each word's first window to the landmarks whose features are ``columns``."""
    out = np.zeros((len(words), columns.shape[1]), np.float32)
    for low in range(0, len(words), 4096):
        r, c, v = features(words[low : low + 4096])
        part = np.zeros((min(4096, len(words) - low), columns.shape[1]), np.float32)
        order = np.argsort(r, kind="stable")
        r, c, v = r[order], c[order], v[order].astype(np.float32)
        for lo in range(0, len(r), 65536):
            own = r[lo : lo + 65536]
            first = np.nonzero(np.diff(own, prepend=-1))[0]
            part[own[first]] += np.add.reduceat(columns[c[lo : lo + 65536]] * v[lo : lo + 65536, None], first, axis=0)
        out[low : low + len(part)] = part
    return out


def instances(text: str | None) -> list[str]:
    """The different words of a text, and its runs of single letters as words."""
    if not text:
        return []
    words = text.lower().split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    found = set(words)
    run: list[str] = []
    last = -2
    for i in [*single, -9]:
        if i != last + 1:
            if len(run) > 3:
                found.add("".join(run))
            run = []
        if i >= 0:
            run.append(words[i])
        last = i
    return sorted(found)


_READ = str.maketrans(STANDS_FOR)


def _grams(word: str) -> list[str]:
    plain = word.translate(_READ)
    plain = f"^{plain if plain.isalpha() else ''.join(filter(str.isalpha, plain))}$"
    return [plain[i : i + GRAM] for i in range(len(plain) - GRAM + 1)]


def _different(docs: list[list[str]]) -> list[list[str]]:
    """``docs`` without those that share most words with one before: copies would make any of their words look toxic."""
    factors = np.random.default_rng(4).integers(1 << 62, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: dict[tuple[int, int], list[int]] = {}
    least, out = [], []
    for words in docs:
        if not words:
            continue
        h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = (factors[:, None] * h).min(axis=1)
        near = {j for k, x in enumerate(own.tolist()) for j in seen.get((k, x), ())}
        if any((least[j] == own).sum() >= 8 for j in near):
            continue
        for k, x in enumerate(own.tolist()):
            seen.setdefault((k, x), []).append(len(least))
        least.append(own)
        out.append(words)
    return out


def _landmarks(toxic: list[list[str]], harmless: list[list[str]]) -> list[str]:
    """Strings that cover toxic documents: greedily, each the one that covers most that are left."""

    def of(words: list[str]) -> set[str]:
        return {g for w in words for g in _grams(w)}

    # Only counts are kept, not the strings of each document.
    seen: Counter[str] = Counter()
    for d in toxic:
        seen.update(of(d))
    strings, often = len(seen), {g for g, n in seen.items() if n >= 3}
    seen = Counter({g: seen[g] for g in often})
    good: Counter[str] = Counter()
    for d in harmless:
        good.update(of(d) & often)
    share = len(harmless) / max(1, len(toxic))
    # Of so many strings some meet toxic documents alone by chance: Chernoff's bound for one, times their number, is under a tenth.
    chance, needed = 1 / (1 + share), math.log(10 * strings)

    def surprise(g: str) -> float:
        n, q = seen[g] + good[g], seen[g] / (seen[g] + good[g])
        return n * (q * math.log(q / chance) + (1 - q) * math.log((1 - q) / (1 - chance) if q < 1 else 1.0))

    clear = {g for g in often if seen[g] * share > 12 * (good[g] + 1) and surprise(g) > needed}
    holders: dict[str, set[int]] = {g: set() for g in clear}
    words_of: dict[str, Counter[str]] = {g: Counter() for g in clear}
    for i, d in enumerate(toxic):
        for w in d:
            for g in _grams(w):
                if g in clear:
                    holders[g].add(i)
                    words_of[g][w] += 1
    chosen, cover = [], Counter()
    for _ in range(LANDMARKS):
        gain = {g: sum(0.7 ** cover[i] for i in h) - (good[g] + 1) / share for g, h in holders.items()}
        if not gain or max(gain.values()) < 2:
            break
        g = max(sorted(gain), key=gain.get)
        cover.update(holders.pop(g))
        holding = words_of[g]
        word, n = max(sorted(holding.items()), key=lambda x: x[1])
        plain = word.strip(".,;:!?\"'()")
        chosen.append(plain if n * 3 > sum(holding.values()) and len(plain) <= WINDOW else g.strip("^$"))
    return list(dict.fromkeys(chosen))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Nesterov's accelerated gradient."""
    x = np.hstack([z, np.ones((len(z), 1), z.dtype)]).astype(np.float64)
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + penalty)
    v = u = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ u))
        grad = -2 * x.T @ (weight * y * slack) + penalty * np.append(u[:-1], 0)
        new = u - step * grad
        u = new + t / (t + 3) * (new - v)
        v = new
    return v[:-1], float(v[-1])


class Machine:
    """The trained machine: a weight for each subsequence, a bias and the calibration."""

    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift
        #: Values of words, exact for those in ``exact``, else bounds.
        self.cache: dict[str, float] = {}
        self.exact: set[str] = set()

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "exact": set()}

    def worst(self, texts: list[list[str]]) -> np.ndarray:
        """The greatest value of the words of each text; 0 if it has none."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.exact.clear()
        known, exact = self.cache, self.exact
        missing = list({w for t in texts for w in t if w not in known})
        known.update(zip(missing, valued(missing, self.weights, math.inf).tolist()))
        out, left = np.zeros(len(texts)), [i for i, t in enumerate(texts) if t]
        while left:  # those whose greatest value is only a bound
            tops = {i: max(texts[i], key=known.__getitem__) for i in left}
            ask = list({w for w in tops.values() if w not in exact})
            known.update(zip(ask, valued(ask, self.weights, 0.0).tolist()))
            left, done = [i for i in left if tops[i] not in exact], [i for i in left if tops[i] in exact]
            exact.update(ask)
            for i in done:
                out[i] = known[tops[i]]
        return out

    def __call__(self, texts: list[str | None]) -> list[float]:
        if self.weights is None:
            return [self.shift] * len(texts)
        f = np.minimum(1.0, self.worst([instances(t) for t in texts]) + self.bias)
        return (1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -50, 50)))).tolist()


def valued(words: list[str], weights: np.ndarray, high: float = HIGH) -> np.ndarray:
    """The value of each word, in parts of bounded memory."""
    return np.concatenate([np.zeros(0), *(Words(words[i : i + 20_000]).scores(weights, high)[0] for i in range(0, len(words), 20_000))])


def train(toxic: list[str | None], harmless: list[str | None]) -> Machine:
    pool: dict[str, str] = {}  # each different word once in memory
    bad, good = ([[pool.setdefault(w, w) for w in instances(t)] for t in texts] for texts in (toxic, harmless))
    share = len(bad) / max(1, len(bad) + len(good))
    bad, good = _different(bad), _different(good)
    marks = _landmarks(bad, good) if bad and good else []
    if not marks:
        return Machine(None, 0.0, 0.0, share)
    words = Counter(w for d in good for w in d)
    common = [w for w, _ in words.most_common(BACKGROUND // 2)]
    # Harmless words that are most like a landmark are both landmarks and hard negatives.
    nearness = np.zeros(ALPHABET**3)
    for col in dense(marks).T:
        nearness = np.maximum(nearness, col)
    all_words = sorted(words)
    order = np.argsort(-valued(all_words, nearness), kind="stable")
    like = [all_words[i] for i in order[: BACKGROUND // 2]]
    marks = list(dict.fromkeys([*marks, *common, *like]))
    rng = np.random.default_rng(5)
    hard = {all_words[i] for i in order[:4000]} | {all_words[i] for i in rng.choice(len(all_words), min(4000, len(all_words)), replace=False)}
    negatives = sorted(hard)
    machine = None
    # A word that harmless documents have too is no witness: documents may be labelled toxic for other reasons.
    seen = Counter(w for d in bad for w in d)
    suspects = [[w for w in d if 5 * words[w] * len(bad) < seen[w] * len(good)] for d in bad]
    bad_words = sorted({w for d in suspects for w in d})
    weights, least = nearness, LIKE  # the first witnesses are the words most like a landmark
    for _ in range(ROUNDS):
        columns = dense(marks)
        value, vector = np.linalg.eigh((columns.T @ columns).astype(np.float64))
        white = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T * (value > 1e-6).any()
        value = dict(zip(bad_words, valued(bad_words, weights).tolist()))
        tops = [w for d in suspects if d for top in [max(map(value.__getitem__, d))] if top > least for w in d if value[w] >= NEAR * top]
        witnesses = _windows(tops, weights)
        negative = _windows(negatives, weights)
        both = witnesses + negative
        z = kernel_to(both, columns) @ white
        y = np.r_[np.ones(len(witnesses)), -np.ones(len(negative))]
        share = np.r_[np.full(len(witnesses), 1 / max(1, len(witnesses))), np.full(len(negative), 1 / max(1, len(negative)))]
        v, bias = _svm(z, y, share)
        weights = (columns @ (white @ v)).astype(np.float64)
        machine, least = Machine(weights, bias, 1.0, 0.0), -bias
        # The harmless words with the greatest values become negatives too, and those above the border landmarks.
        order = np.argsort(-valued(all_words, weights), kind="stable")
        negatives = sorted({*negatives, *(all_words[i] for i in order[:2000])})
        marks = list(dict.fromkeys([*marks, *_windows([all_words[i] for i in order[:HARD]], weights)]))
    f = np.minimum(1.0, np.r_[machine.worst(bad), machine.worst(good)] + machine.bias)  # beyond the witnesses' side of the margin all is alike
    machine.slope, machine.shift = _calibrate(f, np.r_[np.ones(len(bad)), np.zeros(len(good))])
    return machine


def _windows(words: list[str], weights: np.ndarray) -> list[str]:
    """The letters of each word's window of greatest value, as a string that reads the same."""
    w = Words(words)
    _, where = w.scores(weights)
    back = {1 + i: chr(97 + i) for i in range(26)} | {_letter(chr(i)): chr(i) for i in range(TABLE - 1, 0xBF, -1) if chr(i).isalpha() and chr(i).islower()}
    out = []
    for i, k in enumerate(where):
        if k >= 0:
            codes = w.codes[w.start[k] : w.end[k]]
            out.append("".join(back.get(int(c), "") for c in codes))
    return out


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve (Newton's method, slightly regularised)."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -50, 50)))
        g = np.array([((p - target) * f).sum() + 1e-3 * a, (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * f * f).sum() + 1e-3, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return float(a), float(b)


def sample(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, toxic: int = TOXIC, harmless: int = HARMLESS) -> tuple[list, list]:
    """Texts of a bounded sample of labelled rows that are not held out, drawn by a hash of the id."""
    rows = labels.filter(crc_mod(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    sizes = {r["t"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    share = {t: min(1.0, bound / max(1, sizes.get(t, 0))) for t, bound in ((True, toxic), (False, harmless))}
    drawn = rows.filter(part <= F.when(F.col("toxic") > 0, F.lit(share[True])).otherwise(F.lit(share[False]))).select("doc_id", "toxic")
    # About toxic + harmless ids of FIT_BYTES each at most: a bound that does not grow with the tables.
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).select("doc_id", "text")
    rows = short.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["toxic"], r["text"] or ""))
    return [r["text"] for r in rows if r["toxic"] > 0], [r["text"] for r in rows if r["toxic"] <= 0]


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, score and predicted; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # one weight for each of ALPHABET ** 3 subsequences
    frame = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                found = shared.value(batch.columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array([int(x >= THRESHOLD) for x in found], pa.int32())], schema.names)

    return frame.mapInArrow(run, schema)

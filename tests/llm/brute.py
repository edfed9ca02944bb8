"""Plain versions of the operators' contracts, one document at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def fingerprint(text):
    words = WORD.findall((text or "").translate(FOLD))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar_groups(texts, least):
    """texts: {id: text}; {id: smallest id that it reaches} by pairs of a Jaccard of ``least`` or more."""
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def components(prints):
    """prints: {id: fingerprint}; {id: smallest id that it reaches}."""
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def contamination(texts, items, n=10):
    """For each text (n_words, n_hit, n_items, digest, contaminated)."""
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(FOLD))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for t in texts:
        w = PLAIN.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def base_scores(docs, modulus=7, held=2):
    tokens = {d: [w.encode() for w in WORD.findall((t or "").translate(FOLD))] + [None] for d, t in docs}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % modulus != held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}

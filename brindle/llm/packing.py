"""Packing: concatenate and cut.

All documents are laid end to end as one stream of token ids and the stream is
cut every ``length`` tokens, so only the very last sequence can be short.

Two passes and no sort of the documents: the first tokenises each partition
once, noting each document's offset within its partition, and stores the ids in
the shared folder; the partitions' totals (one row each) are turned into
partition offsets by a prefix sum; the second pass adds both offsets and cuts
each document at the boundaries of the fixed windows.  A document that crosses a
boundary yields one boundary record, called a piece, for each window it meets.

Defined results: a null text is an empty text (its only id is the end id); a text of any length is encoded whole; a
null id stays null; an added token of the file (such as ``<|endoftext|>``) written in a text has that token's id, as the file says; repeated rows are separate documents; an empty table gives no
pieces; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

END_ID = 1
LENGTH = 2048
#: Characters from here on go to the exact path; the class of each one below is compared.
FARTHEST = 0x500
FARTHER = re.compile(f"[^\x00-{chr(FARTHEST - 1)}]")
#: The split of byte-level BPE files of this kind (a fixed value; the files themselves only say ``use_regex``).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TextEncoder:
    """Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, as little-endian 32-bit bytes.

    The file's ids are in the order of its merges, so its vocabulary is a table of
    ranks, with which ``tiktoken`` gives the same ids at several times the speed and
    without a cache.  This holds for a text if both libraries split it alike and merge each piece alike.  How a text is split
    depends on its characters' classes alone, so the classes of all characters below ``FARTHEST`` are compared when
    an encoder is made, and texts with others go to ``tokenizers``, as do texts with an added token.  Pieces are merged
    in the order of ranks by both; ``tiktoken`` also takes a piece that is a word of the
    vocabulary as that word, so each word must be what its own merges lead to.  If a comparison fails or the file is of another
    kind, all texts go to ``tokenizers``.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.fast, self.added = self._fast(file)
        if self.fast is not None and not self._alike():
            self.fast = None

    @staticmethod
    def _fast(file: str):
        import tiktoken

        with open(file, encoding="utf-8") as f:
            known = json.load(f)
        kind, model = known.get("pre_tokenizer") or {}, known["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex") or known.get("normalizer") or model.get("type") != "BPE" or not plain:
            return None, None
        letters, added = byte_letters(), [t["content"] for t in known.get("added_tokens", ())]
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
        pairs = [tuple(bytes(letters[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if [ranks.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))) or len(ranks) != 256 + len(pairs):
            return None, None
        order = {p: i for i, p in enumerate(pairs)}
        if any(_merged(a + b, order) != 1 for a, b in pairs):
            return None, None
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), re.compile("|".join(map(re.escape, added))) if added else None

    def _alike(self) -> bool:
        """Whether both libraries split around each character alike."""
        probes = [f"a{c}a{c}1{c}1 {c} {c}{c}!{c}! {c}a  {c}" for c in map(chr, range(FARTHEST))]
        return self.exact(probes) == [array("I", self.fast.encode_ordinary(t)).tobytes() for t in probes]

    def exact(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _far(self, text: str) -> bool:
        return (not text.isascii() and FARTHER.search(text) is not None) or (self.added is not None and self.added.search(text) is not None)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self.exact(texts)
        encode = self.fast.encode_ordinary
        out = [None if self._far(t) else array("I", encode(t)).tobytes() for t in texts]
        far = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(far, self.exact([texts[i] for i in far])):
            out[i] = x
        return out


def _merged(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """How many parts are left of a word after all merges."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return len(parts)


_encoders: dict[str, TextEncoder] = {}


def text_encoder(file: str) -> TextEncoder:
    """One encoder for each file and Python worker."""
    if file not in _encoders:
        _encoders[file] = TextEncoder(file)
    return _encoders[file]


def tokenise(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, local, n, ids): first pass; ``local`` counts the partition's ids before the document."""
    kind = docs.schema[id_col].dataType
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = text_encoder(file), TaskContext.get().partitionId(), 0
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                ids = [x + end for x in encode([t or "" for t in batch.column(1).to_pylist()])]
                sizes, starts = [len(x) // 4 for x in ids], []
                for n in sizes:
                    starts.append(at)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "local", "n", "ids"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, part int, local long, n long, ids binary"
    )


def pieces(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    tokens = stored(tokenise(docs, file, id_col, text_col, end_id), "tokens")
    # One row for each partition of the first pass: that is its size, whatever the documents are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(totals), "part").withColumn("g", F.col("base") + F.col("local"))
    size = int(length)
    cut = f"""inline(transform(sequence(g div {size}, (g + n - 1) div {size}), k -> struct(
        greatest(k * {size} - g, 0L) as start,
        least((k + 1) * {size}, g + n) - greatest(k * {size}, g) as length,
        substring(ids, cast(4 * greatest(k * {size} - g, 0L) + 1 as int), cast(4 * (least((k + 1) * {size}, g + n) - greatest(k * {size}, g)) as int)) as piece_ids,
        k as sequence_id,
        greatest(g - k * {size}, 0L) as offset)))"""
    out = placed.selectExpr("doc_id", "n as doc_tokens", cut)
    return out.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *(["piece_ids"] if with_ids else []))


def sequences(docs: DataFrame, file: str, length: int = LENGTH, **kw) -> DataFrame:
    """(sequence_id, ids, boundaries): whole sequences with the offsets where documents or their parts begin.

    A sequence has at most ``length`` ids, which bounds each group.
    """
    found = pieces(docs, file, length=length, with_ids=True, **kw)
    return (
        found.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "piece_ids"))).alias("p"))
        .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.piece_ids))").alias("ids"), F.expr("transform(p, x -> struct(x.offset, x.doc_id, x.start))").alias("boundaries"))
    )

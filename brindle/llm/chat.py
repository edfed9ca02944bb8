"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its
context and only its own text is trainable.  Turns of a conversation are taken
by (turn, role, text), nulls first.

Template of a turn: ``### Role: `` + text + `` </turn>`` + line feed.  A text can
not forge a mark: in texts and roles every backslash is doubled and a backslash
is put before each ``#`` and each ``</turn>``, so no unescaped mark is left and
reading back is exact.

Defined results: a null text is an empty text; texts may have any length, but a conversation has to fit in a task, as
the last of its examples holds all its turns; a null role is the role ``null``
in the output; a conversation without an assistant turn has one example with
nothing trainable, so that its turns are still in the output; a null conv_id is a
conversation like any other; repeated rows are repeated turns; empty tables give
no example; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    out, i = [], 0
    while (k := text.find("\\", i)) >= 0:
        out.append(text[i:k])
        out.append(text[k + 1 : k + 2])
        i = k + 2
    out.append(text[i:])
    return "".join(out)


def label(role: str | None) -> str:
    role = "null" if role is None else role
    return escape(role[0].upper() + role[1:] if "a" <= role[:1] <= "z" else "=" + role).replace(":", "\\:")


def unlabel(shown: str) -> str:
    role = unescape(shown)
    return role[1:] if role.startswith("=") else role[:1].lower() + role[1:]


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn and where its text begins and ends in it."""
    head = OPEN + label(role) + MIDDLE
    body = escape(text or "")
    return head + body + CLOSE, len(head), len(head) + len(body)


def _unescaped(text: str, mark: str, at: int) -> int:
    """Where ``mark`` stands next without a backslash that escapes it."""
    while (k := text.find(mark, at)) >= 0:
        back = k
        while back > 0 and text[back - 1] == "\\":
            back -= 1
        if (k - back) % 2 == 0:
            return k
        at = k + 1
    raise ValueError("not an example of this template")


def parse(example: str) -> list[tuple[str, str, int, int]]:
    """(role, text, where the escaped text begins, where it ends) of each turn of an example."""
    out, at = [], 0
    while at < len(example):
        if not example.startswith(OPEN, at):
            raise ValueError("not an example of this template")
        colon = _unescaped(example, ":", at + len(OPEN))
        start = colon + len(MIDDLE)
        end = _unescaped(example, CLOSE[1:], start) - 1
        out.append((unlabel(example[at + len(OPEN) : colon]), unescape(example[start:end]), start, end))
        at = end + len(CLOSE)
    return out


def expand(turns: list[tuple[str | None, str | None]]) -> Iterator[tuple[str, int, int]]:
    """(example, loss_start, loss_end) for each assistant turn, or one with an empty mask if there is none.

    What follows the last assistant turn is no context of any reply; it is
    added to a final example with an empty mask, so that no turn is lost.
    """
    prefix, parts, last = 0, [], -1
    for k, (role, text) in enumerate(turns):
        shown, a, b = render(role, text)
        parts.append(shown)
        if role == ASSISTANT:
            yield "".join(parts), prefix + a, prefix + b
            last = k
        prefix += len(shown)
    if last < len(turns) - 1:
        yield "".join(parts), prefix, prefix


def _conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conversation with its turns in order: a conversation is a unit of the output."""
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[F.struct(F.col(c).isNotNull().alias("has"), F.col(c).alias("v")).alias(c) for c in ("turn", "role", "text")]))).alias("turns"))


def _turns(value) -> list[tuple[str | None, str | None]]:
    return [(t["role"]["v"], t["text"]["v"]) for t in value]


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): the examples, one row each."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, turns in zip(batch.column(0), batch.column(1)):
                rows = [(k, *x) for k, x in enumerate(expand(_turns(turns.as_py())))]
                for low in range(0, len(rows), 64):
                    k, text, a, b = zip(*rows[low : low + 64])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([conv.as_py()] * len(k), batch.column(0).type), pa.array(k, pa.int64()), pa.array(text, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        ["conv_id", "example", "formatted", "loss_start", "loss_end"],
                    )

    return _conversations(conversations).mapInArrow(run, f"conv_id {kind}, example long, formatted string, loss_start long, loss_end long")


def digest(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted examples."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0), batch.column(1)):
                loss, chars, masked, shown = hashlib.sha256(), 0, 0, ""
                for shown, a, b in expand(_turns(turns.as_py())):
                    text = unescape(shown[a:b])
                    loss.update(text.encode())
                    masked += len(text)
                    chars += len(shown)
                whole, n = hashlib.sha256(), 0
                for role, text, _, _ in parse(shown):  # the last example has every turn
                    whole.update(f"{role}\n{text}\n".encode())
                    n += 1
                out.append((conv.as_py(), n, whole.hexdigest(), masked, loss.hexdigest(), chars))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return _conversations(conversations).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

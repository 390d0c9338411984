"""Chat formatting in budgeted windows.

The turns of a conversation are laid into windows of at most ``budget`` tokens. The running sum of the turns' tokens chooses
spans of whole turns; a leading system turn opens every window, and the last turns before the span come again, up to ``history`` tokens. What is
repeated is masked: the loss mask of a window covers only assistant turns of its own span. A turn larger than what the
system turn leaves of the budget has a window of its own, without history, marked ``over``.

A formatted turn is ``<role>\\n`` text ``</s>\\n`` between marks that no text can hold: inside roles and texts the escape
``\\`` and the first characters of all marks, ``<`` and ``[``, are escaped, and unescaping gives the text back exactly.

Turns stream through a task in order of (conversation, turn) with constant state, so that a conversation of any length is
never gathered. Defined results: a null text or role is empty; a null conversation id is one conversation; turns
with the same number follow by role and text; extra columns are ignored; no rows give no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY = 2048, 256
#: Tokens a turn's marks take.
MARKS = 4
_TOKEN = re.compile(r"\w{1,6}|[^\w\s]")
_ESCAPE = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
_BACK = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\p": "|"}
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)
WINDOWS = "conv_id long, window int, formatted string, own_from int, n_tokens int, over boolean, loss array<struct<start:int,end:int>>"


def tokens(text: str) -> int:
    """Tokens of a turn: pieces of words of up to six letters, and other signs, besides the marks."""
    return sum(1 for _ in _TOKEN.finditer(text)) + MARKS


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbp]", lambda m: _BACK[m[0]], text)


def turn(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins."""
    head = f"<|{escape(role).replace('|', chr(92) + 'p')}|>\n"
    return f"{head}{escape(text)}</s>\n", len(head)


def parse(formatted: str) -> Iterator[tuple[int, str, str]]:
    """(begin, role, text) of the turns of a window."""
    for m in _TURN.finditer(formatted):
        yield m.start(), unescape(m[1]), unescape(m[2])


class _Builder:
    """Windows of one conversation; holds the system turn, the history and the open window."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.most_history = conv_id, budget, history
        self.system: tuple[str, int] | None = None
        self.system_tokens, self.count, self.window = 0, 0, 0
        self.past: list[tuple[str, int]] = []
        self.open: list[tuple[str, int, int, str]] = []  # formatted, text's begin, tokens, role
        self.used = 0

    def add(self, role: str, text: str) -> dict | None:
        """Takes a turn; returns the window that it closes."""
        formatted, begin = turn(role, text)
        n, done = tokens(text), None
        if self.open and self.used + n > self.budget:
            done = self.close()
        if not self.open and self.count:
            # A new window: the system turn, and of the past as many last turns as fit.
            self.used = self.system_tokens
            room = min(self.most_history, self.budget - self.used - n)
            self.history = []
            for old, size in reversed(self.past):
                if size > room:
                    break
                room -= size
                self.used += size
                self.history.insert(0, old)
        elif not self.count:
            self.history = []
            if role == "system":
                self.system, self.system_tokens = (formatted, n), n
        self.open.append((formatted, begin, n, role))
        self.used += n
        self.count += 1
        if not (self.count == 1 and self.system):
            self.past.append((formatted, n))
            while len(self.past) > 1 and sum(s for _, s in self.past) > 2 * self.most_history:
                self.past.pop(0)
        return done

    def close(self) -> dict | None:
        if not self.open:
            return None
        head = "".join(([self.system[0]] if self.system and self.window else []) + self.history)
        parts, loss, at = [head], [], len(head)
        for formatted, begin, _, role in self.open:
            if role == "assistant":
                loss.append({"start": at + begin, "end": at + len(formatted) - len("</s>\n")})
            parts.append(formatted)
            at += len(formatted)
        out = {"conv_id": self.conv_id, "window": self.window, "formatted": "".join(parts), "own_from": len(head), "n_tokens": self.used, "over": self.used > self.budget, "loss": loss}
        self.open, self.used, self.window = [], 0, self.window + 1
        return out


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *order)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of conversations given as rows (conv_id, turn, role, text)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def batch(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w[n] for w in found], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder: _Builder | None = None
        for b in batches:
            found = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if builder is None or builder.conv_id != conv:
                    found.append(builder.close() if builder else None)
                    builder = _Builder(conv, budget, history)
                found.append(builder.add(role, text))
            yield batch([w for w in found if w])
        if builder and (last := builder.close()):
            yield batch([last])

    return _ordered(rows, "turn", "role", "text").mapInArrow(run, WINDOWS)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its windows give back: turns once and in order, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def rows(done: list[list]) -> pa.RecordBatch:
            columns = list(zip(*[(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]) for s in done], strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

        for b in batches:
            done = []
            for conv, text, own_from, loss in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 6)), strict=True):
                if state is None or state[0] != conv:
                    done += [state] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for begin, role, said in parse(text):
                    if begin >= own_from:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
                state[6] += 1
            yield rows(done)
        if state:
            yield rows([state])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return _ordered(formatted, "window").mapInArrow(run, schema)

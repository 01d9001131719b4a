"""Chat formatting in windows of a token budget, with a loss mask over each assistant turn once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm._spark import small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of the history that it repeats, and of a turn's marks.
BUDGET, HISTORY, MARKS = 1024, 256, 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def escape(text: str) -> str:
    """``text`` without any ``<|``: a backslash before each backslash and between the two characters."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def _head(role: str) -> str:
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"


_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_tokens", pa.int32()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])


class _Windows:
    """The open window of one conversation, of bounded size: turns arrive in order."""

    def __init__(self, conv: int | None, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: list[tuple] = []
        self.old: list[tuple] = []
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the tokens of new
        self.number = 0

    def _used(self) -> int:
        fixed = sum(t[2] for t in self.system) if self.number else 0
        return fixed + sum(t[2] for t in self.old) + self.sums[-1]

    def add(self, role: str, text: str) -> list[tuple]:
        turn = (role, text, len(_WORD.findall(text)) + MARKS)
        done = []
        if self.new and self._used() + turn[2] > self.budget:
            done.append(self.close())
            # The longest run of last turns whose tokens fit the history; with a long next turn as much as leaves room.
            fixed = sum(t[2] for t in self.system)
            room = min(self.history, max(0, self.budget - fixed - turn[2]))
            total = self.sums[-1]
            keep = int(np.searchsorted(np.array(self.sums), total - room))
            start = max(keep, len(self.system) if self.number == 1 else 0)
            self.old, self.new, self.sums = self.new[start:], [], [0]
        if role == "system" and not self.number and len(self.new) == len(self.system):
            self.system.append(turn)
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        return done

    def close(self) -> tuple:
        repeated = [*(self.system if self.number else []), *self.old]
        parts, at, starts, ends = [], 0, [], []
        for i, (role, text, _) in enumerate([*repeated, *self.new]):
            head, body = _head(role), escape(text)
            if role == "assistant" and i >= len(repeated):
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts.append(f"{head}{body}{END}\n")
            at += len(parts[-1])
        row = (self.conv, self.number, "".join(parts), len(repeated), self._used(), starts, ends)
        self.number += 1
        return row


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _formatter(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Windows | None = None
        for b in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        out.append(state.close())
                    state = _Windows(conv, budget, history)
                out += state.add(role, text)
            if out:
                yield _batch(out, _WINDOWS)
        if state is not None:
            yield _batch([state.close()], _WINDOWS)

    return run


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows ``conv_id, window, text, n_repeated, n_tokens, loss_start, loss_end`` of conversations.

    ``turns`` has conv_id, turn, role and text. A turn counts its words plus MARKS tokens. Turns are never
    split: each window takes turns while their running sum, with what is repeated, stays in ``budget``; a turn that
    exceeds it alone has a window of its own. Leading system turns are repeated at the head of every window, whole, so where these alone
    exceed the budget every window does; then come up to ``history`` tokens of the turns before, as far as the budget has room. The mask (code points of ``text``, end exclusive) covers
    the text of each assistant turn in the one window where it isn't repeated.

    Turns are marked as in ``<|im_start|>role, newline, text<|im_end|>, newline``; inside roles and texts a
    backslash breaks every ``<|``, so no text can forge a mark, and unescape() restores it.

    Rows come in order of turn (null first), then role and text, where turns repeat. Null texts and roles are
    empty. Rows with null conv_id form one conversation of null id. An empty table gives an empty result. One
    conversation is one sequence, so a task streams over it; it holds one window, not the conversation.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_formatter(budget, history), "conv_id long, window int, text string, n_repeated int, n_tokens int, loss_start array<int>, loss_end array<int>")


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None
    for b in batches:
        out = []
        for id_, text, repeated, starts, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if state is None or conv != id_:
                if state is not None:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                conv, state = id_, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, body in _TURN.findall(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            for s, e in zip(starts, ends, strict=True):
                said = unescape(text[s:e])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
            state[5] += 1
        if out:
            yield _batch(out, _DIGESTS)
    if state is not None:
        yield _batch([(conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])], _DIGESTS)


def read_back(windows: DataFrame) -> DataFrame:
    """What format_windows() wrote, read from its texts and masks: per conversation the number of turns, a digest
    of role, newline, text, newline of each turn in order, and the length and digest of the text under the mask."""
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "text", "n_repeated", "loss_start", "loss_end")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

"""Chat formatting in budgeted, turn-aligned windows.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts a backslash is doubled and put behind the first
character of each control string, so that no text can open or end a turn and everything reads back. Prefix sums of
the formatted turns' tokens, marks and escapes included, choose the spans: a window holds as many new turns as fit;
before them stand the first system turn and as much history as its share allows, both without loss. Only new assistant texts are under the loss mask, each once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, trimmed

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates; "<|" begins all of its family.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"(?:[^\\\n]|\\.)*", re.S)
WINDOW = "conv_id long, window long, text string, context int, loss_start array<long>, loss_end array<long>, n_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = f"{OPEN}{escape(role).replace('\n', '\\\n')}\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(window: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted window; start and end: where its escaped text stands."""
    at = 0
    while at < len(window):
        if not window.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        role = _ROLE.match(window, at + len(OPEN))
        start = role.end() + 1
        end = window.index(CLOSE, start)
        yield unescape(role[0]), unescape(window[start:end]), start, end
        at = end + len(CLOSE)


_counter = None


def count_tokens(texts: list[str]) -> list[int]:
    global _counter
    if _counter is None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _counter = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        _counter.encode_special_tokens = True
    return [len(e.ids) for e in _counter.encode_batch_fast(texts, add_special_tokens=False)]


class _Windows:
    """The windows of one conversation, as its turns come; holds one window and its history at most."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, int, int, int] | None = None
        self.turns: list[tuple[str, str, int, int]] = []  # history, then new turns: text, role, its place
        self.sums = [0]  # prefix sums of the tokens of self.turns
        self.new = 0  # the first new turn
        self.count = 0

    def add(self, role: str, formatted: str, start: int, end: int, tokens: int) -> Iterator[tuple]:
        extra = self.system[3] if self.system else 0
        if len(self.turns) > self.new and extra + self.sums[-1] + tokens > self.budget:
            yield self._window()
        if len(self.turns) == self.new:  # the first new turn: history that doesn't fit beside it goes
            room = min(self.history, self.budget - extra - tokens)
            self._cut(bisect_left(self.sums, self.sums[-1] - max(room, 0)))
        self.turns.append((formatted, role, start, end))
        self.sums.append(self.sums[-1] + tokens)

    def _cut(self, n: int) -> None:
        base = self.sums[n]
        self.turns, self.sums, self.new = self.turns[n:], [s - base for s in self.sums[n:]], self.new - n

    def _window(self) -> tuple:
        parts, context = ([self.system[0]], 1) if self.system else ([], 0)
        at, starts, ends = sum(map(len, parts)), [], []
        for i, (formatted, role, start, end) in enumerate(self.turns):
            if i < self.new:
                context += 1
            elif role == "assistant":
                starts.append(at + start)
                ends.append(at + end)
            parts.append(formatted)
            at += len(formatted)
        row = (self.conv_id, self.count, "".join(parts), context, starts, ends, self.sums[-1] + (self.system[3] if self.system else 0))
        self.count += 1
        i = None if self.system else next((i for i, turn in enumerate(self.turns) if turn[1] == "system"), None)
        if i is not None:  # from now on it stands before the history, not in it
            tokens = self.sums[i + 1] - self.sums[i]
            formatted, _, start, end = self.turns.pop(i)
            self.system = (formatted, start, end, tokens)
            self.sums[i + 1 :] = [s - tokens for s in self.sums[i + 2 :]]
        self.new = len(self.turns)
        return row

    def end(self) -> Iterator[tuple]:
        if len(self.turns) > self.new:
            yield self._window()


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, role, text), each conversation's rows together in a partition, by turn; ties by role, then text."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(df: DataFrame, *, budget: int = 2048, history: int = 512, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows (conv_id, window, text, context, loss_start, loss_end, n_tokens), a conversation's in order.

    ``context``: so many first turns of the window repeat what stood before. ``loss_start``, ``loss_end``: the code
    points of its targets. ``n_tokens``: of the formatted text; over ``budget`` only where one new turn (with the system
    turn) is. ``history``: tokens that are repeated at most. The conversation's first system turn stands before every
    window after the one it is said in; later ones are turns as others are. Null texts and roles are empty; a null turn comes first;
    rows of a null conv_id are one conversation; repeated rows are turns each. Turns stream by in order, so a long
    conversation needs no more memory than its longest window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Windows | None = None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                roles = part.column(1).to_pylist()
                said = [turn_text(role, text) for role, text in zip(roles, part.column(2).to_pylist(), strict=True)]
                for conv_id, role, turn, tokens in zip(part.column(0).to_pylist(), roles, said, count_tokens([t[0] for t in said]), strict=True):
                    if now is None or conv_id != now.conv_id:
                        out += now.end() if now else ()
                        now = _Windows(conv_id, budget, history)
                    out += now.add(role, *turn, tokens)
                    size += len(turn[0])
                if size > 4 << 20 and out:
                    yield arrow(WINDOW, zip(*out, strict=True))
                    out, size = [], 0
        out += now.end() if now else ()
        if out:
            yield arrow(WINDOW, zip(*out, strict=True))

    return ordered_turns(df, conv_col, turn_col, role_col, text_col).mapInArrow(trimmed(run), WINDOW)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(windows: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, read from its windows as they come: one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def row() -> pa.RecordBatch:
            return arrow(DIGEST, [[v] for v in (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])])

        for batch in batches:
            for w in batch.to_pylist():
                if now is None or w["conv_id"] != now[0]:
                    if now:
                        yield row()
                    now = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in list(read_turns(w["text"]))[w["context"] :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for start, end in zip(w["loss_start"], w["loss_end"], strict=True):
                    text = unescape(w["text"][start:end])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(w["text"])
        if now:
            yield row()

    return windows.mapInArrow(trimmed(run), DIGEST)


def op5_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(more)))


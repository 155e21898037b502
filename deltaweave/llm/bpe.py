"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The encoding of a prefix ends in one token only, and a sequence of tokens is an encoding just if each two neighbours
fit: no merge across their border comes before the merges that make them. So reading a byte has one output: the token
that ends there, the longest suffix that is a token and fits the token before it. A deterministic state is the longest
suffix of what has been read that begins some token; it stands for all positions from which a token may still come,
and is determined from the trie of tokens when first reached. A token is certain once all those positions lie on the
way through it; certain tokens are emitted every ``LOOKAHEAD`` bytes, so no more than that and the longest token is held.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, sliced, spread, texts, trimmed, worker_tools
from .common import utf8 as bytes_of
from .pieces import UnitEncoder, joinable

RANKS = "byte_bpe_50k.tiktoken"
PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Transitions, and pairs of tokens with whether they fit, that are kept at most.
TRANSITIONS, PAIRS = 400_000, 300_000
#: Bytes after which certain tokens are emitted.
LOOKAHEAD = 512
#: Pieces of the pattern whose ids are kept, in each of two generations.
PIECES = 100_000
SLICE = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Transducer:
    """ranks: token -> rank, which is its id; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.children: dict[int, int] = {}  # node * 256 + byte -> node
        self.parent, self.byte, self.depth, self.token_at = [0], [0], [0], [-1]
        children = self.children
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if (after := children.get(key := node << 8 | byte)) is None:
                    after = children[key] = len(self.parent)
                    self.parent.append(node)
                    self.byte.append(byte)
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = rank
        self.size = {i: len(t) for i, t in self.tokens.items()}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.span = max(self.tokens) + 2
        self.shorter: dict[int, int] = {0: 0}
        self.steps: dict[int, int] = {}  # state * 256 + byte -> state
        self.ending: dict[int, tuple] = {}  # state -> the tokens that are its suffixes, with their sizes, the longest first
        self.fits: dict[int, bool] = {}

    def _shorter(self, node: int) -> int:
        """The longest proper suffix of a node's bytes that is a node."""
        if (found := self.shorter.get(node)) is None:
            found = self.shorter[node] = 0 if not self.parent[node] else self._after(self._shorter(self.parent[node]), self.byte[node])
        return found

    def _after(self, node: int, byte: int) -> int:
        while (after := self.children.get(node << 8 | byte)) is None and node:
            node = self._shorter(node)
        return after or 0

    def _step(self, key: int) -> int:
        """Determines a transition."""
        if len(self.steps) >= TRANSITIONS:
            self.steps.clear()
            self.ending.clear()
        state = self.steps[key] = self._after(key >> 8, key & 255)
        return state

    def _ending(self, state: int) -> tuple:
        out, node = [], state
        while node:
            if (token := self.token_at[node]) >= 0 and self._edge(token):
                out.append((self.depth[node], token))
            node = self._shorter(node)
        found = self.ending[state] = tuple(out)
        return found

    def merged(self, data: bytes) -> list[bytes]:
        """Ranked merges by definition, the lowest rank first, then the leftmost, down to the last two parts or fewer."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int) -> tuple[list, list] | None:
        """(bytes, rank) of what stands at the token's left and right edge as it is merged; None: it never comes about."""
        if token not in self.edges:
            parts = self.merged(self.tokens[token])
            if len(parts) == 1:
                found = [(parts[0], -1)], [(parts[0], -1)]
            elif len(parts) > 2:
                found = None
            else:
                left, right = (self._edge(self.ranks[x]) for x in parts)
                own = (self.tokens[token], token)
                found = ([*left[0], own], [*right[1], own]) if left and right else None
            self.edges[token] = found
        return self.edges[token]

    def _fit(self, key: int) -> bool:
        """Whether the token before (-1: none) and a token fit; key: (before + 1) * span + token."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        a, b = divmod(key, self.span)
        found = self.fits[key] = a == 0 or self._apart(self._edge(a - 1)[1], self._edge(b)[0])
        return found

    def _apart(self, xs: list, ys: list) -> bool:
        """Whether no two tokens that stand at a border at the same time merge across it before their own next merges."""
        i = j = 0
        get, never = self.ranks.get, 1 << 60
        while True:
            rank = get(xs[i][0] + ys[j][0], never)
            x = xs[i + 1][1] if i + 1 < len(xs) else never
            y = ys[j + 1][1] if j + 1 < len(ys) else never
            if rank < x and rank <= y and rank != never:
                return False
            if x == y == never:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def _emit(self, ends: list[int], to: int) -> list[int]:
        """The tokens on the way to position ``to``; ends[i]: the token that ends behind byte i."""
        out = []
        while to > 0:
            out.append(token := ends[to - 1])
            to -= self.size[token]
        out.reverse()
        return out

    def _certain(self, ends: list[int], state: int) -> int:
        """The last position that lies on the way to all from which a token may still come."""
        live, node = {len(ends)}, state
        while node:
            live.add(len(ends) - self.depth[node])
            node = self._shorter(node)
        while len(live) > 1:
            live.remove(last := max(live))
            live.add(last - self.size[ends[last - 1]] if last else 0)
        return live.pop()

    def __call__(self, piece: str | bytes) -> list[int]:
        """The ids of one piece. A piece that is a token is that token."""
        data = piece if isinstance(piece, bytes) else piece.encode("utf-8", "replace")
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        out: list[int] = []
        ends: list[int] = []
        state, before, span, add = 0, -1, self.span, ends.append
        steps, ending, fits = self.steps.get, self.ending.get, self.fits.get
        for n, byte in enumerate(data, 1):
            key = state << 8 | byte
            if (state := steps(key, -1)) < 0:
                state = self._step(key)
            held = len(ends)
            for size, token in ending(state) or self._ending(state):
                key = ((ends[held - size] if size <= held else before) + 1) * span + token
                if (fit := fits(key)) is None:
                    fit = self._fit(key)
                if fit:
                    add(token)
                    break
            else:
                raise ValueError("the ranks have no encoding of this text: a byte or a merge is missing")
            if n % LOOKAHEAD == 0 and (to := self._certain(ends, state)):
                out += self._emit(ends, to)
                before = out[-1]
                del ends[:to]
        return out + self._emit(ends, len(ends))


class _Pieces(dict):
    """Piece of the pattern -> its ids; what isn't asked for goes with its generation."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (value := self.old.get(piece)) is None:
            value = tuple(self.encode(piece))
        if len(self) >= PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class PieceEncoder:
    """Units to ids, each match of the pattern separately, for ``UnitEncoder``."""

    def __init__(self, transducer: Transducer):
        self.known = _Pieces(transducer)

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        said = [u.decode("utf-8", "replace") for u in units]
        plain = np.fromiter(map(joinable, said), bool, len(said))
        many = np.zeros(len(units), np.int64)
        own = [u for u, p in zip(said, plain, strict=True) if p]
        pieces = PATTERN.findall("".join(own))  # one begins with a space where a unit begins, and only there
        found = list(map(self.known.__getitem__, pieces))
        begins = np.fromiter((p[0] == " " for p in pieces), bool, len(pieces))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        if len(pieces):
            many[plain] = np.add.reduceat(sizes, np.flatnonzero(begins))
        others = [[*chain.from_iterable(map(self.known.__getitem__, PATTERN.findall(said[i])))] for i in np.flatnonzero(~plain)]
        if not others:
            return ids, many
        many[~plain] = [len(x) for x in others]
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(others), np.int32, int(many[~plain].sum()))])
        starts = np.zeros(len(units), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts[order] = np.cumsum(many[order]) - many[order]
        return ids[spread(starts, many)], many


def _utf8_states() -> list[dict[int, int]]:
    """State -> byte -> state. 0: between characters; 1, 2, 3: so many bytes to come; 4 to 7: after E0, ED, F0, F4."""
    cont = range(0x80, 0xC0)
    states: list[dict[int, int]] = [{} for _ in range(8)]
    states[0] |= {b: 0 for b in range(0x80)} | {b: 1 for b in range(0xC2, 0xE0)} | {b: 2 for b in range(0xE1, 0xF0)} | {b: 3 for b in range(0xF1, 0xF4)}
    states[0] |= {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
    for state, after in ((1, 0), (2, 1), (3, 2)):
        states[state] = {b: after for b in cont}
    states[4] = {b: 1 for b in range(0xA0, 0xC0)}
    states[5] = {b: 1 for b in range(0x80, 0xA0)}
    states[6] = {b: 2 for b in range(0x90, 0xC0)}
    states[7] = {b: 2 for b in range(0x80, 0x90)}
    return states


UTF8 = _utf8_states()


class StreamDecoder:
    """Ids to text piece by piece: ``feed`` returns what is certain, ``end`` the rest; ill-formed parts become U+FFFD."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.whole: dict[int, str | None] = {}
        size = max(tokens) + 1
        self.lengths, self.parts = np.zeros(size, np.int64), np.ones(size, bool)
        for i, t in tokens.items():
            state = 0
            for byte in t:
                state = UTF8[state].get(byte, -1)
                if state < 0:
                    break
            self.whole[i] = t.decode() if state == 0 else None  # such a token leads from state 0 to state 0
            self.lengths[i], self.parts[i] = len(t), state != 0
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.state, self.held = 0, bytearray()

    def decoded(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The texts of many rows of ids in UTF-8; only rows with parts of characters go through ``feed``."""
        count = self.lengths[ids]
        flat = self.bytes[spread(self.starts[ids], count)].tobytes()
        at = np.concatenate([[0], np.cumsum(count)])[first].tolist()
        parts = np.concatenate([[0], np.cumsum(self.parts[ids])])[first]
        out = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(np.diff(parts)):
            out[i] = (self.feed(ids[first[i] : first[i + 1]].tolist()) + self.end()).encode()
        return out

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        whole = self.whole
        for i in ids:
            if self.state == 0 and (text := whole[i]) is not None:
                out.append(text)
                continue
            for byte in self.tokens[i]:
                after = UTF8[self.state].get(byte)
                if after is None and self.state:  # what is held is ill-formed; this byte begins anew
                    out.append("�")
                    self.held.clear()
                    self.state = 0
                    after = UTF8[0].get(byte)
                if after is None:
                    out.append("�")
                    continue
                self.held.append(byte)
                self.state = after
                if after == 0:
                    out.append(self.held.decode())
                    self.held.clear()
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.state else ""
        self.state = 0
        self.held.clear()
        return out


class _Tools:
    """One of each a Python worker; ranks are read from the installed vocabulary, or from ``path`` on every machine."""

    def __init__(self, path: str | None):
        transducer = Transducer(load_ranks(path or public_tokenizers.path(RANKS)))
        self.encoder, self.decoder = UnitEncoder(PieceEncoder(transducer)), StreamDecoder(transducer.tokens)
        said = [f"{i} ".encode() for i in range(max(transducer.tokens) + 1)]
        self.lengths = np.array([len(x) for x in said])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.digits = np.frombuffer(b"".join(said), np.uint8)

    def decimals(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Each row's ids in decimal, joined by one space."""
        count = self.lengths[ids]
        flat = self.digits[spread(self.starts[ids], count)].tobytes()
        at = np.concatenate([[0], np.cumsum(count)])[first].tolist()
        return [flat[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:], strict=True)]


def _tools(path: str | None) -> _Tools:
    return worker_tools(("bpe", path), lambda: _Tools(path))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(doc_id long, ids array<int>): the ids of each whole text, without special tokens. Null and empty: no ids.

    One row a row of ``docs``, repeated ones and null ids too; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tools(ranks_path).encoder
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                ids, first = encoder(*bytes_of(part.column(1)))
                yield arrow("doc_id long, ids array<int>", (part.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))))

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(doc_id long, text string): the text of each row's ids. Null ids: empty text; ill-formed UTF-8: U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tools(ranks_path).decoder
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                ids = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield arrow("doc_id long, text string", (own.column(0), pa.array([x.decode() for x in decoder.decoded(ids, np.array([0, len(ids)]))])))

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(trimmed(run), "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``encode``, then ``decode``, both as digests, in one pass so that no ids leave the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(ranks_path)
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                ids, first = tools.encoder(*bytes_of(part.column(1)))
                coded = [hashlib.sha256(x).hexdigest() for x in tools.decimals(ids, first)]
                decoded = [hashlib.sha256(x).hexdigest() for x in tools.decoder.decoded(ids, first)]
                yield arrow(DIGEST, (part.column(0), np.diff(first), coded, decoded))

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run), DIGEST)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Cutting texts into units that encode alike wherever they stand, and keeping what has been encoded.

A cut lies before each space, and before and behind each line feed, that has no white space beside it: there the public
pattern cuts too, whatever lies around. What lies between two cuts is a unit, mostly a word with the space before it.
The units of a slice are hashed together, each distinct one is looked up in a table of bounded size, and only those
that aren't there are encoded. Ids are gathered for the whole slice at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import groups, hash_spans, spread

#: Units that each of a table's two generations holds at most, and bytes of a unit that is kept.
KEPT, LONGEST_KEPT = 400_000, 64
#: Bytes of text that are encoded at a time.
WINDOW = 1 << 20

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True
# Unicode's white space beyond ASCII, in UTF-8: U+0085, U+00A0; U+1680; U+2000 to U+200A, U+2028, U+2029, U+202F; U+205F; U+3000.
_WIDE = {
    0xC2: [b"\xc2\x85", b"\xc2\xa0"],
    0xE1: [b"\xe1\x9a\x80"],
    0xE2: [*(bytes([0xE2, 0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f"],
    0xE3: [b"\xe3\x80\x80"],
}


def white_space(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a white space character."""
    out = _ASCII_SPACE[data]
    for lead, characters in _WIDE.items():
        at = np.flatnonzero(data == lead)
        for c in characters if len(at) else ():
            own = at[at + len(c) <= len(data)]
            for i, byte in enumerate(c):
                own = own[data[own + i] == byte]
            for i in range(len(c)):
                out[own + i] = True
    return out


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin in concatenated texts whose offsets are ``at``: at the texts' begins too, in ascending order."""
    n = len(data)
    head = np.zeros(n + 1, bool)
    head[at] = True
    if n:
        solid = ~white_space(data)
        own = np.flatnonzero((data == 32) | (data == 10))
        own = own[(own > 0) & (own < n - 1)]
        own = own[solid[own - 1] & solid[own + 1] & ~head[own] & ~head[own + 1]]
        head[own] = True
        head[own[data[own] == 10] + 1] = True
    return np.flatnonzero(head[:n])


def joinable(unit: str) -> bool:
    """Whether the unit is a space and one word: such units behind each other encode as each by itself."""
    return len(unit) > 1 and unit[0] == " " and len(unit.split()) == 1 and not unit[1].isspace() and not unit[-1].isspace()


def _long(data: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Parts of one text of about a window's size, from cut to cut; longer ones where there is no cut."""
    while start < stop:
        size = WINDOW
        while (end := min(start + size, stop)) < stop:
            own = cuts(data[start:end], np.array([0, end - start]))
            own = own[(own > 0) & (own < end - start - 8)]  # what stands at the window's end may go on behind it
            if len(own):
                end = start + int(own[-1])
                break
            size *= 2
        yield start, end
        start = end


class _Generation:
    """Hash of a unit -> its ids, as sorted arrays; ``check`` tells units of one hash apart."""

    def __init__(self):
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, hashed: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Each unit's row, or -1."""
        if not len(self.hashes):
            return np.full(len(hashed), -1)
        row = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where((self.hashes[row] == hashed) & (self.checks[row] == checks), row, -1)

    def add(self, hashed: np.ndarray, checks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashed)
        to = np.searchsorted(self.hashes, hashed[order])
        starts = np.cumsum(counts) - counts + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        self.hashes, self.checks = np.insert(self.hashes, to, hashed[order]), np.insert(self.checks, to, checks[order])
        self.starts, self.counts = np.insert(self.starts, to, starts[order]), np.insert(self.counts, to, counts[order])


class UnitEncoder:
    """Whole texts to ids by ``encode``: list of units -> (all their ids, how many each has)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT):
        self.encode, self.kept = encode, kept
        self.new, self.old = _Generation(), _Generation()

    def _window(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated texts, and where each text's begin (n + 1)."""
        begin = cuts(data, at)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        end = np.append(begin[1:], len(data))
        hashed = hash_spans(data, begin, end)
        size = end - begin
        checks = size.astype(np.uint32) & np.uint32(255)
        for shift, place in ((8, begin), (16, begin + size // 2), (24, end - 1)):
            checks |= data[place].astype(np.uint32) << np.uint32(shift)
        order = np.argsort(hashed)
        fresh = np.concatenate([[True], np.diff(hashed[order]) != 0])
        rep, which = order[fresh], np.empty(len(begin), np.int64)
        which[order] = np.cumsum(fresh) - 1
        unlike = np.flatnonzero(checks[rep[which]] != checks)  # other units of the same hash stand for themselves
        which[unlike] = len(rep) + np.arange(len(unlike))
        rep = np.append(rep, unlike)

        ids, starts, counts = self._ids(data, begin[rep], end[rep], hashed[rep], checks[rep])
        counts_all = counts[which]
        out = ids[spread(starts[which], counts_all)]
        sums = np.concatenate([[0], np.cumsum(counts_all)])
        return out, sums[np.searchsorted(begin, at)]

    def _ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashed: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and each distinct unit's place and number of ids in it."""
        new, old = self.new.find(hashed, checks), self.old.find(hashed, checks)
        starts, counts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int32)
        in_new, in_old, missing = new >= 0, (new < 0) & (old >= 0), np.flatnonzero((new < 0) & (old < 0))
        starts[in_new], counts[in_new] = self.new.starts[new[in_new]], self.new.counts[new[in_new]]
        starts[in_old], counts[in_old] = self.old.starts[old[in_old]] + len(self.new.pool), self.old.counts[old[in_old]]
        pools = [self.new.pool, self.old.pool]
        if len(missing):
            buffer = data.tobytes()
            found, many = self.encode([buffer[i:j] for i, j in zip(begin[missing].tolist(), end[missing].tolist(), strict=True)])
            starts[missing] = np.cumsum(many) - many + len(pools[0]) + len(pools[1])
            counts[missing] = many
            pools.append(found)
        pool = np.concatenate(pools)
        keep = np.concatenate([np.flatnonzero(in_old), missing])  # what the older generation knows stays as it is used
        keep = keep[end[keep] - begin[keep] <= LONGEST_KEPT]
        if len(keep):
            self.new.add(hashed[keep], checks[keep], pool[spread(starts[keep], counts[keep])], counts[keep])
            if len(self.new.hashes) >= self.kept:
                self.old, self.new = self.new, _Generation()
        return pool, starts, counts

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of the texts ``data[at[i]:at[i + 1]]``, and where each text's begin in them (n + 1).

        A text longer than a window is encoded in parts, from cut to cut.
        """
        parts, lengths = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i, j in groups(at, WINDOW):
            if at[j] - at[i] <= WINDOW:
                ids, first = self._window(data[at[i] : at[j]], at[i : j + 1] - at[i])
                parts.append(ids)
                lengths.append(np.diff(first))
                continue
            held = len(parts)
            for a, b in _long(data, int(at[i]), int(at[j])):
                parts.append(self._window(data[a:b], np.array([0, b - a]))[0])
            lengths.append(np.array([sum(map(len, parts[held:]))]))
        return np.concatenate(parts), np.cumsum(np.concatenate(lengths))

"""Pieces of the suffix-array dedup that know nothing of Spark: anchors, front-coded runs and the loser tree."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import zstandard

LENGTH = 50  # a string of so many bytes that starts in an earlier document is removed
GRAM = 20  # anchors are starts of such grams
LEFT = LENGTH - GRAM  # bytes before an anchor that a string around it may hold
WIDTH = LENGTH + LEFT  # bytes of an anchor's context
#: No UTF-8 text holds these bytes; they stand where a context reaches over its document's start or end.
PAD_LEFT, PAD_RIGHT = 0xFE, 0xFF

_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 2**64))


def _slide(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = of(x[:-done], x[done:])
        done *= 2
    return x if done == width else of(x[: len(x) - (width - done)], x[width - done :])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all grams of ``data``, mixed so that their order is as good as random."""
    h1 = _BYTES[data]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    n = len(data) - GRAM + 1
    h = h16[:n] * _power(4) + h4[16 : 16 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of documents that lie end to end in ``data``.

    A string of LENGTH bytes has its least gram hash at its anchors; equal strings have equal anchors, wherever
    they lie, so only strings around an equal anchor can be equal. Works through ``data`` in steps, so memory is
    bounded however long a document is.
    """
    spread, positions, hashes = LENGTH - GRAM + 1, [], []
    for at in range(0, max(0, len(data) - LENGTH + 1), step):
        part = data[at : at + step + LENGTH - 1]
        g = gram_hashes(part)
        least = _slide(g, spread, np.minimum)  # by start of string
        for end in ends[np.searchsorted(ends, at, side="right") :]:  # no string crosses a document's end
            if end - LENGTH + 1 - at >= len(least):
                break
            least[max(0, end - LENGTH + 1 - at) : end - at] = 0
        around = np.concatenate([np.zeros(spread - 1, np.uint64), least, np.zeros(spread - 1, np.uint64)])
        most = _slide(around, spread, np.maximum)  # by gram
        found = np.flatnonzero((most == g) & (g > 0))
        positions.append(found + at)
        hashes.append(g[found])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(positions), return_index=True)
    return p, np.concatenate(hashes)[first]


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row per anchor: LENGTH bytes from it on, then the LEFT bytes before it, nearest first."""
    n = len(data)
    right, left = at[:, None] + np.arange(LENGTH), at[:, None] - 1 - np.arange(LEFT)
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, :LENGTH] = np.where(right < ends[:, None], data[np.minimum(right, n - 1)], PAD_RIGHT)
    out[:, LENGTH:] = np.where(left >= starts[:, None], data[np.maximum(left, 0)], PAD_LEFT)
    return out


def row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * np.uint64(_BASE) + _BYTES[rows[:, k]]
    return h ^ (h >> np.uint64(29))


def distinct_contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts of anchors, and which of them each anchor has. Works in steps, so a run of one byte, where every position is an anchor, costs little more than its positions."""
    hashes, rows, own = np.empty(len(at), np.uint64), [], []
    for k in range(0, len(at), step):
        part = contexts(data, starts[k : k + step], ends[k : k + step], at[k : k + step])
        hashes[k : k + step] = h = row_hashes(part)
        values, first = np.unique(h, return_index=True)
        rows.append(part[first])
        own.append(values)
    values, first = np.unique(np.concatenate(own), return_index=True)
    return np.concatenate(rows)[first], np.searchsorted(values, hashes)


_squeeze = zstandard.ZstdCompressor(level=3)
_open = zstandard.ZstdDecompressor()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, by byte planes, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return _squeeze.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_open.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def front_code(rows: np.ndarray, docs: np.ndarray) -> bytes:
    """A run of sorted rows: each row's common prefix with the one before it, and the rest; with a document each."""
    n = len(rows)
    same = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    rest = rows[np.arange(WIDTH) >= same[:, None]]
    ids = np.ascontiguousarray(docs.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return n.to_bytes(8, "little") + _squeeze.compress(same.astype(np.uint8).tobytes() + ids + rest.tobytes())


class Run:
    """Reads a front-coded run: ``row`` is the present row, ``shared`` its common prefix with the one before."""

    __slots__ = ("at", "doc", "docs", "index", "n", "rest", "row", "same", "shared")

    def __init__(self, blob: bytes):
        self.n = int.from_bytes(blob[:8], "little")
        raw = _open.decompress(blob[8:])
        self.same, self.rest, self.at, self.index, self.row = raw[: self.n], raw[9 * self.n :], 0, -1, b""
        self.docs = array("q", np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * self.n, self.n).reshape(8, -1).T).tobytes())

    def advance(self) -> bool:
        i = self.index = self.index + 1
        if i >= self.n:
            return False
        s = self.shared = self.same[i]
        end = self.at + WIDTH - s
        self.row = self.row[:s] + self.rest[self.at : end]
        self.at, self.doc = end, self.docs[i]
        return True


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of rows that agree in ``known`` bytes: nothing before it is looked at again."""
    if a[known:] == b[known:]:
        return WIDTH
    while a[known : known + 8] == b[known : known + 8]:
        known += 8
    while a[known] == b[known]:
        known += 1
    return known


def merge(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes, int, int]]:
    """Merges front-coded runs with a loser tree: yields (run, index, row, doc, prefix shared with the row before).

    Every player knows its common prefix with the last winner. Of two players the one with the longer prefix is
    smaller; only with equal prefixes are bytes compared, from that prefix on, and the loser notes the new one.
    """
    runs = [Run(b) for b in blobs]
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    over = [True] * size
    lcp = [0] * size
    rows = [b""] * size
    for k, r in enumerate(runs):
        if r.advance():
            over[k], rows[k] = False, r.row
    losers = [0] * size

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), by row and then run."""
        if over[a]:
            return b, a
        if over[b]:
            return a, b
        la, lb = lcp[a], lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y = rows[a], rows[b]
        p = common_prefix(x, y, la)
        if p == WIDTH:
            a, b = (a, b) if a < b else (b, a)
        elif x[p] > y[p]:
            a, b = b, a
        lcp[b] = p
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        won, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return won

    winner = build(1)
    while not over[winner]:
        r = runs[winner]
        yield winner, r.index, r.row, r.doc, lcp[winner]
        if r.advance():
            rows[winner], lcp[winner] = r.row, r.shared
        else:
            over[winner] = True
        node = (winner + size) >> 1
        while node:
            winner, losers[node] = duel(winner, losers[node])
            node >>= 1


def removed_spans(group: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """For rows around one anchor, each with a document: the span (from the anchor's LEFT bytes before it) that is removed.

    A string of the span also lies at the same place around the anchor in a row of a smaller document. Strings
    around an anchor overlap, so their union is one span; (0, 0) is none.
    """
    first: dict[bytes, int] = {}
    for row, doc in group:
        if doc < first.get(row, doc + 1):
            first[row] = doc
    spans: dict[bytes, tuple[int, int]] = {}
    places = {}
    for row in first:
        right, left = row[:LENGTH].rstrip(b"\xff"), row[LENGTH:].rstrip(b"\xfe")
        places[row] = (LEFT - len(left), LEFT + len(right), left[::-1] + right)
    if len(first) > 1:
        least: dict[tuple[int, bytes], int] = {}
        for row, doc in first.items():
            a, b, text = places[row]
            for o in range(a, b - LENGTH + 1):
                key = (o, text[o - a : o - a + LENGTH])
                if doc < least.get(key, doc + 1):
                    least[key] = doc
        for row, doc in first.items():
            a, b, text = places[row]
            hit = [o for o in range(a, b - LENGTH + 1) if least[o, text[o - a : o - a + LENGTH]] < doc]
            spans[row] = (hit[0], hit[-1] + LENGTH) if hit else (0, 0)
    out = []
    for row, doc in group:
        a, b, _ = places[row]
        if doc > first[row]:
            out.append((a, b) if b - a >= LENGTH else (0, 0))
        else:
            out.append(spans.get(row, (0, 0)))
    return out

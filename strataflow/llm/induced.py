"""External induced suffix sorting with common-prefix values, in vectorized batches.

Suffixes are typed S or L by their successor. The leftmost S suffixes are sorted by naming the substrings between
them and sorting the shorter string of names (recursively, until it fits the base case). All others are
induced: an ascending scan yields the L suffixes, a descending one the S suffixes. What a scan
induces waits in a disk-backed priority queue of (position, common prefix with the entry before it), ordered by
first symbol and then by arrival; since a scan visits symbols in order, the queue is monotone, one FIFO
for each symbol, and is popped in whole chunks. Common-prefix values are induced with the entries,
as one more than the minimum over the scanned range between two arrivals; they saturate at ``limit``.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque

import numpy as np

#: Entries of a queue held in memory; beyond, its chunks go to a file of the task's own scratch space.
QUEUE_ITEMS = 4_000_000
#: Length of a string of names that is sorted in memory instead of by one more level of induction.
BASE_ITEMS = 8_000_000
SEPARATOR = 0xFE  # neither it nor the terminator occurs in UTF-8
_TERMINATOR = 0xFF


class Queue:
    """Monotone priority queue: FIFO chunks for each symbol, spilled to one file."""

    def __init__(self, items: int = QUEUE_ITEMS):
        self.most, self.held = items, 0
        self.chunks: dict[int, deque] = {}
        self.file = None

    def push(self, symbol: int, chunk: np.ndarray) -> None:
        if len(chunk):
            self.chunks.setdefault(symbol, deque()).append(chunk)
            self.held += len(chunk)
            if self.held > self.most:
                self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, os.SEEK_END)
        for parts in self.chunks.values():
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[i] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
        self.held = 0

    def _load(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            self.held -= len(part)
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(part[1] * 8), np.int64)

    def pop(self, symbol: int, most: int = 1 << 20) -> np.ndarray | None:
        """The next chunks of a symbol, as one of about ``most`` entries."""
        return self._take(symbol, most, "popleft")

    def pop_last(self, symbol: int, most: int = 1 << 20) -> np.ndarray | None:
        """The last chunks of a symbol, in their own order."""
        return self._take(symbol, most, "pop")

    def _take(self, symbol: int, most: int, how: str) -> np.ndarray | None:
        parts, out, n = self.chunks.get(symbol), [], 0
        while parts and n < most:
            out.append(self._load(getattr(parts, how)()))
            n += len(out[-1])
        if len(out) < 2:
            return out[0] if out else None
        return np.concatenate(out if how == "popleft" else out[::-1])

    def close(self) -> None:
        self.chunks.clear()
        if self.file is not None:
            self.file.close()


def suffix_types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is_s, run): whether suffix i is smaller than suffix i + 1, and the equal symbols from i on (at most 65535)."""
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    ends = np.concatenate([starts[1:], [len(text)]])
    rising = np.zeros(len(starts), bool)
    rising[:-1] = text[starts[1:]] > text[starts[:-1]]
    run = np.minimum(np.repeat(ends, ends - starts) - np.arange(len(text)), 65535).astype(np.uint16)
    return np.repeat(rising, ends - starts), run


class _Scan:
    """Feeds scanned suffixes, in order, and queues what they induce."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, want_s: bool, symbols: int, limit: int, items: int):
        self.text, self.is_s, self.want_s, self.limit = text, is_s, want_s, limit
        self.queue = Queue(items)
        if limit:
            self.carry = np.full(symbols, limit, np.int64)  # smallest value scanned since the symbol's last arrival
            self.seen = np.zeros(symbols, bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        ahead = pos - 1
        at = np.flatnonzero((ahead >= 0) & (self.is_s[ahead] == self.want_s))
        goes = self.text[ahead[at]]
        order = np.argsort(goes, kind="stable")
        at, goes = at[order], goes[order]
        cuts = np.flatnonzero(np.concatenate([[True], goes[1:] != goes[:-1]])) if len(goes) else np.empty(0, np.int64)
        least = int(lcp.min()) if self.limit and len(lcp) else 0
        here = np.zeros(len(self.carry), bool) if self.limit else None
        for k, a in enumerate(cuts):
            b = cuts[k + 1] if k + 1 < len(cuts) else len(at)
            symbol, which = int(goes[a]), at[a:b]
            new = ahead[which] << 8
            if self.limit:
                bounds = np.concatenate([[0], which[:-1] + 1])
                low = np.minimum.reduceat(lcp, bounds) if which[-1] + 1 == len(lcp) else np.minimum.reduceat(lcp, np.append(bounds, which[-1] + 1))
                tail = int(low[len(which)]) if len(low) > len(which) else self.limit
                low = low[: len(which)]
                low[0] = min(low[0], self.carry[symbol])
                values = np.minimum(low + 1, self.limit)
                if not self.seen[symbol]:
                    values[0], self.seen[symbol] = 0, True
                new |= values
                self.carry[symbol], here[symbol] = tail, True
            self.queue.push(symbol, new)
        if self.limit and len(lcp):
            self.carry[~here] = np.minimum(self.carry[~here], least)


def induce(text, is_s, run, lms, lms_lcp, symbols, limit, visit, items=QUEUE_ITEMS) -> None:
    """Sort all suffixes from the sorted leftmost S suffixes.

    ``visit(symbol, kind, pos, lcp)`` gets L chunks by ascending and then S chunks by descending order;
    lcp is that with the entry visited just before (of the same kind and symbol), if ``limit`` is not 0.
    """
    first = text[lms] if len(lms) else text[:0]
    present = np.unique(text)
    scan, done = _Scan(text, is_s, False, symbols, limit, items), Queue(items)
    scan.queue.push(int(text[-1]), np.array([(len(text) - 1) << 8], np.int64))
    if limit:
        scan.seen[int(text[-1])] = True
    last_l: dict[int, int] = {}
    lo = np.searchsorted(first, present, "left")
    hi = np.searchsorted(first, present, "right")
    for c, a, b in zip(present.tolist(), lo.tolist(), hi.tolist(), strict=True):
        while (chunk := scan.queue.pop(c)) is not None:
            done.push(c, chunk)
            pos, lcp = chunk >> 8, chunk & 255
            last_l[c] = int(pos[-1])
            visit(c, "L", pos, lcp)
            scan.feed(pos, lcp)
        if a < b:
            lcp = None
            if limit:
                lcp = lms_lcp[a:b].copy()
                lcp[0] = min(int(run[last_l[c]]), int(run[lms[a]]), limit) if c in last_l else 0
            scan.feed(lms[a:b], lcp)
    scan.queue.close()
    scan = _Scan(text, is_s, True, symbols, limit, items)
    for c in present[::-1].tolist():
        last_s = None
        while (chunk := scan.queue.pop(c)) is not None:
            pos, lcp = chunk >> 8, chunk & 255
            last_s = int(pos[-1])
            visit(c, "S", pos, lcp)
            scan.feed(pos, lcp)
        joint = None
        while (chunk := done.pop_last(c)) is not None:
            pos, up = (chunk >> 8)[::-1], (chunk & 255)[::-1]
            if joint is None:
                joint = min(int(run[last_s]), int(run[pos[0]]), limit) if limit and last_s is not None else 0
                if joint and joint >= limit:
                    visit(c, "joint", np.array([last_s, pos[0]]), np.array([0, joint]))
            lcp = np.concatenate([[joint], up[:-1]])
            joint = int(up[-1])
            scan.feed(pos, lcp)
    scan.queue.close()
    done.close()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as big-endian numbers (zero beyond the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _name_substrings(text: np.ndarray, words: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving names (from 1) of the substrings between leftmost S positions, both ends included.

    A substring that is a proper prefix of another one meets an L symbol there, so that it is the
    larger of the two: the terminator makes it so.
    """
    lengths = np.diff(np.append(lms, len(text) - 1)) + 1
    lengths[-1] = len(text) - lms[-1]
    short = lengths <= 7
    short[-1] = False
    bits = np.uint64(8) * (np.uint64(8) - lengths[short].astype(np.uint64))
    keys = (words[lms[short]] >> bits << bits) | (np.uint64(_TERMINATOR) << (bits - np.uint64(8)))
    distinct, inverse = np.unique(keys, return_inverse=True)
    raw = text.tobytes()
    long_at = np.flatnonzero(~short)
    long_keys = [raw[lms[i] : lms[i] + lengths[i]] + (b"\xff" if i < len(lms) - 1 else b"") for i in long_at.tolist()]
    short_keys = [int(k).to_bytes(8, "big").rstrip(b"\0") for k in distinct]
    ends = {k: i for i, k in enumerate(sorted(set(short_keys) | set(long_keys)), 1)}
    names = np.empty(len(lms), np.int64)
    names[short] = np.array([ends[k] for k in short_keys], np.int64)[inverse] if len(distinct) else 0
    names[long_at] = [ends[k] for k in long_keys]
    return names, len(ends)


def _order_names(names: np.ndarray, many: int, base: int, items: int, spans: np.ndarray | None = None, enough: int = 0) -> np.ndarray:
    """Suffix order of a string of names. ``spans``: text positions, to stop once ``enough`` of the text is compared."""
    n = len(names)
    if n == 1:
        return np.zeros(1, np.int64)
    if n > base:
        return _order_by_induction(names, many, base, items)
    rank, k = names.copy(), 1
    while True:
        order = np.argsort(rank, kind="stable") if k == 1 and rank.max() == n else None
        if order is None:
            key = rank * (int(rank.max()) + 1)
            key[:-k] += rank[k:] if k < n else 0
            order = np.argsort(key)
            sorted_key = key[order]
            fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            k *= 2
            done = fresh.all() or k >= n
            if not done and spans is not None and k < n:
                done = int((spans[k:] - spans[:-k]).min()) >= enough
            if not done:
                continue
        return order


def _order_by_induction(names: np.ndarray, many: int, base: int, items: int) -> np.ndarray:
    """One more level: the same induction over names, without common-prefix values."""
    is_s, run = suffix_types(names)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms):
        lengths = np.diff(np.append(lms, len(names) - 1)) + 1
        lengths[-1] = len(names) - lms[-1]
        keys = {}
        raw = [tuple(names[a : a + m].tolist()) + ((many + 1,) if i < len(lms) - 1 else ()) for i, (a, m) in enumerate(zip(lms.tolist(), lengths.tolist(), strict=True))]
        keys = {k: i for i, k in enumerate(sorted(set(raw)), 1)}
        lms = lms[_order_names(np.array([keys[k] for k in raw], np.int64), len(keys), base, items)]
    parts: dict[tuple[int, str], list[np.ndarray]] = {}
    induce(names, is_s, run, lms, None, many + 1, 0, lambda c, kind, pos, lcp: parts.setdefault((c, kind), []).append(pos), items)
    out = []
    for c in np.unique(names).tolist():
        out += parts.get((c, "L"), [])
        out += [p[::-1] for p in reversed(parts.get((c, "S"), []))]
    return np.concatenate(out)


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b in bytes, at most ``limit``."""
    out = np.zeros(len(a), np.int64)
    live, n = np.arange(len(a)), len(words)
    for step in range(0, limit, 8):
        x, y = a[live] + step, b[live] + step
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        same = differ == 0
        stop = differ[~same]
        more = np.zeros(len(stop), np.int64)
        for k in range(1, 8):
            more += stop < np.uint64(1 << (8 * k))
        out[live[~same]] += more
        out[live[same]] += 8
        live = live[same]
        if not len(live):
            break
    return np.minimum(out, limit)


def repeated_starts(text: np.ndarray, limit: int, base: int = BASE_ITEMS, items: int = QUEUE_ITEMS) -> np.ndarray:
    """Whether the ``limit`` (at most 255) bytes from each position on occur at another position too.

    Reads beyond the end don't count; separators are ordinary symbols to it.
    """
    n = len(text)
    out = np.zeros(n, bool)
    if n <= limit:
        return out
    is_s, run = suffix_types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    lcp = np.zeros(len(lms), np.int64)
    if len(lms):
        words = _words(text)
        names, many = _name_substrings(text, words, lms)
        lms = lms[_order_names(names, many, base, items, lms, limit + 8)]
        lcp[1:] = _common(words, lms[:-1], lms[1:], limit)
        del words, names
    before: dict[tuple[int, str], int] = {}

    def visit(symbol: int, kind: str, pos: np.ndarray, lcp: np.ndarray) -> None:
        high = np.flatnonzero(lcp >= limit)
        if len(high):
            out[pos[high]] = True
            inner = high[high > 0]
            out[pos[inner - 1]] = True
            if high[0] == 0:
                out[before[symbol, kind]] = True
        before[symbol, kind] = int(pos[-1])

    induce(text, is_s, run, lms, lcp, 256, limit, visit, items)
    return out

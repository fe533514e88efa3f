"""Re-Pair grammar compression of token ids, in numpy rounds.

A round counts all pairs of a block, gives every frequent one a nonterminal and replaces its occurrences; where
occurrences overlap, the more frequent pair wins and the other waits for a later round. Rounds go on until no pair
is frequent: each replaces the most frequent one at least. A pair of old symbols can only grow rarer, so after the
first round only places of pairs that were frequent or hold a new symbol are counted. A block stores its alphabet, the rules, and the expansion length of every symbol, so that any range of ids can be decoded alone.
"""

from __future__ import annotations

from itertools import count

import numpy as np

#: A pair is frequent from this count on: a rule takes its two symbols and a length, so fewer places would not pay for it.
MIN_COUNT = 6
#: Pairs replaced at once, the most frequent first; the others are in later rounds.
RULES_PER_ROUND = 4096
_TABLE_BITS = 16


class Grammar:
    """``alphabet``: ids of the terminals; ``rules``: (left, right) of each nonterminal; ``lengths``: ids under each symbol."""

    def __init__(self, alphabet: np.ndarray, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray):
        self.alphabet, self.rules, self.lengths, self.sequence = alphabet, rules, lengths, sequence

    def dumps(self) -> bytes:
        wide = 2 if len(self.lengths) <= 1 << 16 else 4
        head = np.array([len(self.alphabet), len(self.rules), len(self.sequence), wide], np.uint64)
        kind = f"<u{wide}"
        return b"".join(
            (
                head.astype("<u8").tobytes(),
                self.alphabet.astype("<u4").tobytes(),
                self.rules.astype(kind).tobytes(),
                self.lengths[len(self.alphabet) :].astype("<u4").tobytes(),
                self.sequence.astype(kind).tobytes(),
            )
        )

    @classmethod
    def loads(cls, raw: bytes) -> Grammar:
        n, m, k, wide = (int(x) for x in np.frombuffer(raw, "<u8", 4))
        kind, at = f"<u{wide}", 32
        alphabet = np.frombuffer(raw, "<u4", n, at).astype(np.int64)
        at += 4 * n
        rules = np.frombuffer(raw, kind, 2 * m, at).astype(np.int64).reshape(-1, 2)
        at += 2 * m * wide
        out = cls.__new__(cls)
        out.alphabet, out.rules = alphabet, rules
        out.lengths = np.concatenate([np.ones(n, np.int64), np.frombuffer(raw, "<u4", m, at).astype(np.int64)])
        out.sequence = np.frombuffer(raw, kind, k, at + 4 * m).astype(np.int64)
        return out

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of the block. For a range that is short beside the rules only the symbols that reach into it are
        expanded; for a long one every symbol is, once."""
        ends = np.cumsum(self.lengths[self.sequence])
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop - 1, "right"))
        s = self.sequence[first : last + 1]
        skip = start - (int(ends[first]) - int(self.lengths[s[0]]))
        width = self.lengths[s]
        if self.lengths.sum() > 4 * width.sum():  # a short range, or long symbols many of which hold each other
            return self.alphabet[self._expand(s)][skip : skip + stop - start].astype(np.uint32)
        under, at = self._expansions()
        places = np.repeat(at[s] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        return under[places[skip : skip + stop - start]].astype(np.uint32)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids under all symbols in one array, and where those of each symbol begin."""
        return self.alphabet[self._expand(np.arange(len(self.lengths)))], np.cumsum(self.lengths) - self.lengths

    def _expand(self, s: np.ndarray) -> np.ndarray:
        """Places in the alphabet of the ids under some symbols, one after the other."""
        n = len(self.alphabet)
        while (deep := s >= n).any():
            width = deep + 1
            at = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.int64)
            out[at[~deep]] = s[~deep]
            out[at[deep]] = self.rules[s[deep] - n, 0]
            out[at[deep] + 1] = self.rules[s[deep] - n, 1]
            s = out
        return s


def compress(ids: np.ndarray, rounds: int | None = None, min_count: int = MIN_COUNT) -> Grammar:
    """The grammar of one block of ids (of any values up to 2**32 - 1), complete unless ``rounds`` bounds it."""
    if len(ids) and int(ids.max()) < 1 << 20:
        alphabet = np.flatnonzero(np.bincount(ids))
        place = np.zeros(int(alphabet[-1]) + 1, np.int32)
        place[alphabet] = np.arange(len(alphabet))
        s = place[ids]
    else:
        alphabet, s = np.unique(ids, return_inverse=True)
        s = s.astype(np.int32)
    rules: list[np.ndarray] = []
    symbols, lengths = len(alphabet), np.ones(len(alphabet), np.int64)
    place = np.arange(max(len(s) - 1, 0), dtype=np.int32)
    for _ in count() if rounds is None else range(rounds):
        if not len(place) or symbols >= 1 << 31:
            break
        small = symbols + RULES_PER_ROUND <= 1 << 16
        bits = 16 if small else 32
        left, right = (s[:-1], s[1:]) if len(place) == len(s) - 1 else (s[place], s[place + 1])
        keys = left.view(np.uint32) << 16 | right.view(np.uint32) if small else left.astype(np.uint64) << np.uint64(32) | right.view(np.uint32)
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        counts = np.diff(edge)
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        waits = np.zeros(1 << _TABLE_BITS, bool)
        waits[_slots(ordered[edge[often]])] = True
        if len(often) > RULES_PER_ROUND:
            often = often[np.argsort(-counts[often], kind="stable")[:RULES_PER_ROUND]]
        pairs, counts = ordered[edge[often]], counts[often]
        order = np.argsort(-counts, kind="stable")
        pairs = pairs[order]
        # A table of slots finds a pair's rank; of pairs that share a slot the most frequent one is in this round.
        slot = _slots(pairs)
        table = np.full(1 << _TABLE_BITS, -1, np.int32)
        table[slot[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        slot = _slots(keys)
        again = np.zeros(len(s), bool)
        again[place] = waits[slot]
        rank = table[slot]
        at = np.flatnonzero((rank >= 0) & (pairs[rank] == keys))
        at, rank = place[at], rank[at]
        chosen = _without_overlap(at, len(pairs) - rank)
        at, rank = at[chosen], rank[chosen]
        used = np.flatnonzero(np.bincount(rank, minlength=len(pairs)))
        number = np.zeros(len(pairs), np.int32)
        number[used] = np.arange(len(used))
        both = pairs[used].astype(np.int64)
        rules.append(np.stack([both >> bits, both & ((1 << bits) - 1)], axis=1))
        lengths = np.concatenate([lengths, lengths[rules[-1][:, 0]] + lengths[rules[-1][:, 1]]])
        s[at] = symbols + number[rank]
        symbols += len(used)
        again[at] = again[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        place = np.flatnonzero(again[keep][:-1]).astype(np.int32)
    return Grammar(alphabet, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), lengths, s)


def _without_overlap(at: np.ndarray, worth: np.ndarray, passes: int = 2) -> np.ndarray:
    """Which of the places ``at`` (ascending) to replace, none right beside another: twice those worth more than their
    neighbours, then every other one of what is left."""
    beside = np.diff(at) == 1
    worth = worth.astype(np.int32)
    chosen = np.zeros(len(at), bool)
    for _ in range(passes):
        best = worth > 0
        best[1:] &= ~beside | (worth[1:] > worth[:-1])
        best[:-1] &= ~beside | (worth[:-1] >= worth[1:])
        chosen |= best
        worth[best] = 0
        worth[:-1][best[1:] & beside] = 0
        worth[1:][best[:-1] & beside] = 0
    left = np.flatnonzero(worth)
    if len(left):
        start = np.concatenate([[True], np.diff(at[left]) > 1])
        first = np.maximum.accumulate(np.where(start, np.arange(len(left)), 0))
        chosen[left[(np.arange(len(left)) - first) % 2 == 0]] = True
    return chosen


def _slots(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        if keys.dtype == np.uint32:
            return keys * np.uint32(0x9E3779B1) >> np.uint32(32 - _TABLE_BITS)
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

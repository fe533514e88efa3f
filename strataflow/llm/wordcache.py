"""Ids of words or pieces that came up before, for tokenizers that encode each of them by itself.

A batch's strings are told apart in Arrow, so that a Python object is made for each distinct one only, and its ids are put together
by numpy. The number of strings kept is bounded; the oldest quarter goes when it is reached.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Characters of texts that are worked off together, and of a long text that are cut off at once.
BATCH_CHARS = 2_000_000
#: Ids that are put in their places at once.
IDS_AT_ONCE = 1 << 18


class IdCache:
    """``learn`` gives the ids of new strings as bytes of ``kind``."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], kind: type, kept: int):
        self.learn, self.kind, self.kept = learn, np.dtype(kind), kept
        self.known: dict[str, bytes] = {}

    def look_up(self, distinct: list[str]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, distinct))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            words = [distinct[i] for i in missing]
            for i, w, ids in zip(missing, words, self.learn(words), strict=True):
                found[i] = known[w] = ids
            if len(known) > self.kept:
                for w in list(islice(known, len(known) - self.kept + self.kept // 4)):
                    del known[w]
        return found

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's ids end."""
        if not len(words):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        coded = words.dictionary_encode()
        found = self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        at, starts = coded.indices.to_numpy(), np.cumsum(size) - size
        ends = np.cumsum(size[at])
        out, a = np.empty(int(ends[-1]), self.kind), 0
        while a < len(at):  # in steps, as the places are wider than the ids
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + IDS_AT_ONCE, "right")))
            some = at[a:b]
            width = size[some]
            out[done : int(ends[b - 1])] = flat[np.repeat(starts[some] - (ends[a:b] - width), width) + np.arange(done, int(ends[b - 1]))]
            a = b
        return out, ends


def spans(texts: list[str | None], chars: int = BATCH_CHARS):
    """(from, to) of runs of texts of up to ``chars`` characters, or of one longer text."""
    at = 0
    while at < len(texts):
        cut, held = at, 0
        while cut < len(texts) and (cut == at or held + len(texts[cut] or "") <= chars):
            held += len(texts[cut] or "")
            cut += 1
        yield at, cut
        at = cut


def runs(text: str, chars: int, space: re.Pattern) -> Iterator[str]:
    """A text in runs of about ``chars`` characters, cut at single white-space characters, which are left out."""
    at = 0
    while len(text) - at > chars and (m := space.search(text, at + chars)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]

"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A text is cut by the tokenizer's pattern. Inside each piece the leaves of a segment tree stand for
byte positions; a live leaf holds the rank of the pair that starts there. Inner nodes hold the
leftmost minimum, so the root names the next merge; the merge changes the leaves of the new token
and of its live left neighbour and the dead leaf of the right token, each in O(log n).
Pieces of up to 64 bytes run through the same tree for a whole batch at once, in numpy columns; longer
ones, whatever their length, run one at a time. Pieces that came up before are taken from a cache
of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, free_name, map_text
from .wordcache import BATCH_CHARS, IdCache, spans

CACHED_PIECES = 100_000
#: Widths of trees in steps of 2 and more; any width works, as a node's children are 2i and 2i + 1 in any heap.
ROW_SIZES = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64)
_ID_BITS = 20
_PLACE_BITS = 6  # a leaf of a column holds rank << 6 | position
_NEVER = np.int32(2**31 - 1)  # no pair starts here
_EMPTY = np.int64(-(2**63))


class Ranks:
    """A rank file and what merging needs: the token of two neighbours, by id pair."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        token = {i: t for t, i in self.rank.items()}
        if len(token) != len(self.rank) or max(token) >= 1 << _ID_BITS:
            raise ValueError(f"{path}: ranks must be distinct and below {1 << _ID_BITS}")
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"{path}: bytes {missing[:5]} have no rank")
        self.kind = np.uint16 if max(token) < 1 << 16 else np.uint32
        self.token = np.full(max(token) + 1, None, object)
        self.decimal = np.full(max(token) + 1, None, object)
        for i, t in token.items():
            self.token[i], self.decimal[i] = t, str(i).encode()
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.byte_ids = np.array([*self.byte, -1], np.int32)
        self.pattern = regex.compile(pattern)
        self.pair: dict[int, int] = {}
        for part, i in self.rank.items():
            for cut in range(1, len(part)):
                left, right = self.rank.get(part[:cut]), self.rank.get(part[cut:])
                if left is not None and right is not None:
                    self.pair[left << _ID_BITS | right] = i
        self._deal(np.fromiter(self.pair, np.int64, len(self.pair)), np.fromiter(self.pair.values(), np.int32, len(self.pair)))

    def _deal(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """The pairs as a table with open addresses: each key in the first free cell from its slot on."""
        self._shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        order = np.argsort(self._slot(keys), kind="stable")
        slot, place = self._slot(keys[order]), np.arange(len(keys))
        cell = place + np.maximum.accumulate(slot - place) if len(keys) else slot
        self._keys = np.full((1 << 64 - int(self._shift)) + len(keys) + 1, _EMPTY)
        self._ids = np.full(len(self._keys), -1, np.int32)
        self._keys[cell], self._ids[cell] = keys[order], ids[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token of each pair of ids, -1 where the two don't merge; negative ids are no tokens."""
        keys = left.astype(np.int64) << _ID_BITS | right
        at = self._slot(keys)
        there = self._keys[at]
        out = np.where(there == keys, self._ids[at], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(todo):
            at[todo] += 1
            there = self._keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self._ids[at[todo[hit]]]
            todo = todo[~hit & (there != _EMPTY)]
        return out


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def encode_piece(table: Ranks, piece: bytes) -> list[int]:
    """One piece of any length. Leaves hold rank * n + position, so that min() is the leftmost one."""
    n = len(piece)
    whole = table.rank.get(piece)
    if whole is not None:
        return [whole]
    pair, never = table.pair.get, 1 << 62
    ids = [table.byte[b] for b in piece]
    size = 1 << max(1, (n - 1).bit_length())
    tree = [never] * (2 * size)
    for i in range(n - 1):
        r = pair(ids[i] << _ID_BITS | ids[i + 1])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while tree[1] != never:
        rank, i = divmod(tree[1], n)
        j = after[i]
        k = after[j]
        ids[i], ids[j] = rank, -1
        after[i] = k
        put(j, never)
        if k < n:
            before[k] = i
            r = pair(rank << _ID_BITS | ids[k])
            put(i, never if r is None else r * n + i)
        else:
            put(i, never)
        h = before[i]
        if h >= 0:
            r = pair(ids[h] << _ID_BITS | rank)
            put(h, never if r is None else r * n + h)
    return [i for i in ids if i >= 0]


def encode_rows(table: Ranks, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of at most ``size`` bytes, one after the other, and their number for each piece.

    One tree per piece, merged in step. Node and position go down, pieces across, so that a level is one run of memory.
    """
    many = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, many)
    flat = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(many, size).T.astype(np.int16)
    ids = np.full((size + 1, many), -1, np.int32)  # the last row stands for the end of the piece
    ids[:size] = table.byte_ids[np.where(np.arange(size)[:, None] < lengths, flat, 256)]
    after = np.repeat(np.arange(1, size + 1, dtype=np.int8)[:, None], many, 1)
    before = np.repeat(np.arange(-1, size, dtype=np.int8)[:, None], many, 1)
    tree = np.full((2 * size, many), _NEVER, np.int32)
    first = table.pairs(ids[: size - 1].ravel(), ids[1:size].ravel()).reshape(size - 1, many)
    tree[size : 2 * size - 1] = np.where(first >= 0, first << _PLACE_BITS | np.arange(size - 1, dtype=np.int32)[:, None], _NEVER)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    t, ids_, after, before, root = tree.ravel(), ids.ravel(), after.ravel(), before.ravel(), tree[1]
    levels = (2 * size - 1).bit_length() - 1
    live = np.flatnonzero(root < _NEVER)
    while len(live):
        top = root[live]
        rank, i = top >> _PLACE_BITS, (top & (1 << _PLACE_BITS) - 1).astype(np.int64)
        here = i * many + live
        j = after[here].astype(np.int64)
        there = j * many + live
        k = after[there]
        beyond = k * np.int64(many) + live
        ids_[here], ids_[there], after[here] = rank, -1, k
        inside = k < size
        before[beyond[inside]] = i[inside]
        h = before[here].astype(np.int64)
        some = np.flatnonzero(h >= 0)
        column, h, new = live[some], h[some], rank[some]
        # The dead right leaf, the new token's own leaf, and the left neighbour's: then the three paths to the root.
        t[there + size * many] = _NEVER
        value = table.pairs(rank, ids_[beyond])
        t[here + size * many] = np.where(value >= 0, value << _PLACE_BITS | i.astype(np.int32), _NEVER)
        value = table.pairs(ids_[h * many + column], new)
        t[(h + size) * many + column] = np.where(value >= 0, value << _PLACE_BITS | h.astype(np.int32), _NEVER)
        node = np.concatenate([j, i, h]) + size
        column = np.concatenate([live, live, column])
        for _ in range(levels):
            node >>= 1
            left = 2 * node * many + column
            t[node * many + column] = np.minimum(t[left], t[left + many])
        live = live[root[live] < _NEVER]
    ids = ids[:size].T
    keep = ids >= 0
    return ids[keep], keep.sum(axis=1)


class Encoder:
    """Encodes whole texts, keeping the ids of recent pieces in a cache of bounded size."""

    def __init__(self, table: Ranks, cached: int = CACHED_PIECES):
        self.table, self.cache = table, IdCache(self._learn, table.kind, cached)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Whole tokens at once, pieces of up to 64 bytes by width, longer ones one by one."""
        kind, raw = self.cache.kind, list(map(str.encode, pieces))
        whole = list(map(self.table.rank.get, raw))
        out: list[bytes | None] = [None if w is None else kind.type(w).tobytes() for w in whole]
        rest = np.array([i for i, w in enumerate(whole) if w is None], np.int64)
        group = np.searchsorted(ROW_SIZES, np.fromiter((len(raw[i]) for i in rest), np.int64, len(rest)))
        for g, size in enumerate(ROW_SIZES):
            mine = rest[group == g].tolist()
            step = 1 + 200_000 // size
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                ids, counts = encode_rows(self.table, [raw[i] for i in part], size)
                held = ids.astype(kind).tobytes()
                ends = (np.cumsum(counts) * kind.itemsize).tolist()
                for i, a, b in zip(part, [0, *ends], ends, strict=False):
                    out[i] = held[a:b]
        for i in rest[group == len(ROW_SIZES)].tolist():
            out[i] = np.array(encode_piece(self.table, raw[i]), kind).tobytes()
        return out

    def _cut(self, text: str, chars: int) -> Iterator[list[str]]:
        """The pieces of a text; those of a long one in runs, as all together would take many times its size."""
        if len(text) <= chars:
            yield self.table.pattern.findall(text)
            return
        found = (m[0] for m in self.table.pattern.finditer(text))
        while run := list(islice(found, chars // 8)):
            yield run

    def encode_many(self, texts: list[str | None], chars: int = BATCH_CHARS) -> list[np.ndarray]:
        """Ids of whole texts (null: none); new pieces of a batch are worked off together."""
        out: list[np.ndarray] = []
        for at, cut in spans(texts, chars):
            if cut == at + 1 and len(texts[at] or "") > chars:
                out.append(np.concatenate([self.cache.ids(pa.array(run, pa.large_string()))[0] for run in self._cut(texts[at], chars)]))
                continue
            split = [run for t in texts[at:cut] for run in (self._cut(t, chars) if t else ([],))]
            ids, ends = self.cache.ids(pa.array([p for pieces in split for p in pieces], pa.large_string()))
            stops = np.concatenate([[0], ends])[np.cumsum([len(pieces) for pieces in split])].tolist()
            out += [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of one whole text (null: none)."""
        return self.encode_many([text])[0].tolist()


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One cache for all tasks of a worker process."""
    return Encoder(ranks(path, pattern))


def decode(table: Ranks, ids: np.ndarray) -> bytes:
    """The bytes that some ids stand for; an id without token is an error."""
    return b"".join(table.token[ids].tolist())


def _id_lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *found]).astype(np.int32)))


def encode_documents(docs: DataFrame, path: str, pattern: str, name: str = "token_ids") -> DataFrame:
    """``docs`` plus the array column ``name`` (another free name if taken) of token ids.

    Null and empty texts have no ids; texts of any length are encoded whole; every row is kept, and
    so are all other columns.
    """

    def make():
        encoder = _encoder(path, pattern)
        return lambda texts: [_id_lists(encoder.encode_many(texts))]

    return map_text(docs, make, [T.StructField(free_name(docs, name), T.ArrayType(T.IntegerType()))])


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``encoded`` plus the binary column ``name``: the bytes that the ids in column ``ids`` stand for."""

    def make():
        table = ranks(path, pattern)
        return lambda rows: [[decode(table, np.array(r or [], np.int64)) for r in rows]]

    return map_text(encoded, make, [T.StructField(free_name(encoded, name), T.BinaryType())], text=ids)


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, and digests of the ids and of the bytes decoded from them."""
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def make():
        encoder = _encoder(path, pattern)
        table = encoder.table

        def work(texts):
            n, a, b = [], [], []
            for ids in encoder.encode_many(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(b" ".join(table.decimal[ids].tolist())).hexdigest())
                b.append(hashlib.sha256(decode(table, ids)).hexdigest())
            return [n, a, b]

        return work

    return map_text(docs.select("doc_id", "text"), make, fields, keep=["doc_id"])


def roundtrip(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", intact: str = "intact") -> DataFrame:
    """``docs`` plus the array column ``ids`` and the boolean ``intact``, each under a free name: whether the ids decode to
    the bytes that went in. Both are made in one map, so that a task needs one Python worker."""
    fields = [T.StructField(free_name(docs, ids), T.ArrayType(T.IntegerType())), T.StructField(free_name(docs, intact), T.BooleanType())]

    def make():
        encoder = _encoder(path, pattern)

        def work(texts):
            found = encoder.encode_many(texts)
            return [_id_lists(found), [decode(encoder.table, i) == as_bytes(t) for i, t in zip(found, texts, strict=True)]]

        return work

    return map_text(docs, make, fields)

"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else too are removed.

1. Every window of 200 bytes has an anchor, the smallest hash among its 32-byte strings, so that
   equal windows have equal anchors. Consecutive windows with one anchor are a strip, cut after ``STRIP`` windows, so that
   a passage of short period makes few strips, equal to each other.
2. Anchors that occur once are dropped by aggregation: none of their windows can occur elsewhere. Nothing is lost.
3. The other strips go to the bucket of their anchor, equal strips of a batch as one. The number of buckets grows with the number
   of anchors, and a task works them off one after the other. A shard is some anchors of a bucket, of ``SHARD_BYTES`` or one
   anchor: it has distinct strips with their number of occurrences, and sorts all their suffixes by external induced sorting
   (``induced``): a window is repeated if its strip occurs twice or its common prefix with a neighbour in
   suffix order reaches 200 bytes.
4. Repeated windows return to their documents as ranges and are merged there.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, lean, map_text, materialize, shrunk, small_batches, unzipped, zipped
from .induced import SEPARATOR, repeated_starts

WINDOW = 200
ANCHOR = 32
STRIP = 4096
ANCHORS_PER_BUCKET = 10_000
SHARD_BYTES = 2_000_000
_BLOCK = 1 << 18  # bytes hashed at once: bounds memory for texts of any length
_B = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Anchors:
    """Strips of whole texts."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, min(anchor, window)
        n = _BLOCK + window
        self.up, self.down = _powers(_B, n), _powers(pow(_B, -1, 1 << 64), n)

    def _hashes(self, a: np.ndarray) -> np.ndarray:
        k = self.anchor
        with np.errstate(over="ignore"):
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)])])
            h = (c[k:] - c[:-k]) * self.down[: len(a) - k + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h

    def strips(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window start, end of window starts, anchor hash, whether the anchor is there more than once) of each strip."""
        whole = np.frombuffer(raw, np.uint8)
        starts, hashes, more = [], [], []
        n_windows = len(whole) - self.window + 1
        for at in range(0, max(0, n_windows), _BLOCK):
            a = whole[at : at + _BLOCK + self.window - 1]
            h = self._hashes(a)
            low, width, want = h, 1, self.window - self.anchor + 1
            while width * 2 <= want:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if want > width:
                low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
            change = np.concatenate([[True], low[1:] != low[:-1]])
            cut = np.flatnonzero(change)
            size = np.diff(np.append(cut, len(low)))
            if size.max() > STRIP:
                cut = np.concatenate([np.arange(a, a + n, STRIP) for a, n in zip(cut.tolist(), size.tolist(), strict=True)])
            # The minimum stayed though its first place was left behind: it is there again.
            again = np.concatenate([[False], h[: len(low) - 1] == low[:-1]]) & ~change
            starts.append(cut + at)
            hashes.append(low[cut])
            more.append(np.logical_or.reduceat(again, cut))
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        s = np.concatenate(starts)
        return s, np.append(s[1:], n_windows), np.concatenate(hashes).view(np.int64), np.concatenate(more)


def repeated_anchors(base: DataFrame, window: int) -> DataFrame:
    """(h): anchors of at least two strips. A batch sends an anchor once, whatever the number of its copies."""

    def count(batches):
        find = Anchors(window)
        for batch in batches:
            found = [find.strips(as_bytes(t)) for t in batch.column(0).to_pylist()]
            every = np.concatenate([np.empty(0, np.int64), *(f[2] for f in found), *(f[2][f[3]] for f in found)])
            values, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.minimum(n, 2))], names=["h", "n"])

    return base.select("text").mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _cut_strips(window: int, buckets: int):
    """Rows (doc_id, mark, z, anchors) to packed rows, one for each batch and bucket; equal strips of a batch are one."""

    def run(batches):
        find = Anchors(window)
        for batch in batches:
            ids, marks = (batch.column(k).to_pylist() for k in range(2))
            found: dict[int, dict[tuple[int, bytes], list[int]]] = defaultdict(dict)
            for k, (i, mark) in enumerate(zip(ids, marks, strict=True)):
                raw = unzipped(batch.column(2)[k].as_py())
                start, end, h, _ = find.strips(raw)
                hit = np.flatnonzero(np.isin(h, batch.column(3)[k].values.to_numpy(zero_copy_only=False)))
                null, i = int(i is None), i or 0
                for a, b, x in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist(), strict=True):
                    found[x % buckets].setdefault((x, raw[a : b - 1 + window]), []).extend((i, null, mark, a))
            rows: list[list] = [[], [], [], []]
            for bucket, strips in found.items():
                head = np.array([(h, len(s), len(p) // 4) for (h, s), p in strips.items()], np.int64)
                places = np.array([x for p in strips.values() for x in p], np.int64)
                packed = (bucket, zipped(head.tobytes()), zipped(b"".join(s for _, s in strips)), zipped(places.tobytes()))
                for c, v in zip(rows, packed, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "head", "body", "places"]
            )

    return run


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def sort_shard(rows: list[tuple[int, bytes, int]], window: int, **options) -> list[list[tuple[int, int]]]:
    """Ranges of repeated window starts in each distinct strip (anchor, bytes, occurrences) of a shard."""
    sep = bytes([SEPARATOR])
    text = np.frombuffer(sep.join(s for _, s, _ in rows) + sep, np.uint8)
    hit = repeated_starts(text, window, **options)
    out, at = [], 0
    for _, s, n in rows:
        windows = len(s) - window + 1
        out.append([(0, windows)] if n > 1 else _runs(hit[at : at + windows]))
        at += len(s) + 1
    return out


def sort_bucket(rows: list[tuple[int, bytes, int]], window: int, shard_bytes: int = SHARD_BYTES, **options) -> list[list[tuple[int, int]]]:
    """As ``sort_shard`` for a bucket, shard by shard: strips of different anchors have no window in common."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    ends = np.cumsum([len(rows[i][1]) + 1 for i in order])
    out: list[list[tuple[int, int]]] = [[]] * len(rows)
    at = 0
    while at < len(order):
        cut = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + shard_bytes, "right")))
        while cut < len(order) and rows[order[cut]][0] == rows[order[cut - 1]][0]:
            cut += 1
        shard = order[at:cut]
        for i, found in zip(shard, sort_shard([rows[i] for i in shard], window, **options), strict=True):
            out[i] = found
        at = cut
    return out


def _sort_shards(window: int):
    """Packed rows, by bucket, to (doc_id, mark, ranges), the ranges as one binary of int64 pairs."""

    def flush(packed):
        number: dict[tuple[int, bytes], int] = {}
        who, places = [], []
        for head, body, own in packed:
            head = np.frombuffer(unzipped(head.as_py()), np.int64).reshape(-1, 3)
            body, at, found = unzipped(body.as_py()), 0, []
            for h, n, _ in head.tolist():
                found.append(number.setdefault((h, body[at : at + n]), len(number)))
                at += n
            who.append(np.repeat(np.array(found, np.int64), head[:, 2]))
            places.append(np.frombuffer(unzipped(own.as_py()), np.int64).reshape(-1, 4))
        owner, places = np.concatenate(who), np.concatenate(places)
        times = np.bincount(owner, minlength=len(number))
        ranges = sort_bucket([(h, s, int(n)) for (h, s), n in zip(number, times, strict=True)], window)
        del number
        have = np.array([len(r) for r in ranges])
        flat = np.array([x for r in ranges for x in r], np.int64).reshape(-1, 2)
        first = np.cumsum(have) - have
        n = have[owner]
        row = np.repeat(np.arange(len(owner)), n)
        pick = np.repeat(first[owner], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a = places[row, 3] + flat[pick, 0]
        b = places[row, 3] + flat[pick, 1] - 1 + window
        order = np.lexsort((a, places[row, 2], places[row, 0], places[row, 1]))
        keys, a, b = places[row[order], :3], a[order], b[order]
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.empty(0, np.int64)
        for at in range(0, len(cuts), 20_000):
            part = cuts[at : at + 20_000]
            ends = np.append(cuts[at + 1 : at + 20_000 + 1], len(keys))[: len(part)]
            blobs = [_pairs(a[x:y], b[x:y]) for x, y in zip(part.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part, 0], pa.int64(), mask=keys[part, 1] == 1), pa.array(keys[part, 2], pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "mark", "ranges"],
            )

    def run(batches):
        bucket, packed = None, []
        for batch in batches:
            for b, *row in zip(*batch.columns, strict=True):
                if packed and b.as_py() != bucket:
                    yield from flush(packed)
                    packed = []
                bucket = b.as_py()
                packed.append(row)
        if packed:
            yield from flush(packed)

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> bytes:
    """Merged ranges (a ascending) as int64 pairs."""
    top = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > top[:-1]])
    ends = np.append(np.flatnonzero(new)[1:], len(a)) - 1
    return np.stack([a[new], top[ends]], axis=1).tobytes()


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, ranges): byte ranges of repeated windows, as binaries of int64 pairs to be merged, for each
    document that has any; mark is the text's hash. Rows that repeat id and text are taken as two documents."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where("text is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def make():
        find = Anchors(window)
        return lambda texts: [[find.strips(as_bytes(t))[2] for t in texts]]

    anchors = map_text(base, make, [T.StructField("anchors", T.ArrayType(T.LongType()))], keep=["doc_id", "mark"])
    # Stored first, so that the join has a shuffle on either side: only then can Spark split the partition of an
    # anchor that is everywhere.
    known = materialize(repeated_anchors(base, window), "anchors")
    again = anchors.select(F.explode("anchors").alias("h"), "doc_id", "mark").join(known.hint("merge"), "h")
    hit = again.groupBy("doc_id", "mark").agg(F.collect_set("h").alias("anchors")).select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "anchors")
    texts = shrunk(base, ["doc_id", "mark"])
    met = texts.join(hit, texts["doc_id"].eqNullSafe(hit["i"]) & (texts["mark"] == hit["m"])).select("doc_id", "mark", "z", "anchors")
    buckets = max(parts, known.count() // ANCHORS_PER_BUCKET)
    cut = met.mapInArrow(lean(_cut_strips(window, buckets)), "bucket long, head binary, body binary, places binary")
    shards = cut.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    ranges = shards.mapInArrow(lean(_sort_shards(window)), "doc_id long, mark long, ranges binary")
    return ranges.groupBy("doc_id", "mark").agg(F.collect_list("ranges").alias("ranges"))


def _spans(blobs: list[bytes] | None) -> list[tuple[int, int]]:
    if not blobs:
        return []
    pairs = np.concatenate([np.frombuffer(x, np.int64) for x in blobs]).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return [tuple(x) for x in np.frombuffer(_pairs(pairs[:, 0], pairs[:, 1]), np.int64).reshape(-1, 2).tolist()]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, str]:
    """``docs`` without its text, plus a struct column: n_bytes, n_removed, n_spans, the merged spans and the bytes
    kept; and that column's name.

    Null and empty texts have no bytes; texts shorter than the window keep all; rows that repeat id and text
    are documents of their own, so that all of theirs from 200 bytes on goes; other columns pass through.
    """
    found = materialize(repeated_ranges(docs, window), "ranges")
    i, m, r, mark, z = (free_name(docs, x) for x in ("range_id", "range_mark", "range_list", "mark", "z"))
    found = found.select(F.col("doc_id").alias(i), F.col("mark").alias(m), F.col("ranges").alias(r))
    others = [c for c in docs.columns if c != "text"]
    marked = docs.withColumn(mark, F.xxhash64("text"))
    small = shrunk(marked, [*others, mark], z)
    joined = small.join(found, small["doc_id"].eqNullSafe(found[i]) & (small[mark] == found[m]), "left").select(*others, z, r)
    name = free_name(docs, "dedup")
    kind = T.StructType(
        [*(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())]
    )
    struct = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(name, kind)])
    n = len(others)

    def run(batches):
        for batch in batches:
            out = []
            for packed, blobs in zip(batch.column(n), batch.column(n + 1).to_pylist(), strict=True):
                raw, spans = unzipped(packed.as_py()), _spans(blobs)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                flat = [x for s in spans for x in s]
                out.append({"n_bytes": len(raw), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "spans": flat, "kept": b"".join(kept)})
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, struct)], names=[*others, name])

    return joined.mapInArrow(lean(run), schema), name


def repeats_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    out, name = remove_repeats(docs.select("doc_id", "text"), window)
    return out.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", f"{name}.n_spans", F.sha2(f"{name}.kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int) -> list[tuple[int, int, int, str]]:
    """What the digest must hold, from a table of all windows; for tests."""
    raw = [as_bytes(t) for t in texts]
    seen: dict[bytes, int] = defaultdict(int)
    for b in raw:
        for k in range(len(b) - window + 1):
            seen[b[k : k + window]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out

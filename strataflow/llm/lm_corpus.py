"""Cross-entropy difference scoring whose counts are tables over all documents.

The vocabulary is every word of the documents and the bigrams are all of theirs; nothing is listed, capped or held
in one place. The models are those of ``lm_score``, discounted bigrams over unigrams,
    p(w | h) = max(c(h, w) - D, 0) / c(h) + left(h) * p(w),
with p(w) = c(w) / N for the background, which saw every word, and p(w) = (c(w) + T * background(w)) / (N + T) for the
target, where T is its number of different words, so that a word it never saw costs it log2((N + T) / T) bits more.
The target is every document labelled as good.

Documents are dealt into batches of ids of their own words; the labels are joined to the ids of the documents in the
batches, so that no text is shuffled and no list of labelled ids is held in one place. A batch asks the buckets of a
hash for the totals of its different bigrams, and then of its words; a bucket adds up what all batches sent for a key
and answers each of them. A key is sent once by each batch, however often it occurs, so no bucket is long because of a
common word. Words and bigrams are 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, unzipped, zipped
from .lm_score import DISCOUNT, target_rows, words_of

#: Bytes of text in a batch; bounds a worker's memory, not what is counted.
BATCH_BYTES = 8_000_000
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_BATCHES = "batch long, doc_ids array<long>, counts array<long>, words binary, ids binary"
_ASKED = "bucket int, batch long, keys binary, sums array<binary>"
_TOLD = "bucket int, batch long, sums array<binary>, own binary, n_own long, n_target long"


def _pack(a: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes, byte planes apart."""
    a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    return bytes([a.itemsize]) + zipped(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    n = raw[0]
    return np.frombuffer(np.frombuffer(unzipped(raw[1:]), np.uint8).reshape(n, -1).T.tobytes(), f"<u{n}")


def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little") or 1


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _deal(docs: DataFrame, batch_bytes: int) -> DataFrame:
    def run(batches):
        task, number = TaskContext.get().partitionId(), count()

        def flush():
            words = np.array([0, *map(_hash, known)], np.uint64)  # 0 stands before a text
            return _rows([(task << 32 | next(number), names, [len(x) for x in held], _pack(words), _pack(np.concatenate(held)))], _BATCHES)

        names, held, size, known = [], [], 0, defaultdict(count(1).__next__)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                names.append(i)
                held.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                size += len(text or "") + 50
                if size >= batch_bytes:
                    yield flush()
                    names, held, size, known = [], [], 0, defaultdict(count(1).__next__)
        if names:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _BATCHES)


def _target(dealt: DataFrame, labels: DataFrame) -> DataFrame:
    """For each batch that holds any: the places of its target documents and the number of their tokens."""
    rows = dealt.select("batch", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("place", "of"))
    rows = rows.select("batch", "place", F.col("of.doc_ids").alias("doc_id"), F.col("of.counts").alias("n")).where("doc_id is not null")
    held = rows.join(target_rows(labels), "doc_id", "left_semi").groupBy("batch")
    return materialize(held.agg(F.collect_list("place").alias("target"), F.sum("n").alias("n")), "lm-target")


class _Batch:
    """The tokens of a batch and its different bigrams: ``keys`` (ascending), ``place`` of each token's among them."""

    def __init__(self, row: dict):
        self.doc_ids, self.lengths = row["doc_ids"], np.array(row["counts"], np.int64)
        self.words, self.ids = _unpack(row["words"]).astype(np.uint64), _unpack(row["ids"]).astype(np.int64)
        before = np.concatenate([[0], self.ids[:-1]])[: len(self.ids)]
        starts = np.cumsum(self.lengths) - self.lengths
        before[starts[self.lengths > 0]] = 0
        good = np.zeros(len(self.lengths), bool)
        good[row.get("target") or []] = True
        self.good = np.repeat(good, self.lengths)
        keys, at, self.place = np.unique(self.words[before] * _TIMES + self.words[self.ids], return_index=True, return_inverse=True)
        self.keys, self.head, self.word, self.before = keys, before[at], self.ids[at], before

    def bigrams(self) -> list[np.ndarray]:
        return [np.bincount(self.place, minlength=len(self.keys)), np.bincount(self.place[self.good], minlength=len(self.keys))]


def _ask(batch: int, keys: np.ndarray, sums: list[np.ndarray], buckets: int) -> list[tuple]:
    """One row for each bucket with keys of the batch; ``keys`` ascend, and so do their buckets."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(of, np.arange(buckets + 1))
    return [(b, batch, _pack(np.diff(keys[x:y], prepend=np.uint64(0))), [_pack(s[x:y]) for s in sums]) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]


def _tell(asked: DataFrame, name: str) -> DataFrame:
    """For each row asked: the sums of its keys over all batches, which keys are counted as this batch's own (each key
    is that of one batch), and the number of those, all and with a second sum."""

    def run(table):
        rows = table.to_pylist()
        keys = [np.cumsum(_unpack(r["keys"]), dtype=np.uint64) for r in rows]
        every, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = [np.bincount(place, np.concatenate([_unpack(r["sums"][k]) for r in rows]), len(every)).astype(np.uint64) for k in range(len(rows[0]["sums"]))]
        own = np.zeros(len(place), bool)
        own[first] = True
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            here, mine = place[at : at + len(k)], own[at : at + len(k)]
            out.append((r["bucket"], r["batch"], [_pack(s[here]) for s in sums], _pack(mine.view(np.uint8)), int(mine.sum()), int((sums[1][here[mine]] > 0).sum())))
            at += len(k)
        return pa.Table.from_batches([_rows(out, _TOLD)])

    return materialize(asked.groupBy("bucket").applyInArrow(run, _TOLD), name)


def _told(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    if not rows:
        return [], np.empty(0, bool)
    return [np.concatenate([_unpack(r["sums"][k]) for r in rows]).astype(np.float64) for k in range(len(rows[0]["sums"]))], np.concatenate([_unpack(r["own"]) for r in rows]).astype(bool)


def corpus_digest(docs: DataFrame, labels: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_tokens and the means target_bits, background_bits, difference, rounded to 9 digits.

    Every row of ``docs`` is counted and scored; null and empty texts have no tokens and null means. With no labelled
    document the target knows the background's unigrams only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(_deal(docs, batch_bytes), "lm-batches")
    target = _target(dealt, labels)
    marked = dealt.join(target.select("batch", "target").hint("shuffle_hash"), "batch", "left")

    def ask_bigrams(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Batch(row)
                yield _rows(_ask(row["batch"], b.keys, b.bigrams(), buckets), _ASKED)

    bigrams = _tell(marked.mapInArrow(ask_bigrams, _ASKED), "lm-bigrams")

    def ask_words(left, right):
        row = left.to_pylist()[0]
        b, (sums, own) = _Batch(row), _told(right)
        n, order = len(b.words), np.argsort(b.words)
        types = (own, own & (sums[1] > 0)) if sums else (own, own)
        columns = [np.bincount(b.ids, minlength=n), np.bincount(b.ids[b.good], minlength=n), np.bincount(b.before, minlength=n), np.bincount(b.before[b.good], minlength=n)]
        columns += [np.bincount(b.head[t], minlength=n) for t in types]
        return pa.Table.from_batches([_rows(_ask(row["batch"], b.words[order], [c[order] for c in columns], buckets), _ASKED)])

    words = _tell(marked.groupBy("batch").cogroup(bigrams.groupBy("batch")).applyInArrow(ask_words, _ASKED), "lm-words")
    n_all = dealt.select(F.explode("counts").alias("n")).agg(F.sum("n")).first()[0] or 0
    n_good = target.agg(F.sum("n")).first()[0] or 0
    n_types = words.agg(F.sum("n_target")).first()[0] or 0  # the mark before a text is no word and has no word count
    schema = "doc_id long, n_tokens long, target_bits double, background_bits double, difference double"

    def score(left, right):
        b = _Batch(left.to_pylist()[0])
        kind = right.column("of_words")
        (one, good, head, good_head, types, good_types), _ = _told(right.filter(kind))
        order = np.argsort(b.words)
        one, good, head, good_head, types, good_types = (x[np.argsort(order)] for x in (one, good, head, good_head, types, good_types))
        sums, _ = _told(right.filter(pa.compute.invert(kind)))
        means = [np.full(len(b.lengths), np.nan)] * 2
        if sums:
            plain = one / n_all
            fitted = (good + n_types * plain) / (n_good + n_types) if n_good else plain
            doc = np.repeat(np.arange(len(b.lengths)), b.lengths)
            means = []
            for c, h, t, p in ((sums[1], good_head, good_types, fitted), (sums[0], head, types, plain)):
                under = np.maximum(h, 1)[b.head]
                loss = -np.log2(np.maximum(c - DISCOUNT, 0) / under + np.where(h > 0, DISCOUNT * t / np.maximum(h, 1), 1.0)[b.head] * p[b.word])
                means.append(np.bincount(doc, loss[b.place], len(b.lengths)) / np.maximum(b.lengths, 1))
        none = b.lengths == 0
        values = [pa.array(x, mask=none) for x in (*means, means[0] - means[1])]
        return pa.table([pa.array(b.doc_ids, pa.int64()), pa.array(b.lengths), *values], names=[f.split()[0] for f in schema.split(", ")])

    answers = bigrams.withColumn("of_words", F.lit(False)).unionByName(words.withColumn("of_words", F.lit(True)))
    scored = materialize(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema), "lm-scores")
    for stored in (dealt, target, bigrams, words):
        discard(stored)
    return scored.select("doc_id", "n_tokens", *(F.round(n, 9).alias(n) for n in ("target_bits", "background_bits", "difference")))

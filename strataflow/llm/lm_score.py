"""Cross-entropy difference scoring with matched n-gram models.

The target model is trained on the documents labelled as good, the background model on all documents.
They are matched: one vocabulary (words of at least two target occurrences; all others are one
unknown word) and one list of bigrams (those of the target text), so that a token's loss differs only by
what the counts say. Both are interpolated with absolute discounting,
    p(w | h) = max(c(h, w) - D, 0) / c(h) + left(h) * p(w),   p(w) = (c(w) + 1) / (N + V),
where left(h) is the mass that the discounted listed bigrams of h leave over; the mass is 1 for each h.
A document's score is the mean over its tokens of target loss minus background loss in bits: the
lower, the more it is like the target.

Every document labelled as good is fitted. Words, bigrams and counts are taken by tasks and summed by a shuffle; the
lists of different words and bigrams of the target are held by the driver and by each task, and grow with the labelled
text. A bigram outside them has no count here: the query scores by ``lm_corpus``, whose counts are tables over the
whole corpus and are held in no one place.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, map_text, materialize, small_batches

DISCOUNT = 0.75
_START, _UNKNOWN = 0, 1


def words_of(text: str | None) -> list[bytes]:
    """White-space words after lower-casing A-Z."""
    return text.encode().lower().split() if text else []


class Lists:
    """The shared vocabulary and bigram list."""

    def __init__(self, words: list[bytes], bigrams: np.ndarray):
        self.id = {w: i for i, w in enumerate(words, 2)}
        self.size = len(words) + 2
        self.bigrams = bigrams  # sorted codes: history * size + word

    def ids(self, text: str | None) -> np.ndarray:
        get = self.id.get
        return np.array([get(w, _UNKNOWN) for w in words_of(text)], np.int64)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[_START], ids[:-1]]) * self.size + ids if len(ids) else ids

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code in the list, or -1."""
        if not len(self.bigrams):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.bigrams, codes), len(self.bigrams) - 1)
        return np.where(self.bigrams[at] == codes, at, -1)


class Model:
    """Log2 probabilities under one set of counts over shared lists."""

    def __init__(self, lists: Lists, word: np.ndarray, history: np.ndarray, bigram: np.ndarray, discount: float = DISCOUNT):
        v = lists.size - 1  # every word but the start mark
        unigram = (word + 1.0) / (word[1:].sum() + v)
        own = lists.bigrams // lists.size if len(lists.bigrams) else np.empty(0, np.int64)
        taken = np.maximum(bigram - discount, 0.0) / np.maximum(history[own], 1)
        left = 1.0 - np.bincount(own, taken, lists.size)
        self.lists, self.unigram, self.left = lists, unigram, np.maximum(left, 1e-12)
        self.listed = np.log2(taken + self.left[own] * unigram[lists.bigrams % lists.size]) if len(own) else taken
        self.log_left, self.log_unigram = np.log2(self.left), np.log2(unigram)

    def losses(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        before = np.concatenate([[_START], ids[:-1]])
        out = -(self.log_left[before] + self.log_unigram[ids])
        hit = places >= 0
        out[hit] = -self.listed[places[hit]]
        return out


def choose_lists(target: list[str | None]) -> Lists:
    count: Counter = Counter()
    for text in target:
        count.update(words_of(text))
    words = sorted(w for w, n in count.items() if n > 1)
    lists = Lists(words, np.empty(0, np.int64))
    codes = [lists.codes(lists.ids(t)) for t in target]
    return Lists(words, np.unique(np.concatenate([*codes, np.empty(0, np.int64)])))


def count_text(lists: Lists, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, history, bigram) counts of some texts."""
    word, history, bigram = np.zeros(lists.size, np.int64), np.zeros(lists.size, np.int64), np.zeros(len(lists.bigrams), np.int64)
    parts = [lists.ids(t) for t in texts]
    parts = [p for p in parts if len(p)]
    if parts:
        every = np.concatenate(parts)
        word += np.bincount(every, minlength=lists.size)
        codes = np.concatenate([lists.codes(p) for p in parts])
        history += np.bincount(codes // lists.size, minlength=lists.size)
        places = lists.places(codes)
        bigram += np.bincount(places[places >= 0], minlength=len(lists.bigrams))
    return word, history, bigram


def target_rows(labels: DataFrame) -> DataFrame:
    """``doc_id`` of every document labelled as good, once each."""
    good = labels.where("doc_id is not null and quality = 1").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return good.where("toxic = 0").select("doc_id")


def target_ids(labels: DataFrame) -> list[int]:
    """Those ids as a list, for small tables; the models are fitted by joins with ``target_rows``."""
    return sorted(r.doc_id for r in target_rows(labels).collect())


def target_texts(docs: DataFrame, labels: DataFrame) -> list[str | None]:
    """Their texts as a list, for small tables."""
    rows = docs.join(target_rows(labels), "doc_id", "left_semi").select("doc_id", "text").collect()
    return [r.text for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""))]


def gather_lists(target: DataFrame) -> Lists:
    """``choose_lists`` of all rows of ``target``, counted by tasks; only the lists come to the driver."""
    spark = target.sparkSession
    small_batches(spark)

    def count_words(batches):
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0).to_pylist():
                count.update(words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    counted = target.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = sorted(counted.where("n > 1").select("word").toArrow().column(0).to_pylist())
    sent = spark.sparkContext.broadcast(Lists(words, np.empty(0, np.int64)))

    def list_bigrams(batches):
        known = sent.value
        for batch in batches:
            codes = [known.codes(known.ids(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*codes, np.empty(0, np.int64)])))], names=["code"])

    codes = target.select("text").mapInArrow(list_bigrams, "code long").distinct().toArrow().column(0).to_numpy()
    return Lists(words, np.sort(codes.astype(np.int64)))


def corpus_counts(docs: DataFrame, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts over every document. Tasks send what they saw as (entry, count) rows; the sums have one row
    for each entry of the lists."""
    sent = docs.sparkSession.sparkContext.broadcast(lists)

    def run(batches):
        known, total = sent.value, None
        for batch in batches:
            got = count_text(known, batch.column(0).to_pylist())
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            every = np.concatenate(total)
            seen = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(every[seen])], names=["entry", "n"])

    small_batches(docs.sparkSession)
    summed = docs.select("text").mapInArrow(run, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    stored = materialize(summed, "ngram-counts")
    out = np.zeros(2 * lists.size + len(lists.bigrams), np.int64)
    got = stored.toPandas()  # one row for each listed word, history and bigram at most
    out[got["entry"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    discard(stored)
    return out[: lists.size], out[lists.size : 2 * lists.size], out[2 * lists.size :]


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, Model]:
    """(target, background); with no labelled document both know nothing but the unknown word and score 0."""
    target = materialize(docs.join(target_rows(labels), "doc_id", "left_semi").select("text"), "ngram-target")
    lists = gather_lists(target)
    fitted = Model(lists, *corpus_counts(target, lists))
    discard(target)
    return fitted, Model(lists, *corpus_counts(docs, lists))


def score_documents(docs: DataFrame, target: Model, background: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus a struct column ``lm`` (or another free name): n_tokens, target_bits, background_bits, difference.

    Bits are means per token. Null and empty texts have no tokens and null means; rows and other columns stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast((target, background))
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("target_bits", "background_bits", "difference"))])

    def make():
        t, b = sent.value
        b.lists = t.lists

        def work(texts):
            out = []
            for text in texts:
                ids = t.lists.ids(text)
                if not len(ids):
                    out.append({"n_tokens": 0, "target_bits": None, "background_bits": None, "difference": None})
                    continue
                places = t.lists.places(t.lists.codes(ids))
                x, y = t.losses(ids, places), b.losses(ids, places)
                out.append({"n_tokens": len(ids), "target_bits": float(x.mean()), "background_bits": float(y.mean()), "difference": float((x - y).mean())})
            return [out]

        return work

    return map_text(docs, make, [T.StructField(free_name(docs, "lm"), kind)], keep=keep)


def lm_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the three means, rounded to 9 digits."""
    target, background = train(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), target, background, keep=["doc_id"])
    return scored.select("doc_id", "lm.n_tokens", *(F.round(f"lm.{n}", 9).alias(n) for n in ("target_bits", "background_bits", "difference")))


def entropy(model: Model) -> float:
    """Total probability that the model gives to all words after the start mark; 1 up to rounding."""
    lists = model.lists
    ids = np.arange(1, lists.size)
    places = lists.places(_START * lists.size + ids)
    loss = np.where(places >= 0, -model.listed[np.maximum(places, 0)] if len(model.listed) else 0.0, -(model.log_left[_START] + model.log_unigram[ids]))
    return math.fsum(np.exp2(-loss))

"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ten consecutive item words (an item of fewer words is one shorter
pattern). The symbols are words, not bytes: a block is two words, so that blocks of ordinary text
hardly ever occur in a pattern and the shift table skips almost a whole window at a time, however
many patterns there are. Patterns are searched per length, since the shortest one bounds the shift.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, map_text, materialize

WINDOW = 10
#: Benchmark words searched in one pass: bounds what is broadcast. A larger benchmark takes more passes.
WORDS_PER_PASS = 1_000_000

_WORD = [c for c in range(256) if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80]
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _WORD or 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null has none."""
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Patterns of one length over integer symbols; 0 is any symbol outside the vocabulary."""

    def __init__(self, patterns: dict[tuple[int, ...], set], length: int, base: int):
        self.m, self.base = length, base
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[int, ...], set]]] = defaultdict(list)
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[self._key(pattern, length)].append((pattern, owners))

    def _key(self, symbols, end: int) -> int:
        return symbols[end - 2] * self.base + symbols[end - 1] if self.block == 2 else symbols[end - 1]

    def search(self, ids: list[int]) -> Iterable[tuple[int, set]]:
        """(start, owners) of each occurrence, by ascending start."""
        m, base, default, shift = self.m, self.base, self.default, self.shift.get
        pair, end, n = self.block == 2, self.m, len(ids)
        while end <= n:
            key = ids[end - 2] * base + ids[end - 1] if pair else ids[end - 1]
            skip = shift(key, default)
            if skip:
                end += skip
                continue
            start = end - m
            first = ids[start]
            for pattern, owners in self.buckets.get(key, ()):
                if pattern[0] == first and tuple(ids[start:end]) == pattern:
                    yield start, owners
            end += 1


class Matcher:
    """All windows of some benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            m = min(WINDOW, len(ids))
            for at in range(len(ids) - m + 1 if ids else 0):
                owners = by_length[m][tuple(ids[at : at + m])]
                if item is not None:
                    owners.add(str(item))
        base = len(self.vocabulary) + 1
        self.parts = [WuManber(patterns, m, base) for m, patterns in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged runs of hit word positions, items found)."""
        if not self.parts or not words:
            return [], set()
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        runs, items = [], set()
        for part in self.parts:
            for start, owners in part.search(ids):
                runs.append((start, start + part.m))
                items |= owners
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.LongType())),  # start, end, start, end, ...
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def find_contamination(docs: DataFrame, benchmark: DataFrame, name: str, words_per_pass: int = WORDS_PER_PASS, keep: list[str] | None = None, without_id: bool = False) -> DataFrame:
    """``docs`` plus the struct ``name``: n_words, merged hit runs and the items found.

    The benchmark's size is checked first. Up to ``words_per_pass`` its items go to every task; a
    larger one is split by a hash of id and text and its parts are searched one after the other,
    each adding to the columns of the pass before. Items without words have no windows, nor have those
    without id unless ``without_id``: their windows give runs, and no item. Repeated items count once; null texts
    have no words.
    """
    items = benchmark.where("text is not null" if without_id else "item_id is not null and text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-int(chars) // (4 * words_per_pass)) or 1
    spark, frame, stored = docs.sparkSession, docs, None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])

        def make(sent=sent):
            matcher = Matcher(sent.value)

            def work(texts):
                out = []
                for t in texts:
                    words = words_of(t)
                    runs, found = matcher.hits(words)
                    out.append({"n_words": len(words), "runs": [x for r in runs for x in r], "items": sorted(found)})
                return [out]

            return work

        new = name if k == 0 else free_name(frame, f"{name}_{k}")
        last = k == passes - 1
        frame = map_text(frame, make, [T.StructField(new, _FOUND)], keep=frame.columns if not last or keep is None else [*keep, *([name] if k else [])])
        if k:
            joined = F.struct(
                F.col(f"{name}.n_words").alias("n_words"),
                F.concat(f"{name}.runs", f"{new}.runs").alias("runs"),
                F.array_distinct(F.concat(f"{name}.items", f"{new}.items")).alias("items"),
            )
            frame = frame.withColumn(name, joined).drop(new)
        if not last:
            before, frame = stored, materialize(frame, "decontam")
            stored = frame
            if before is not None:
                discard(before)
    return frame


def n_hit(runs: list[int]) -> int:
    return sum(b - a for a, b in merged(list(zip(runs[::2], runs[1::2], strict=True))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words_per_pass: int = WORDS_PER_PASS, without_id: bool = False) -> DataFrame:
    """The documents without any benchmark window, with their own columns; those of items without id count if asked for."""
    name = free_name(docs, "contamination")
    return find_contamination(docs, benchmark, name, words_per_pass, without_id=without_id).where(F.size(f"{name}.runs") == 0).select(*docs.columns)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark, "found", words_per_pass, keep=["doc_id"])

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(1).to_pylist()
            hit = [n_hit(r["runs"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r["n_words"] for r in rows], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(r["items"]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = T.StructType(
        [
            found.schema["doc_id"],
            *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
        ]
    )
    return found.mapInArrow(digest, kind)


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)
), x AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m FROM d, (SELECT DISTINCT m FROM p)), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)
), h AS (SELECT x.doc_id, x.i, x.m, p.item FROM x JOIN p ON x.m = p.m AND x.g = p.g),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       coalesce(t.s, sha256('')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

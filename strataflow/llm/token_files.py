"""Token-id files: texts encoded by the tokenizers library, Re-Pair compressed in blocks, in ascending document order.

A shard is one range of document ids. Its blocks hold whole documents; a row of the file table is one block: shard, block,
the number of ids before it in the shard, the documents with their number of ids, and the grammar. Parquet carries
the rows, so that files are committed and read by Spark wherever the shared folder is.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches
from .repair import Grammar, compress
from .wordcache import BATCH_CHARS, IdCache, runs, spans

END_ID = 2
#: A grammar covers so many ids of a shard, which bounds the memory of writing and the work of reading one document.
BLOCK_IDS = 1 << 20
CACHED_WORDS = 400_000
WORDS_AT_ONCE = 500
#: Bytes of texts in batches of rows that are worked off together, so that a word is looked up few times in a task.
SPAN_BYTES = 10_000_000
FILE_SCHEMA = "shard int, block int, start long, doc_ids array<long>, counts array<long>, grammar binary"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# A mark right behind a letter or digit is a token of its own to the splitting pattern (an apostrophe may not be). Only letters
# that are letters in every version of Unicode; marks behind others stay with their word.
_BEFORE_MARK = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-`{-~])"
_SPACE = re.compile(" ")
# Words of these letters only, with spaces between them, are what the normalizer below makes of them, and each is one piece of
# the splitting pattern below: lower-case letters that are composed and, side by side, compose with nothing.
_PLAIN = re.compile("[a-zß-öø-ÿ ]*")
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def _plain_tokenizer(definition: dict):
    """The library's tokenizer for text that ``_PLAIN`` matches: the same vocabulary, merges and byte letters, split at spaces and not
    normalized. None if the definition is not the one of which that is known."""
    from tokenizers import Tokenizer

    normalizer, split = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [])
    if normalizer.get("normalizers") != _NORMALIZER or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    pieces, letters = steps
    if (pieces["pattern"], pieces["behavior"], pieces["invert"]) != (_PIECES, "Removed", True) or letters["use_regex"] or letters["add_prefix_space"]:
        return None
    plain = {"normalizer": None, "pre_tokenizer": split | {"pretokenizers": [{"type": "WhitespaceSplit"}, letters]}}
    return Tokenizer.from_str(json.dumps(definition | plain))


class WordCache:
    """Library encodings of words between spaces and line ends, which no token of this kind of vocabulary spans.

    Only for tokenizers that split at white space, lower-case, and end each word with a marked token;
    ``check`` says so from their definition and a probe, and whole texts are encoded otherwise. Texts are lower-cased first where
    that cannot change a token (composed text without letters of unusual lower case), and marks behind a letter or digit become
    words of their own, so that fewer words are new. New words of letters are encoded many at a time, with spaces between them, and
    without the normalizer and the splitting pattern where neither can change them. The number of words kept is bounded.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.tokenizer = _tokenizer(path)
        definition = json.loads(self.tokenizer.to_str())
        vocabulary, suffix = self.tokenizer.get_vocab(), definition["model"].get("end_of_word_suffix")
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.cache = IdCache(self._learn, self.kind, cached)
        self.by_word = self.check(definition)
        self.plain = _plain_tokenizer(definition) if self.by_word else None

    def check(self, definition: dict) -> bool:
        steps = definition.get("normalizer") or {}
        steps = [s["type"] for s in steps.get("normalizers", [steps]) if s]
        if not self.ends.any() or not set(steps) <= {"NFC", "Replace", "Lowercase"} or "Lowercase" not in steps:
            return False
        probe = "Ab cd\nef  Gh. x\t'S 12\n\né Ü, end."
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return whole == [i for w in _prepared(probe).split(" ") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def _learn(self, missing: list[str]) -> list[bytes]:
        new: dict[str, bytes] = {}
        letters = [w for w in missing if w.isalpha()]
        other = [w for w in missing if not w.isalpha()]
        for at in range(0, len(letters), WORDS_AT_ONCE):
            self._learn_letters(letters[at : at + WORDS_AT_ONCE], new, other)
        for at in range(0, len(other), WORDS_AT_ONCE):
            some = other[at : at + WORDS_AT_ONCE]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                new[w] = np.array(e.ids, self.kind).tobytes()
        return [new[w] for w in missing]

    def _learn_letters(self, words: list[str], new: dict[str, bytes], other: list[str]) -> None:
        """Words of letters in one encoding, cut behind the tokens that end a word; one by one if their number differs."""
        joined = " ".join(words)
        tokenizer = self.plain if self.plain and _PLAIN.fullmatch(joined) else self.tokenizer
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            other += words
            return
        held, stops = ids.tobytes(), (stops * ids.itemsize).tolist()
        for w, a, b in zip(words, [0, *stops], stops, strict=False):
            new[w] = held[a:b]

    def encode_many(self, texts: list[str | None], chars: int = BATCH_CHARS) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, self.kind) for t in texts]
        out = []
        for at, cut in spans(texts, chars):
            whole = [_prepared(t) if t else "" for t in texts[at:cut]]
            if cut == at + 1:
                out.append(np.concatenate([self._ids(run)[0] for run in runs(whole[0], chars, _SPACE)]))
                continue
            ids, stops = self._ids(*whole)
            out += [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _ids(self, *parts: str) -> tuple[np.ndarray, list[int]]:
        apart = pa.array([p if "<|" not in p else None for p in parts], pa.large_string())
        apart = pc.replace_substring_regex(apart, pattern=_BEFORE_MARK, replacement=r"\1 \2")
        if apart.null_count:  # what may hold a special token stays as it is
            apart = pc.coalesce(apart, pa.array(parts, pa.large_string()))
        split = pc.split_pattern(apart, " ")
        ids, ends = self.cache.ids(split.flatten())
        return ids, np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy())].tolist()


def _prepared(text: str) -> str:
    """The text with spaces for line ends, lower-cased where that is safe."""
    if unicodedata.is_normalized("NFC", text) and len(low := text.lower()) == len(text) and "Σ" not in text and "<|" not in text:
        text = low
    return text.replace("\n", " ")


@lru_cache(maxsize=2)
def _words(path: str) -> WordCache:
    """One cache for all tasks of a worker process."""
    return WordCache(path)


def _row_spans(batches, size: int = SPAN_BYTES):
    """(doc_ids, texts, characters to encode at once): as many batches together as have up to ``size`` bytes of texts, all at once,
    or one larger batch."""
    names, texts, held = [], [], 0
    for batch in batches:
        new = batch.column(1).nbytes
        if names and held + new > size:
            yield names, texts, size if held <= size else BATCH_CHARS
            names, texts, held = [], [], 0
        names += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        held += new
    if names:
        yield names, texts, size if held <= size else BATCH_CHARS


def _write_blocks(path: str, end_id: int, block_ids: int):
    """Sorted (doc_id, text) to the blocks of the task's shard."""

    def run(batches):
        cache, shard = _words(path), TaskContext.get().partitionId()
        ids, held, counts, size, block, start = [], [], [], 0, 0, 0

        def flush():
            grammar = compress(np.concatenate(held).astype(np.int64)).dumps()
            columns = ([shard], pa.int32()), ([block], pa.int32()), ([start], pa.int64()), ([ids], pa.list_(pa.int64())), ([counts], pa.list_(pa.int64())), ([grammar], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["shard", "block", "start", "doc_ids", "counts", "grammar"])

        for names, texts, chars in _row_spans(batches):
            for i, found in zip(names, cache.encode_many(texts, chars), strict=True):
                ids.append(i)
                held += (found, np.array([end_id], found.dtype))
                counts.append(len(found) + 1)
                size += len(found) + 1
                if size >= block_ids:
                    yield flush()
                    start += size
                    ids, held, counts, size, block = [], [], [], 0, block + 1
        if ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The file table, written to the shared folder. Null texts are empty and have only the end id; every row is
    written; null ids come first; extra columns are left out; an empty table has no blocks."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(lean(_write_blocks(path, end_id, block_ids)), FILE_SCHEMA), "token-files")


def _read(files: DataFrame, columns: Callable[[list[bytes]], list[pa.Array]], schema: str) -> DataFrame:
    """(doc_id, start, ...): what ``columns`` makes of the little-endian ids of each document. Only one total for
    each shard goes to the driver."""
    totals = {r.shard: r.n for r in files.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard] = at
        at += totals[shard]
    names = ["doc_id", "start", *(part.split()[0] for part in schema.split(","))]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Grammar.loads(row["grammar"]).decode()
                ends = np.cumsum(row["counts"])
                starts = ends - np.array(row["counts"]) + row["start"] + before[row["shard"]]
                raw, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), *columns(parts)], names=names)

    return files.mapInArrow(lean(run), f"doc_id long, start long, {schema}")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids): decoded documents with the number of ids in all documents before each."""
    return _read(files, lambda parts: [pa.array(parts, pa.binary())], "ids binary")


def read_range(files: DataFrame, shard: int, block: int, start: int, stop: int) -> list[int]:
    """Random access: ids start..stop of one block, without decoding the rest of it."""
    row = files.where((F.col("shard") == shard) & (F.col("block") == block)).select("grammar").first()
    return Grammar.loads(row.grammar).decode(start, stop).tolist() if row else []


def token_files_digest(docs: DataFrame, path: str) -> DataFrame:
    """What the files hold for each document: start, n_tokens, ids_crc32."""
    make = lambda parts: [pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
    return _read(write_token_files(docs, path), make, "n_tokens long, ids_crc32 long")

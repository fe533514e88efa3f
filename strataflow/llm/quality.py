"""Quality rules with risk-controlled cutoffs.

Each rule is one score per document, larger meaning worse. Labelled texts are split by a hash of the text, so that copies are
one draw. The fitting half proposes, per stratum and rule, the cutoff that separates rejected from accepted labels best, and
orders the rules by what they gain; a rule that gains next to nothing beyond those before it is left out. The holdout half certifies them in that order: the rules so far, together, are admissible
if an exact binomial test shows that they reject at most ``alpha`` of good documents at level ``delta / strata``. The
sequence is fixed before the holdout is seen and ends at the first failure, so that no further correction is due over rules;
the Bonferroni division covers strata. So at most ``alpha`` of a stratum's good documents are rejected, for all strata at once,
with probability ``1 - delta``. A stratum without enough labels gets no cutoff and loses nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_text, materialize

RULES = ("symbols", "bangs", "capitals", "dup_lines", "repeats")
#: Scores are compared on this grid, so that the label statistics stay of bounded size.
GRID = 200
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_capitals", "n_lines")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def repeated_words(words: list) -> int:
    """Number of words inside three-word windows that are found at least twice."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    hit = end = 0
    for at, gram in enumerate(grams):
        if seen[gram] > 1:
            hit += at + 3 - max(at, end)
            end = at + 3
    return hit


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS for one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines, seen, dup, full = raw.split(b"\n"), set(), 0, 0
    for line in lines:
        if line.strip(_SPACE):
            full += 1
            dup += line in seen
            seen.add(line)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - without(_SPACE), without(_SYMBOLS), dup, repeated_words(words), without(b"!"), without(_CAPITALS), full


def with_counts(docs: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the struct column ``name`` of text counts."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def make():
        return lambda texts: [[dict(zip(COUNTS, text_counts(t), strict=True)) for t in texts]]

    return map_text(docs, make, [T.StructField(name, kind)], keep=keep)


def base_failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{c}.n_words"))


def scores(c: str) -> dict[str, Column]:
    """Rule scores on the integer grid 0..GRID."""

    def share(top: str, bottom: str, scale: int) -> Column:
        ratio = F.col(f"{c}.{top}") * scale / F.greatest(F.col(f"{c}.{bottom}"), F.lit(1))
        return F.least(F.floor(ratio), F.lit(GRID)).cast("int")

    return {
        "symbols": share("n_symbols", "n_words", 100),
        "bangs": share("n_bangs", "n_words", 100),
        "capitals": share("n_capitals", "word_chars", GRID),
        "dup_lines": share("n_dup_lines", "n_lines", GRID),
        "repeats": share("n_repeat_words", "n_words", GRID),
    }


def allowed_rejections(n: int, alpha: float, delta: float) -> int:
    """Largest k with P(Binomial(n, alpha) <= k) <= delta, or -1: the exact (Clopper-Pearson) test."""
    if n <= 0:
        return -1
    total, k = 0.0, 0
    log_p, log_q = math.log(alpha), math.log1p(-alpha)
    while k <= n:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * log_p + (n - k) * log_q)
        if total > delta:
            return k - 1
        k += 1
    return n


#: Strata up to which the steps (five small ones for each) are broadcast.
MAX_BROADCAST = 10_000
#: What a good document counts against bad ones, and the least gain of a rule.
PRICE, LEAST_GAIN = 10.0, 0.02


def pick_cutoff(good: list[int], bad: list[int], price: float = PRICE, least: float = LEAST_GAIN) -> tuple[int, float]:
    """The cutoff t of one stratum and rule (reject where score > t), and its gain; GRID rejects nothing.

    The arguments are histograms of the fitting half over the grid. The gain is the share of bad rejected minus ``price`` times
    the share of good rejected; ties go to the middle of the gap.
    """
    all_good, all_bad = sum(good), sum(bad)
    if not all_good or not all_bad:
        return GRID, 0.0
    above_good = above_bad = 0
    best, ties = least, []
    for t in range(GRID, -1, -1):  # from the most lenient cutoff on
        gain = above_bad / all_bad - price * above_good / all_good
        if gain > best + 1e-12:
            best, ties = gain, [t]
        elif ties and abs(gain - best) <= 1e-12:
            ties.append(t)
        above_good += good[t]
        above_bad += bad[t]
    return (ties[len(ties) // 2], best) if ties else (GRID, 0.0)


def certified(rejected: list[int], held: int, alpha: float, delta: float) -> int:
    """How many rules of a fixed sequence stay: ``rejected`` has the held-out good documents that each rejects and none before it."""
    most, total = allowed_rejections(held, alpha, delta), 0
    for k, n in enumerate(rejected):
        total += n
        if total > most:
            return k
    return len(rejected)


def cutoffs(counted: DataFrame, labels: DataFrame, c: str, alpha: float, delta: float) -> DataFrame:
    """(stratum, one int column per rule), from all labelled documents.

    ``counted`` has doc_id, stratum, text_hash and the struct ``c``. Labelled texts are shuffled by their hash; the fitting
    half's histograms have at most strata * rules * (GRID + 1) * 2 rows and the holdout's counts one row for each stratum, whatever the input.
    Repeated labels of a document and copies of a text in a stratum count once (the lowest quality holds); null labels are skipped.
    """
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    labelled = counted.where(~base_failed(c)).join(truth, "doc_id").select("stratum", "text_hash", "q", F.array(*scores(c).values()).alias("scores"))
    once = materialize(labelled.groupBy("stratum", "text_hash").agg(F.min("q").alias("q"), F.first("scores").alias("scores")), "labelled")
    fits = F.col("text_hash") % 2 == 0
    n_strata = max(1, once.select("stratum").distinct().count())

    def choose(key, part):
        found = part.to_pydict()

        def histogram(quality: int) -> list[int]:
            out = [0] * (GRID + 1)
            for q, s, n in zip(found["q"], found["score"], found["count"], strict=True):
                out[s] += n if q == quality else 0
            return out

        t, gain = pick_cutoff(histogram(1), histogram(0))
        return pa.table({"stratum": [key[0].as_py()], "rule": pa.array([key[1].as_py()], pa.int32()), "t": pa.array([t], pa.int32()), "gain": [float(gain)]})

    fitted = once.where(fits).select("stratum", "q", F.posexplode("scores").alias("rule", "score")).groupBy("stratum", "rule", "q", "score").count()
    picked = fitted.groupBy("stratum", "rule").applyInArrow(choose, "stratum string, rule int, t int, gain double").where(F.col("t") < GRID)
    # A stratum has one step for each rule at most. Sent to all tasks while strata are few, as one may hold most of the rows.
    few = F.broadcast if n_strata <= MAX_BROADCAST else lambda df: df
    steps = materialize(picked.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("order"), "rule", "t"))).alias("steps")), "steps")
    first = F.array_position(F.transform("steps", lambda s: F.get(F.col("scores"), s["rule"]) > s["t"]), True)

    def fired(rows: DataFrame, steps: DataFrame) -> DataFrame:
        """Per stratum its steps, the documents of each label, and those that each step rejects and none before it."""
        label = lambda q: F.col("q") == q
        hit = [F.count_if(label(q) & (first == k + 1)).alias(f"hit_{q}_{k}") for q in (0, 1) for k in range(len(RULES))]
        counts = rows.join(few(steps), "stratum").groupBy("stratum").agg(F.count_if(label(0)).alias("n_0"), F.count_if(label(1)).alias("n_1"), *hit)
        of = [F.array(*(F.col(f"hit_{q}_{k}") for k in range(len(RULES)))).alias(f"hit_{q}") for q in (0, 1)]
        return counts.select("stratum", "n_0", "n_1", *of).join(few(steps), "stratum")

    share = lambda q, i: F.get(f"hit_{q}", i) / F.col(f"n_{q}")
    worth = F.filter("steps", lambda s, i: share(0, i) - PRICE * share(1, i) > LEAST_GAIN)
    steps = fired(once.where(fits), steps).select("stratum", worth.alias("steps"))
    tested = fired(once.where(~fits & (F.col("q") == 1)), materialize(steps, "worth")).select("stratum", "steps", F.col("n_1").alias("n"), F.col("hit_1").alias("hit"))

    def certify(batches):
        for batch in batches:
            made: dict[str, list] = {"stratum": [], **{f"t_{r}": [] for r in RULES}}
            for row in batch.to_pylist():
                stay = row["steps"][: certified(row["hit"][: len(row["steps"])], row["n"], alpha, delta / n_strata)]
                t = {s["rule"]: s["t"] for s in stay}
                made["stratum"].append(row["stratum"])
                for i, r in enumerate(RULES):
                    made[f"t_{r}"].append(t.get(i))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "stratum" else pa.int32()) for k, v in made.items()})

    return tested.mapInArrow(certify, "stratum string, " + ", ".join(f"t_{r} int" for r in RULES))


def _verdict(c: str, cut: str) -> Column:
    fired = F.lit(False)
    for r, score in scores(c).items():
        fired = fired | (score > F.coalesce(F.col(f"{cut}.t_{r}"), F.lit(GRID)))
    return ~base_failed(c) & ~fired


def _stratum(docs: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.1, stratum: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(verdicts, cutoffs): one row per document with doc_id, stratum, counts, base_failed, kept.

    Null texts are empty and fail the base rule; a null stratum is a stratum of its own (""), and so are all rows where there
    is no such column;
    repeated rows each get their verdict; empty labels or documents give no cutoffs; whatever other
    columns ``docs`` has are not touched.
    """
    stats = materialize(
        with_counts(docs.select("doc_id", _stratum(docs, stratum).alias("stratum"), F.xxhash64("text").alias("text_hash"), "text"), "counts", ["doc_id", "stratum", "text_hash"]),
        "quality",
    )
    chosen = materialize(cutoffs(stats, labels, "counts", alpha, delta), "cutoffs")
    cut = chosen.select("stratum", F.struct(*(f"t_{r}" for r in RULES)).alias("cut"))
    out = stats.join(cut, "stratum", "left").select(
        "doc_id", "stratum", "counts.*", base_failed("counts").alias("base_failed"), _verdict("counts", "cut").alias("kept")
    )
    return out, chosen


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The documents that pass, with their own columns; the counts are taken again beside the text,
    which costs less than sending every text through a shuffle to meet its verdict."""
    _, chosen = quality_verdicts(docs, labels, stratum=stratum, **options)
    c = free_name(docs, "quality_counts")
    s = free_name(docs, "quality_stratum")
    t = free_name(docs, "quality_cut")
    cut = chosen.select(F.col("stratum").alias(s), F.struct(*(f"t_{r}" for r in RULES)).alias(t))
    frame = with_counts(docs, c).withColumn(s, _stratum(docs, stratum)).join(cut, s, "left")
    return frame.where(_verdict(c, t)).select(*docs.columns)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    verdicts, _ = quality_verdicts(docs, labels)
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

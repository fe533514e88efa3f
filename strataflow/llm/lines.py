"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a document are hashed (two independent 64-bit hashes). A window that
occurs more than once keeps its first occurrence, by document id and position; the lines covered by
any later occurrence go. Occurrences of one window are counted with map-side partial aggregation and
met again in a join that Spark may split when one window is very frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

SIZE = 3


def _windows(one: str, two: str) -> Column:
    """Array of (p, h1, h2), one for each window, from the two columns of line hashes."""

    def mix(hashes: str, i: Column) -> Column:
        return F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(SIZE)))

    return F.transform(
        F.sequence(F.lit(0), F.size(one) - SIZE), lambda i: F.struct(i.alias("p"), mix(one, i).alias("h1"), mix(two, i).alias("h2"))
    )


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, covered): the line positions to remove, for documents that lose lines.

    Rows that repeat both id and text are one document. A null id is an id of its own and comes first.
    """
    split = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    # The hashes are columns of their own: inside the lambda of the windows they would be taken anew for each window.
    hashed = split.where(F.size("lines") >= SIZE).select(
        "doc_id",
        "text_hash",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("one"),
        F.transform("lines", lambda x: F.xxhash64(x, F.lit("second"))).alias("two"),
    )
    windows = hashed.select("doc_id", "text_hash", F.inline(_windows("one", "two")))
    place = F.struct("doc_id", "text_hash", "p")
    again = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first != last")
        .select("h1", "h2", "first")
    )
    later = windows.join(again, ["h1", "h2"]).where(F.struct("doc_id", "text_hash", "p") != F.col("first"))
    return (
        later.groupBy("doc_id", "text_hash")
        .agg(F.collect_set("p").alias("starts"))
        .select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*(p + k for k in range(SIZE)))))).alias("covered"))
    )


def dedup_lines(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the text that is left, and the names of two long columns: lines and lines removed.

    Null texts stay null and have no lines; documents of fewer than three lines lose none; a
    document whose every line goes keeps its row with an empty text; rows that repeat id and text are one document, so that each
    keeps what the others keep; an empty table gives an empty one; other columns pass through, whatever their names.
    """
    n_lines, n_removed, h, i, other, c = (free_name(docs, x) for x in ("n_lines", "n_removed", "text_hash", "hash_id", "hash_other", "covered"))
    gone = covered_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias(i), F.col("text_hash").alias(other), F.col("covered").alias(c))
    left = docs.withColumn(h, F.xxhash64("text"))
    joined = left.join(gone, left["doc_id"].eqNullSafe(gone[i]) & (left[h] == gone[other]), "left")
    ls = free_name(docs, "line_array")
    split = joined.withColumn(ls, F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(c))
    text = F.when(F.col(c).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(ls), i)), "\n"))
    out = split.withColumns(
        {
            n_lines: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(ls)).cast("long"),
            n_removed: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long"),
            "text": text,
        }
    )
    return out.select(*docs.columns, n_lines, n_removed), n_lines, n_removed


def line_dedup_query(docs: DataFrame) -> DataFrame:
    out, lines, removed = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(removed).alias("n_removed"), "text")


ORACLE = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL
), r AS (
  SELECT doc_id, i, a[i] AS line, a[i + 1] AS b, a[i + 2] AS c, len(a) AS n
  FROM l, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS k FROM r WHERE i + 2 <= n
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM w, (VALUES (0), (1), (2)) AS t(d) WHERE k > 1
), kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text, count(*) AS n_kept
  FROM r LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY r.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(l.a), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l.a) - coalesce(kept.n_kept, 0), 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

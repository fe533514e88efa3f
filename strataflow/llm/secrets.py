"""Secret scan: candidates by pattern, false positives removed by a random forest, in SQL functions only.

A candidate is a run of at least 16 characters of [A-Za-z0-9+/_=-] with a digit in it. Its features are
its length, character classes and their transitions, the share that dictionary words cover, path
separators, and the words beside it. The forest is trained from labelled findings with Spark's own
DataFrame learner; its trees are then written out as SQL expressions, so that scoring stays inside
code generation and needs no model object on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHARS = "A-Za-z0-9+/_=-"
CANDIDATE = f"(?<![{CHARS}])(?=[A-Za-z+/_=-]*[0-9])[{CHARS}]{{16,}}"
#: Characters beside a candidate in which its neighbouring words are looked for.
CONTEXT = 48
TREES, DEPTH, SEED = 15, 5, 7
#: Rows of labelled findings the forest is fitted on at most (a sample beyond; the only bounded part).
MAX_LABELLED = 20_000

# Words whose presence the dictionary feature looks for.
DICTIONARY = (
    "the and with from this that have which http https www com org net html index image images static assets "
    "python java class main test user data file path lib site packages node modules version release build "
    "model table order date time page item list name value type info page section chapter number report"
)
SECRET_WORDS = "(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|auth|bearer|credential|private[_-]?key|access[_-]?key|client[_-]?secret)"
HARMLESS_WORDS = "(commit|sha1|sha256|sha512|md5|checksum|digest|hash|uuid|guid|etag|revision|card|order|invoice|isbn|phone|serial|version|src|href|path|url)"

FEATURES = (
    "n_chars", "n_transitions", "digit_percent", "upper_percent", "is_hex", "only_digits", "n_distinct", "dictionary_percent",
    "n_slashes", "path_like", "dashes", "secret_before", "harmless_before", "assigned", "quoted", "known_prefix",
)


def features(c: str = "candidate", before: str = "before", after: str = "after") -> dict[str, Column]:
    """Integer features of a candidate and its surroundings."""
    x, left, right = F.col(c), F.col(before), F.col(after)
    n = F.length(x)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "Z"), "[^9aZ]", "-")
    squeezed = F.regexp_replace(shape, "(.)\\1+", "$1")
    words = "(" + "|".join(DICTIONARY.split()) + ")"
    percent = lambda part: F.floor(100 * part / n).cast("int")
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    low = F.lower(left)
    return {
        "n_chars": n,
        "n_transitions": percent(F.length(squeezed) - 1),
        "digit_percent": percent(n - F.length(F.regexp_replace(x, "[0-9]", ""))),
        "upper_percent": percent(n - F.length(F.regexp_replace(x, "[A-Z]", ""))),
        "is_hex": flag(x.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(x.rlike("^[0-9_=-]+$")),
        "n_distinct": F.size(F.array_distinct(F.split(x, ""))),
        "dictionary_percent": percent(n - F.length(F.regexp_replace(F.lower(x), words, ""))),
        "n_slashes": n - F.length(F.regexp_replace(x, "/", "")),
        "path_like": flag(right.rlike("^\\.[a-z]{1,5}\\b") | left.rlike("(://|\\.\\.?/|\\.[a-z]{2,5})$")),
        "dashes": flag(x.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")),
        "secret_before": flag(low.rlike(SECRET_WORDS)),
        "harmless_before": flag(low.rlike(HARMLESS_WORDS)),
        "assigned": flag(left.rlike("[=:]\\s*[\"'`]?$")),
        "quoted": flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "known_prefix": flag(x.rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_|xox[bap]-|sk-|sk_live_|glpat-|AIza|eyJ)")),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, text_hash, start_pos, end_pos (code points), candidate, before, after.

    Rows that repeat id and text are one document; null texts have no candidates.
    """
    base = docs.where(F.col("text").rlike(CANDIDATE)).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split("text", CANDIDATE, -1).alias("gaps"),
    )
    ends = F.transform("gaps", lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(CONTEXT)).alias("head")))
    rows = base.select("doc_id", "text_hash", "found", ends.alias("g")).select(
        "doc_id",
        "text_hash",
        F.posexplode(
            F.transform(
                "found",
                lambda x, i: F.struct(
                    x.alias("candidate"), F.get("g", i)["tail"].alias("before"), F.get("g", i + 1)["head"].alias("after"), F.get("g", i)["n"].alias("gap")
                ),
            )
        ).alias("at", "f"),
    )
    once = rows.dropDuplicates(["doc_id", "text_hash", "at"]).select("doc_id", "text_hash", "at", "f.*")
    from pyspark.sql import Window

    ahead = Window.partitionBy("doc_id", "text_hash").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("candidate")).over(ahead)
    return once.withColumn("end_pos", end.cast("long")).withColumn("start_pos", F.col("end_pos") - F.length("candidate"))


def labelled_findings(spark: SparkSession, rows: int = 3000, start: int = 0) -> DataFrame:
    """A small labelled table (candidate, before, after, label), made by rule from hashes of row numbers from ``start`` on."""
    h = lambda salt, n=40: F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), 1, n)
    b64 = lambda salt, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))), "\\s", ""), 1, n)
    digits = lambda salt, n: F.substring(F.translate(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256), "abcdef", "012345"), 1, n)
    one_of = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    words = [one_of(f"w{k}", *DICTIONARY.split()) for k in range(5)]
    keyword = one_of("k", "token", "secret", "api_key", "password", "access_key", "auth", "client_secret", "bearer")
    sign = one_of("s", ' = "', '="', ": ", " = '", "=", ': "')
    close = F.when(sign.contains('"'), '" ').when(sign.contains("'"), "' ").otherwise(" ")
    harmless = one_of("h", "commit ", "sha256:", "checksum: ", "digest ", "uuid ", "revision ", "md5 = ", "etag: ")
    prose = F.concat_ws(" ", *words[:3])
    kinds = [
        (h("a"), F.concat(prose, F.lit(" "), keyword, sign), close, 1),
        (b64("b", 32), F.concat(prose, F.lit(" "), keyword, sign), close, 1),
        (F.concat(F.lit("AKIA"), F.upper(h("c", 16))), F.concat(prose, F.lit(" key ")), F.lit(" "), 1),
        (F.concat(one_of("p", "ghp_", "xoxb-", "sk-", "glpat-", "sk_live_"), b64("d", 36)), F.concat(prose, F.lit(" ")), F.lit(" "), 1),
        (h("e"), F.concat(prose, F.lit(" "), harmless), F.lit(" "), 0),
        (F.concat_ws("-", h("f", 8), h("g", 4), h("i", 4), h("j", 4), h("l", 12)), F.concat(prose, F.lit(" id "), sign), close, 0),
        (digits("m", 16), F.concat(prose, F.lit(" ")), F.lit(" the"), 0),
        (F.concat_ws("/", *words[:4], digits("n", 3)), F.concat(prose, F.lit(" ./")), F.lit(".html "), 0),
        (F.concat_ws("_", *words[:4], digits("o", 2)), F.concat(prose, F.lit(" ")), F.lit(" of"), 0),
        (F.concat_ws("-", *words, digits("q", 4)), F.concat(prose, F.lit(" https://www.example.com/")), F.lit(" "), 0),
        (F.concat(F.lit("+"), digits("r", 17)), F.concat(prose, F.lit(" phone ")), F.lit(" "), 0),
        (b64("t", 40), F.concat(prose, F.lit(' src="data:image/png;base64,')), F.lit('" '), 0),
    ]
    pick = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda k: F.coalesce(*(F.when(pick == i, x[k] if isinstance(x[k], Column) else F.lit(x[k])) for i, x in enumerate(kinds)))
    return spark.range(start, start + rows, 1, 4).select(choose(0).alias("candidate"), choose(1).alias("before"), choose(2).alias("after"), choose(3).alias("label"))


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, max_rows: int = MAX_LABELLED) -> list[str]:
    """The forest's trees, as SQL expressions of the features with value 0 or 1.

    Rows with nulls are skipped; if there are more than ``max_rows``, a sample of that size on average is
    fitted. Without rows of both labels there is nothing to learn and every candidate stays.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.where("candidate is not null and label is not null").select(
        F.col("label").cast("double").alias("label"), *(v.cast("double").alias(k) for k, v in features().items())
    ).na.fill(0.0)
    n, kinds = rows.agg(F.count("*"), F.countDistinct("label")).first()
    if kinds < 2:
        return ["1"]
    if n > max_rows:
        rows = rows.sample(max_rows / n, seed=SEED)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(data)
    return as_sql(model)


def as_sql(model) -> list[str]:
    return [_as_sql(t.toDebugString) for t in model.trees]


def _as_sql(dump: str) -> str:
    """A tree's printed form as nested CASE."""
    lines = [x.strip() for x in dump.splitlines() if x.strip()][1:]

    def node(at: int) -> tuple[str, int]:
        if m := re.match(r"Predict: ([0-9.]+)", lines[at]):
            return str(int(float(m[1]))), at + 1
        m = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", lines[at])
        if not m:
            raise ValueError(f"unknown tree line: {lines[at]}")
        low, after = node(at + 1)
        high, after = node(after + 1)
        if low == high:
            return low, after
        return f"CASE WHEN {FEATURES[int(m[1])]} <= {m[2]} THEN {low} ELSE {high} END", after

    return node(0)[0]


def scan_secrets(docs: DataFrame, findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Every candidate with the forest's votes: doc_id, start_pos, end_pos, candidate, n_votes, is_secret.

    A candidate stays (is_secret) with the votes of more than half of the trees. Extra columns of
    ``docs`` are left out; empty tables give no rows; a null id is carried as null.
    """
    forest = train_forest(findings, trees, depth)
    votes = sum((F.expr(t) for t in forest[1:]), F.expr(forest[0]))
    found = candidates(docs.select("doc_id", "text")).withColumns(features())
    return found.select("doc_id", "start_pos", "end_pos", "candidate", votes.cast("long").alias("n_votes")).withColumn(
        "is_secret", 2 * F.col("n_votes") > len(forest)
    )

"""The ten training-data operators against brute force, exact round trips or held-out accuracy, with odd inputs."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from strataflow.llm import bpe, crf, decontam, induced, jaccard, lines, lm_score, pii, quality, repair, repeats, secrets, token_files, wordcache
from strataflow.llm.common import free_name
from strataflow.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Null ids, null and empty texts, repeated rows, and extra columns named like our own.
ODD = [(1, None, "x"), (2, "", "y"), (3, "one two", "y"), (3, "one two", "y"), (None, "one two", None), (4, "  \n \t", "z")]
ODD_SCHEMA = "doc_id long, text string, {}  string"


def odd(spark, extra):
    return spark.createDataFrame(ODD, ODD_SCHEMA.format(extra))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_lm_models_are_normalized_and_separate(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    target, background = lm_score.train(docs, labels)
    assert abs(lm_score.entropy(target) - 1) < 1e-9 and abs(lm_score.entropy(background) - 1) < 1e-9
    assert target.lists is not None and background.lists.size == target.lists.size
    rows = lm_score.lm_digest(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg("difference").alias("d")).collect()
    score = {r.quality: r.d for r in rows}
    assert score[1] < score[0]


def test_lm_background_counts_are_those_of_all_documents(spark, docs, texts):
    lists = lm_score.choose_lists(list(texts.values())[:40])
    word, history, bigram = lm_score.corpus_counts(docs, lists)
    every = [lm_score.count_text(lists, [t]) for t in texts.values()]
    assert all((a == sum(e[k] for e in every)).all() for k, a in enumerate((word, history, bigram))) and word.sum() == sum(len(lm_score.words_of(t)) for t in texts.values())


def test_lm_scores_equal_a_plain_computation(spark, docs, texts):
    import math

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = lm_score.target_texts(docs, labels)
    lists = lm_score.choose_lists(good)
    known = set(lists.id)
    of = lambda t: [w if w in known else None for w in lm_score.words_of(t)]
    listed = {("<s>" if a == 0 else None if a == 1 else list(known_words)[a - 2], None if b == 1 else list(known_words)[b - 2]) for known_words in [sorted(lists.id, key=lists.id.get)] for a, b in ((int(c) // lists.size, int(c) % lists.size) for c in lists.bigrams)}

    def model(every):
        one, head, two = Counter(), Counter(), Counter()
        for t in every:
            w = of(t)
            one.update(w)
            pairs = list(zip(["<s>", *w[:-1]], w, strict=True)) if w else []
            head.update(a for a, _ in pairs)
            two.update(p for p in pairs if p in listed)
        spent = Counter()
        for (a, _), n in two.items():
            spent[a] += (n - 0.75) / head[a]
        uni = lambda w: (one[w] + 1) / (sum(one.values()) + len(known) + 1)
        return lambda a, w: (max(two[a, w] - 0.75, 0) / head[a] if head[a] else 0) + max(1 - spent[a], 1e-12) * uni(w)

    target, background = model(good), model(texts.values())
    got = {r.doc_id: r for r in lm_score.lm_digest(docs, labels).collect()}
    for i in list(texts)[:25]:
        w = of(texts[i])
        pairs = list(zip(["<s>", *w[:-1]], w, strict=True))
        want = sum(math.log2(background(*p)) - math.log2(target(*p)) for p in pairs) / len(pairs)
        assert abs(got[i].difference - want) < 1e-6 and got[i].n_tokens == len(pairs)


def test_lm_odd_inputs(spark):
    labels = spark.createDataFrame([(3, 1, None), (3, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    frame = odd(spark, "lm")
    rows = lm_score.score_documents(frame, *lm_score.train(frame, labels)).collect()
    assert len(rows) == 6 and {r.lm_.n_tokens for r in rows} == {0, 2} and all((r.lm_.difference is None) == (r.lm_.n_tokens == 0) for r in rows)
    assert lm_score.lm_digest(frame.limit(0), labels.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        r = [int(c) for c in s[::-1]]
        return (sum(r[::2]) + sum(sum(divmod(2 * x, 10)) for x in r[1::2])) % 10 == 0

    find = lambda p, ok: [m.span() for m in re.finditer(p, t) if ok(m.group())]
    return {
        "email": find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g: True),
        "ip": find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g: all(int(p) <= 255 for p in g.split("."))),
        "card": find(r"[0-9]([\x20-]?[0-9])+", lambda g: 16 <= len(digits(g)) <= 19 and luhn(digits(g))),
        "phone": find(r"\+[0-9][\x20().0-9-]+[0-9]", lambda g: 8 <= len(digits(g)) <= 15),
    }


def test_pii_base_spans_equal_the_patterns(texts):
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice("0011223456789..--  @@+()ab%\né") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts.values())


def test_pii_is_linear_on_long_texts():
    model = pii.train_rows(pii.labelled_rows(rows=60))
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "x1" * 50_000, " 1" * 20_000):
        pii.added_spans(model, [t], [pii.base_spans(t)])


def test_crf_held_out_accuracy_and_viterbi():
    model = pii.train_rows(pii.labelled_rows())
    held = pii.labelled_rows(99, 300)
    found = model.decode([pii.token_features(t) for t, _ in held])
    pairs = [(x, y) for p, (_, g) in zip(found, held, strict=True) for x, y in zip(p, g, strict=True)]
    assert sum(x == y for x, y in pairs) / len(pairs) > 0.98
    small = crf.CRF(["a", "b", "c"])
    rng = np.random.default_rng(0)
    small.emission, small.move, small.start = rng.normal(size=small.emission.shape), rng.normal(size=(3, 3)), rng.normal(size=3)
    for n in range(1, 6):
        rows = [[[int(rng.integers(100))] for _ in range(n)] for _ in range(4)] + [[]]
        emit = small.scores(rows, n)
        for k, path in enumerate(small.decode(rows)[:4]):
            best = max(np.ndindex(*(3,) * n), key=lambda p, k=k: small.start[p[0]] + sum(emit[k, i, x] for i, x in enumerate(p)) + sum(small.move[a, b] for a, b in zip(p, p[1:], strict=False)))
            assert [small.labels[i] for i in best] == path


def test_pii_field_adds_and_base_stays(spark):
    labelled = pii.labelled_table(spark)
    rows = [(1, "write to bob [at] mail [dot] com today"), (2, "call (743) 555-3824 now"), (6, "write to bob [AT] mail [DOT] com today"), (7, "reach 10[.]20[.]3[.]40 now or 10[.]20[.]3[.]400 then"), (3, "a.b@c.de and 1.2.3.4"), (4, "nothing here 12 of 30"), (5, None)]
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string"), labelled).collect()}
    assert got[1].spans == got[6].spans == "email:9:32" and got[1].n_email == 0 and got[2].spans == "phone:5:19" and got[7].spans == "ip:6:22" and got[4].spans == "" and got[5].spans == ""
    assert got[3].spans == "email:0:8,ip:13:20" and got[3].base_sha256 == hashlib.sha256(b"email:0:8,ip:13:20").hexdigest() and (got[3].n_email, got[3].n_ip) == (1, 1)
    model = pii.train(labelled)
    assert len(pii.find_personal_data(odd(spark, "personal_data"), model).collect()) == 6


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_secret_forest_held_out(spark):
    findings = secrets.labelled_findings(spark)
    trees = secrets.train_forest(findings)
    votes = sum((F.expr(t) for t in trees[1:]), F.expr(trees[0]))
    held = secrets.labelled_findings(spark, 6000, 3000).withColumns(secrets.features()).select("label", (2 * votes > len(trees)).alias("p")).where("label is not null")
    right = held.agg(F.avg((F.col("p").cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.97


def test_secret_trees_as_sql_equal_the_fitted_ones(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = secrets.labelled_findings(spark, 1500).where("label is not null").select(F.col("label").cast("double").alias("label"), *(v.cast("double").alias(k) for k, v in secrets.features().items())).na.fill(0.0)
    data = VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="x").transform(rows)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=4, maxDepth=6, seed=3).fit(data)
    for tree, sql in zip(model.trees, secrets.as_sql(model), strict=True):
        out = tree.transform(data).select("prediction", F.expr(sql).alias("mine"))
        assert out.where("prediction != mine").count() == 0 and out.select("mine").distinct().count() == 2


def test_secret_features_read_whole_candidates(spark):
    long = "ab" * 400 + "".join(map(chr, range(65, 91))) + "1/" * 90
    row = spark.createDataFrame([(long, "", "")], "candidate string, before string, after string").select(*(v.alias(k) for k, v in secrets.features().items())).first()
    assert (row.n_chars, row.n_distinct, row.n_slashes) == (len(long), len(set(long)), 90)


def test_secret_spans_and_no_python_in_the_plan(spark, docs, texts):
    found = secrets.scan_secrets(docs, secrets.labelled_findings(spark))
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", found._jdf.queryExecution().toString())
    rows = found.collect()
    assert rows and all(texts[r.doc_id][r.start_pos : r.end_pos] == r.candidate for r in rows)
    assert {(r.doc_id, r.start_pos) for r in rows} == {(i, m.start()) for i, t in texts.items() for m in re.finditer(secrets.CANDIDATE, t)}


def test_secret_planted_and_odd(spark):
    key = "x = 1\ntoken = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" # done"
    rows = [(1, key), (1, key), (2, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), (3, None), (None, "4111111111111111 é " + key), (4, "")]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), secrets.labelled_findings(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start_pos, r.is_secret) for r in got) == [(False, 1, 15, True), (False, 2, 7, False), (True, 0, 0, False), (True, 0, 34, True)]
    empty = spark.createDataFrame([], "candidate string, before string, after string, label int")
    assert secrets.train_forest(empty) == ["1"]


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_induced_sorting_with_recursion_and_spills():
    rng = random.Random(1)
    for _ in range(250):
        letters, n = rng.choice([b"ab", b"abcd", b"a", bytes(range(97, 123))]), rng.randint(1, 100)
        b = bytes(rng.choice(letters) for _ in range(n))
        if rng.random() < 0.5:
            b = b + b[: rng.randint(0, n)] + b"\xfe" + b[rng.randint(0, n - 1) :]
        size = rng.choice([1, 2, 3, 5, 9, 17])
        seen = Counter(b[i : i + size] for i in range(len(b) - size + 1))
        want = [i + size <= len(b) and seen[b[i : i + size]] > 1 for i in range(len(b))]
        for base, items in ((1 << 30, 1 << 30), (3, 7)):
            assert induced.repeated_starts(np.frombuffer(b, np.uint8), size, base, items).tolist() == want


def test_strips_have_equal_anchors_for_equal_windows():
    rng = random.Random(5)
    find = repeats.Anchors(20, 6)
    a = bytes(rng.choice(b"abc ") for _ in range(300))
    b = bytes(rng.choice(b"xyz ") for _ in range(50)) + a[100:160] + b"yy"
    of = lambda raw: {i: h for s, e, h in zip(*(x.tolist() for x in find.strips(raw)[:3]), strict=True) for i in range(s, e)}
    one, two = of(a), of(b)
    assert all(one[100 + i] == two[50 + i] for i in range(41)) and len(one) == 281


def test_repeats_digest_equals_brute_force(spark, docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeats_digest(docs).collect()}
    want = repeats.brute_force(list(texts.values()), 200)
    assert [got[i] for i in texts] == want and sum(w[1] for w in want) > 0


def test_repeats_of_short_period_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "ANCHORS_PER_BUCKET", 2)
    long = "".join(random.Random(3).choices("abcdefgh", k=300))
    rows = [(1, "a" * 30_000), (2, "ab" * 3000 + long), (3, "ba" * 100), (4, "xyz" * 67), (5, "abc" * 66 + "ab"), (6, "q" * 199), (7, "q" * 200), (8, long[:199] + "!" + long), (9, "zz" + "0123456789" * 21)]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], repeats.brute_force([t for _, t in rows], 200), strict=True))
    strips = [(k % 3, bytes(random.Random(k).choices(b"ab", k=40)), 1) for k in range(30)]
    every = repeats.sort_shard(strips, 6)
    for h in range(3):
        mine = [i for i, s in enumerate(strips) if s[0] == h]
        alone = repeats.sort_shard([strips[i] for i in mine], 6)
        for size in (1, 100, 10**9):
            found = repeats.sort_bucket(strips, 6, size)
            assert size == 10**9 and found == every or [found[i] for i in mine] == alone


def test_a_long_run_of_one_character_stays_small():
    start, end, h, again = repeats.Anchors().strips(b"a" * 5_000_000)
    assert len(start) < 1300 and again[:-1].all() and len(set(h.tolist())) == 1 and (end[:-1] == start[1:]).all()


def test_repeats_odd_and_small_window(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        t = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 80)))
        if rows and rng.random() < 0.5:
            t = t[:20] + (rng.choice(rows)[1] or "")[5:45] + t[20:]
        rows.append((i, "ab" * 40 if rng.random() < 0.05 else None if rng.random() < 0.05 else t, "q"))
    rows += [(None, rows[0][1], "q"), (5, rows[5][1], "q")]
    out, name = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, dedup string"), 12)
    got = Counter((r.doc_id, r[name].n_bytes, r[name].n_removed, r[name].n_spans, hashlib.sha256(bytes(r[name].kept)).hexdigest()) for r in out.collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, repeats.brute_force([r[1] for r in rows], 12), strict=True)) and name == "dedup_"
    assert repeats.repeats_digest(odd(spark, "z").limit(0)).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------------


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def plain_contamination(texts, items):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = plain_words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0))
    return out


@pytest.mark.parametrize("per_pass", [1_000_000, 700])
def test_contamination_equals_brute_force(spark, docs, texts, per_pass):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()] + [(99, "the"), (100, "of the"), (101, "..."), (7, None)]
    more = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination_digest(docs, more, per_pass).collect()}
    assert [got[i] for i in texts] == plain_contamination(texts.values(), items)


def test_contamination_odd(spark):
    items = spark.createDataFrame([(1, "ONE é3 two"), (1, "ONE é3 two"), (None, "one"), (2, None)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x one É3 two", "q"), (2, "a one é3, TWO-one é3 two b", "q"), (3, None, "q"), (None, "", "q")], "doc_id long, text string, contamination string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination_digest(rows, items).collect()}
    assert got == {1: (4, 0, 0), 2: (8, 6, 1), 3: (0, 0, 0), None: (0, 0, 0)}
    kept = decontam.drop_contaminated(rows, items)
    assert kept.columns == rows.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert decontam.contamination_digest(rows, items.limit(0)).where("contaminated").count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_grammar_roundtrip_and_ranges():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, k = int(rng.integers(0, 300)), int(rng.integers(1, 6))
        ids = rng.integers(0, k, n) * int(rng.choice([1, 7000, 40_000_000])) + 5
        g = repair.Grammar.loads(repair.compress(ids, 6, 2).dumps())
        a = int(rng.integers(0, n + 1))
        b = int(rng.integers(a, n + 3))
        assert (g.decode() == ids).all() and (g.decode(a, b) == ids[a:b]).all()
    text = np.tile(np.arange(50), 100)
    assert len(repair.compress(text).sequence) < len(text) / 4


def test_token_files_equal_the_library(spark, docs, texts):
    t = token_files._tokenizer(WORD_BPE)
    got = token_files.token_files_digest(docs, WORD_BPE).orderBy("doc_id").collect()
    at = 0
    for r in got:
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_word_cache_on_unusual_texts():
    t, cache = token_files._tokenizer(WORD_BPE), token_files.WordCache(WORD_BPE, 10)
    for s in ("<|endoftext|> a<|endoftext|>b\n <|startoftext|>", "é ́x y z　w ΑΣ Σ", "a\r\nb\x0bc\x1cd", "  ", "\n", "don't DON'T 'S", "İstanbul ǅ ﬁ", "Å b. Å, c",
              "the. the, (the). \"the\". a-. x_. _,", "K k ſ", "가 ᅡ", "x ̸= ≠ \ń", ""):
        assert cache.encode_many([s])[0].tolist() == t.encode(s, add_special_tokens=False).ids, s


class Seen:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_of_plain_letters_need_no_normalizer():
    t, cache = token_files._tokenizer(WORD_BPE), token_files.WordCache(WORD_BPE)
    cache.tokenizer = Seen(t)
    letters = [c for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)]) if c.isalpha()]
    rng = np.random.default_rng(5)
    words = [*letters, "".join(letters), "s", "re", "ll", *("".join(rng.choice(letters, n)) for n in rng.integers(1, 20, 3000))]
    plain, mixed = " ".join(words), " ".join(f"{w} {v}" for w, v in zip(words[-600:], words[-600:][::-1], strict=True)).replace("a", "\u03b1").replace("e", "e\u0301")
    assert cache.encode_many([plain])[0].tolist() == t.encode(plain, add_special_tokens=False).ids
    assert all(set(x) - set(letters) - {" "} for x in cache.tokenizer.texts)
    seen = len(cache.tokenizer.texts)
    assert cache.encode_many([mixed])[0].tolist() == t.encode(mixed, add_special_tokens=False).ids and len(cache.tokenizer.texts) > seen


def test_plain_words_of_other_definitions_take_the_whole_way():
    given = json.loads(token_files._tokenizer(WORD_BPE).to_str())
    assert token_files._plain_tokenizer(given).normalizer is None
    for change in ({"normalizer": None}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}):
        assert token_files._plain_tokenizer(given | change) is None
    text = json.dumps(given)
    for old, new in (("[\\\\p{L}]+", "[\\\\p{L}]"), ('"use_regex": false', '"use_regex": true'), ('"add_prefix_space": false', '"add_prefix_space": true'), ('"Regex": "\\\\s+"', '"Regex": "a+"')):
        assert old in text and token_files._plain_tokenizer(json.loads(text.replace(old, new))) is None, old


def text_batches(texts, rows):
    names = [None if i == 3 else i for i in range(len(texts))]
    kinds = pa.schema({"doc_id": pa.int64(), "text": pa.string()})
    return [pa.RecordBatch.from_arrays([pa.array(names[a : a + rows], pa.int64()), pa.array(texts[a : a + rows], pa.string())], schema=kinds) for a in range(0, len(texts), rows)]


def test_batches_of_rows_are_joined_up_to_a_number_of_bytes():
    texts = ["a" * 50, None, "b" * 50, "c" * 500, "d", "", "é" * 20, "ff"]
    got = list(token_files._row_spans(iter(text_batches(texts, 2)), 200))
    assert [(names, chars) for names, _, chars in got] == [([0, 1], 200), ([2, None], token_files.BATCH_CHARS), ([4, 5, 6, 7], 200)]
    assert [t for _, some, _ in got for t in some] == texts
    assert [len(names) for names, _, _ in token_files._row_spans(iter(text_batches(texts, 2)))] == [8] and list(token_files._row_spans(iter([]))) == []


def test_words_of_joined_batches_are_looked_up_once():
    cache, asked = token_files.WordCache(WORD_BPE), []
    look_up = cache.cache.look_up
    cache.cache.look_up = lambda distinct: asked.append(len(distinct)) or look_up(distinct)
    for _, texts, chars in token_files._row_spans(iter(text_batches(["one two three " * 214] * 2000, 1000))):
        got = cache.encode_many(texts, chars)
        assert len(got) == 2000 and all(len(g) == 642 for g in got)
    assert asked == [4]


def test_new_words_with_marks_are_encoded_some_at_a_time():
    t, cache = token_files._tokenizer(WORD_BPE), token_files.WordCache(WORD_BPE)
    cache.tokenizer, sizes = Seen(t), []
    encode = cache.tokenizer.encode_batch_fast
    cache.tokenizer.encode_batch_fast = lambda texts, **options: sizes.append(len(texts)) or encode(texts, **options)
    text = " ".join(map(str, range(10_000, 13_000)))
    assert cache.encode_many([text, text])[1].tolist() == t.encode(text, add_special_tokens=False).ids
    assert sum(sizes) == 3000 and max(sizes) <= token_files.WORDS_AT_ONCE


def test_ids_are_put_in_place_in_steps(monkeypatch):
    words = [f"w{i % 37}" for i in range(500)]
    expand = lambda w: list(range(int(w[1:]) % 9))
    learn = lambda new: [np.array(expand(w), np.uint16).tobytes() for w in new]
    for step in (1, 3, 64, 1 << 18):
        monkeypatch.setattr(wordcache, "IDS_AT_ONCE", step)
        ids, ends = wordcache.IdCache(learn, np.uint16, 100).ids(pa.array(words))
        assert ids.dtype == np.uint16 and ids.tolist() == [i for w in words for i in expand(w)] and ends.tolist() == np.cumsum([len(expand(w)) for w in words]).tolist()


def test_token_files_blocks_and_random_access(spark):
    files = token_files.write_token_files(odd(spark, "grammar"), WORD_BPE, block_ids=3)
    rows = token_files.read_token_files(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 4] and [r.start for r in rows] == [0, 3, 4, 5, 8, 11]
    row = files.where("size(doc_ids) > 0").orderBy("shard", "block").first()
    whole = repair.Grammar.loads(row.grammar).decode().tolist()
    assert token_files.read_range(files, row.shard, row.block, 1, 3) == whole[1:3] and token_files.read_range(files, 99, 0, 0, 1) == []
    assert token_files.read_token_files(token_files.write_token_files(odd(spark, "a").limit(0), WORD_BPE)).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------------


def plain_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})


def test_quality_counts_equal_brute_force(spark, docs, texts):
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("ab  \n\n#é \x0b") for _ in range(rng.randint(0, 60)))
        assert quality.text_counts(t)[:5] == plain_counts(t), t
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_digest(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()}
    for i, t in texts.items():
        c = plain_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        assert got[i][:6] == (*c, failed) and not (failed and got[i][6])


def test_binomial_bound_is_exact():
    from math import comb

    for n, alpha, delta in ((50, 0.05, 0.1), (300, 0.01, 0.05), (20, 0.3, 0.01), (10, 0.05, 0.1)):
        tail = lambda k: sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
        k = quality.allowed_rejections(n, alpha, delta)
        assert (k < 0 or tail(k) <= delta) and tail(k + 1) > delta
    assert quality.allowed_rejections(0, 0.05, 0.1) == -1


def test_cutoffs_control_false_rejection():
    rng = np.random.default_rng(0)
    bad_draws, alpha, delta, some = 0, 0.05, 0.2, 0
    draw = lambda p, n: np.minimum(rng.geometric(p, n), quality.GRID)
    histogram = lambda x: np.bincount(x, minlength=quality.GRID + 1).tolist()
    for _ in range(200):  # two rules, tested together in the order of their gains
        good, bad, held = (np.stack([draw(p, 400), draw(p, 400)]) for p in (0.05, 0.02, 0.05))
        steps = sorted(((quality.pick_cutoff(histogram(g), histogram(b), price=0.5), i) for i, (g, b) in enumerate(zip(good, bad, strict=True))), key=lambda x: -x[0][1])
        steps = [(i, t) for (t, _), i in steps if t < quality.GRID]
        fired = np.stack([held[i] > t for i, t in steps]) if steps else np.zeros((0, 400), bool)
        new = [int((fired[k] & ~fired[:k].any(axis=0)).sum()) for k in range(len(steps))]
        stay = steps[: quality.certified(new, 400, alpha, delta)]
        some += bool(stay)
        passed = np.prod([1 - 0.95**t for _, t in stay]) if stay else 1.0
        bad_draws += 1 - passed > alpha
    assert bad_draws / 200 <= delta + 0.05
    assert quality.certified([0, 3, 1], 1000, 0.05, 0.1) == 3 and quality.certified([0, 300, 0], 1000, 0.05, 0.1) == 1 and quality.certified([0], 3, 0.05, 0.1) == 0


def plain_cutoffs(rows, alpha, delta):
    """rows: (stratum, text, text hash, label); cutoffs by stratum and rule."""
    texts = {}
    for stratum, text, h, q in rows:
        texts[stratum, h] = (text, min(q, texts.get((stratum, h), (0, 1))[1]))
    share = lambda a, b, k: min(k * a // max(b, 1), quality.GRID)
    drawn = {}
    for (stratum, h), (text, q) in texts.items():
        c = dict(zip(quality.COUNTS, quality.text_counts(text), strict=True))
        if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"]:
            score = (share(c["n_symbols"], c["n_words"], 100), share(c["n_bangs"], c["n_words"], 100), share(c["n_capitals"], c["word_chars"], 200), share(c["n_dup_lines"], c["n_lines"], 200), share(c["n_repeat_words"], c["n_words"], 200))
            drawn.setdefault(stratum, []).append((h % 2 == 0, q, score))
    out = {}
    for stratum, items in drawn.items():
        steps = []
        for rule in range(5):
            good, bad = ([s[rule] for fit, q, s in items if fit and q == label] for label in (1, 0))
            gains = {t: sum(x > t for x in bad) / len(bad) - 10 * sum(x > t for x in good) / len(good) for t in range(quality.GRID + 1)} if good and bad else {}
            top = max(gains.values(), default=0)
            best = [t for t in range(quality.GRID, -1, -1) if t in gains and abs(gains[t] - top) <= 1e-9]
            if top > 0.02:
                steps.append((-top, rule, best[len(best) // 2]))
        steps.sort()
        fit_of = lambda label: [s for fit, q, s in items if fit and q == label]  # noqa: E731, B023
        first = lambda label, k: sum(s[steps[k][1]] > steps[k][2] and not any(s[r] > t for _, r, t in steps[:k]) for s in fit_of(label)) / len(fit_of(label))  # noqa: E731, B023
        steps = [x for k, x in enumerate(list(steps)) if first(0, k) - 10 * first(1, k) > 0.02]
        held = [s for fit, q, s in items if not fit and q == 1]
        found = {}
        for k in range(len(steps)):
            if sum(any(s[r] > t for _, r, t in steps[: k + 1]) for s in held) > quality.allowed_rejections(len(held), alpha, delta / len(drawn)):
                break
            found[quality.RULES[steps[k][1]]] = steps[k][2]
        if held and steps:
            out[stratum] = found
    return out


def test_cutoffs_equal_a_plain_program(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(3000):
        lang, bad = rng.choice(["en", "en", "en", "de", "fr"]), rng.random() < 0.4
        mark = rng.choice(["!", "***", "X"])
        end = lambda bad=bad, mark=mark: mark if bad and rng.random() < 0.5 else "*" if rng.random() < 0.003 else ""
        rows.append((i, " ".join(rng.choice(words) + end() for _ in range(60)), lang, int(not bad)))
    rows += [(5000 + k, rows[k][1], rows[k][2], 1) for k in range(40)]  # copies, some of them with another label
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    verdicts, chosen = quality.quality_verdicts(docs, labels)
    got = {r.stratum: {k: getattr(r, f"t_{k}") for k in quality.RULES if getattr(r, f"t_{k}") is not None} for r in chosen.collect()}
    want = plain_cutoffs([(lang, text, hashes[i], q) for i, text, lang, q in rows], 0.05, 0.1)
    assert got == want and any(len(x) > 1 for x in want.values())
    score = lambda r: {"symbols": min(100 * r.n_symbols // r.n_words, 200), "bangs": min(100 * r.n_bangs // r.n_words, 200), "capitals": min(200 * r.n_capitals // r.word_chars, 200), "dup_lines": 0, "repeats": 200 * r.n_repeat_words // r.n_words}
    for r in verdicts.collect():
        assert r.kept == (not r.base_failed and not any(score(r)[k] > t for k, t in want.get(r.stratum, {}).items()))


def test_quality_rejects_junk_and_keeps_good(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    text = lambda end: " ".join(rng.choice(words) + end for _ in range(80))
    rows = [(i, text("!!" if i % 3 == 0 else "***" if i % 3 == 1 else ""), "en" if i % 2 else None, 0 if i % 3 < 2 else 1) for i in range(9000)]
    docs = spark.createDataFrame([(a, b, c, "x") for a, b, c, _ in rows], "doc_id long, text string, lang string, counts string")
    labels = spark.createDataFrame([(a, q) for a, _, _, q in rows] + [(None, 1), (5, None), (2, 1), (2, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality_digest(docs, labels).collect()}
    assert all(got[a] == (q == 1) for a, _, _, q in rows)
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3000


def test_quality_odd(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    frame = odd(spark, "quality_counts").withColumn("lang", F.lit(None).cast("string"))
    got = quality.quality_digest(frame, labels).collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got) and quality.quality_filter(frame, labels).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_pieces_and_rows_equal_the_library(tik):
    table, rng = bpe.ranks(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(150):
        p = bytes(rng.choice(b"abcethion \xc3\xa9") for _ in range(rng.randint(1, 200)))
        assert bpe.encode_piece(table, p) == tik._encode_single_piece(p)
        for size in bpe.ROW_SIZES:
            if len(p) <= size and p not in table.rank:
                ids, counts = bpe.encode_rows(table, [p, b"th", p], size)
                assert ids[: counts[0]].tolist() == ids[counts[:2].sum() :].tolist() == tik._encode_single_piece(p)


def test_bpe_texts_equal_the_library(tik, texts):
    encoder = bpe.Encoder(bpe.ranks(RANKS, public_tokenizers.PATTERN), cached=50)
    odd_texts = ["", "a" * 5000, "   x\x1c\x85y", "don't  \n\n 12three", "日本語 ไทย 🙂🙂", "\x00\x01", " " * 300 + "x"]
    every = [*texts.values(), *odd_texts]
    assert [ids.tolist() for ids in encoder.encode_many(every)] == [tik.encode_ordinary(t) for t in every]
    assert [ids.tolist() for ids in encoder.encode_many(every, chars=40)] == [tik.encode_ordinary(t) for t in every]
    assert encoder.encode(odd_texts[4]) == tik.encode_ordinary(odd_texts[4])
    for c in range(1, 0x3000):
        assert encoder.encode("a " + chr(c) * 2 + " b") == tik.encode_ordinary("a " + chr(c) * 2 + " b"), hex(c)


def test_bpe_digest_and_roundtrip(spark, docs, texts, tik):
    for r in bpe.bpe_digest(docs, RANKS, public_tokenizers.PATTERN).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = bpe.roundtrip(odd(spark, "token_ids"), RANKS, public_tokenizers.PATTERN)
    assert back.where("intact").count() == 6 and "token_ids_" in back.columns
    assert bpe.bpe_digest(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------------


def plain_line_dedup(rows):
    seen, gone = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        ls = rows[k][1].split("\n")
        gone[k] = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if w in seen:
                gone[k] |= {p, p + 1, p + 2}
            seen.add(w)
    return {rows[k][0]: (len(rows[k][1].split("\n")), len(g), "\n".join(x for i, x in enumerate(rows[k][1].split("\n")) if i not in g)) for k, g in gone.items()}


def test_line_dedup_equals_brute_force_without_python(spark, docs, texts):
    out = lines.line_dedup_query(docs)
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", out._jdf.queryExecution().toString())
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == plain_line_dedup(list(texts.items()))
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for i in range(120)]
    got = {r.doc_id: tuple(r)[1:] for r in lines.line_dedup_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(rows)


def test_line_dedup_odd(spark):
    rows = [(2, "a\nb\nc", "q"), (2, "a\nb\nc", "q"), (None, "a\nb\nc", None), (3, None, "z"), (4, "", "z"), (5, "a\nb", "z")]
    out, n, removed = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string"))
    got = sorted((str(r.doc_id), r.text, r[n], r[removed]) for r in out.collect() if r.text is not None)
    assert got == [("2", "", 3, 3), ("2", "", 3, 3), ("4", "", 1, 0), ("5", "a\nb", 2, 0), ("None", "a\nb\nc", 3, 0)] and out.count() == 6
    long = spark.createDataFrame([(1, "\n".join(f"line {i % 7000}" for i in range(40_000)))], "doc_id long, text string")
    assert lines.line_dedup_query(long).first().n_removed == 33_000


# 10 --------------------------------------------------------------------------------------------------------------------


def test_link_group_equals_brute_force():
    rng = np.random.default_rng(7)
    for trial in range(120):
        base = [np.unique(rng.integers(0, 1 << 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(2, 40))):
            pool = base + sets
            b = pool[int(rng.integers(len(pool)))]
            s = np.unique(np.concatenate([b[rng.random(len(b)) > rng.choice([0, 0.05, 0.1, 0.3])], rng.integers(0, 1 << 40, rng.integers(0, max(1, len(b) // 12) + 1)).astype(np.uint64)]))
            if len(s):
                sets.append(s)
        want, plain = jaccard.Groups(len(sets)), [set(x.tolist()) for x in sets]
        for i in range(len(plain)):
            for j in range(i):
                o = len(plain[i] & plain[j])
                if 100 * o >= 80 * (len(plain[i]) + len(plain[j]) - o):
                    want.join(i, j)
        assert jaccard.link_group(sets) == [want.root(i) for i in range(len(sets))], trial


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            o = len(sets[a] & sets[b])
            if a < b and 100 * o >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_equals_brute_force(spark, docs, texts):
    rng = random.Random(9)
    rows = list(texts.items())
    for k in range(60):  # families of near copies, chained, beside a common passage
        t = rng.choice(rows)[1].split(" ")
        for _ in range(max(1, len(t) // rng.choice([15, 25, 60]))):
            t[rng.randrange(len(t))] = "changed"
        rows.append((10_000 + k, " ".join(t)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert got == plain_components(rows) and sum(i != c for i, (_, c) in got.items()) > 10
    split = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame, group=3).collect()}
    assert split == got  # groups dealt out to parts of three, leaders and clusters compared across them
    kept = jaccard.keep_one(frame)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c} and kept.columns == frame.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_a_chained_family_in_parts(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows, last = [], words
    for k in range(80):  # each copy differs a little from some earlier one, so that clusters touch at their edges only
        last = list(rng.choice(rows)[1].split(" ")) if rows else list(words)
        for _ in range(rng.choice([0, 1, 1, 2])):
            last[rng.randrange(len(last))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(last)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    for group in (4, 1000):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame, group=group).collect()} == want


def test_jaccard_odd(spark):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd(spark, "h").withColumnRenamed("h", "n_shingles")).collect())
    assert got == [("1", 0, 1), ("2", 0, 2), ("3", 1, 3), ("3", 1, 3), ("4", 0, 4), ("None", 1, None)]
    assert jaccard.jaccard_components(odd(spark, "h").limit(0)).count() == 0 and jaccard.keep_one(odd(spark, "h")).count() == 6


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 120)}, 299: 299, 300: 299}


def test_free_name(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "A int, a_ int"), "a") == "a__"

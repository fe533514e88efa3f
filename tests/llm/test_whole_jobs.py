"""Places where an operator once did less than the whole job."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import decontam, jaccard, lm_corpus, lm_score, repair

ODD = [(1, None, "x"), (2, "", "y"), (3, "one two", "y"), (3, "one two", "y"), (None, "one two", None), (4, "  \n \t", "z")]


def odd(spark, extra):
    return spark.createDataFrame(ODD, f"doc_id long, text string, {extra} string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# 1, over tables ---------------------------------------------------------------------------------------------------------


def test_corpus_counts_have_bigrams_that_no_labelled_document_holds(spark, docs, texts):
    """Against plain counts of every bigram of every document, in batches far smaller than the input."""
    import math

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = set(lm_score.target_ids(labels))
    pairs = {i: list(zip([None, *w[:-1]], w, strict=True)) for i, t in texts.items() for w in [lm_score.words_of(t)]}

    def counts(ids):
        one, head, two = Counter(), Counter(), Counter()
        for i in ids:
            two.update(pairs[i])
            head.update(a for a, _ in pairs[i])
            one.update(b for _, b in pairs[i])
        return one, head, two, Counter(a for a, _ in two)

    (c, head, two, types), (gc, ghead, gtwo, gtypes) = counts(texts), counts(good & set(texts))
    n, m, kinds = sum(c.values()), sum(gc.values()), len(gc)
    plain = lambda w: c[w] / n
    fitted = lambda w: (gc[w] + kinds * plain(w)) / (m + kinds)

    def p(h, w, head, two, types, uni):
        return (max(two[h, w] - 0.75, 0) + 0.75 * types[h] * uni(w)) / head[h] if head[h] else uni(w)

    got = {r.doc_id: r for r in lm_corpus.corpus_digest(docs, labels, batch_bytes=20_000).collect()}
    assert len(got) == len(texts)
    for i, every in pairs.items():
        if every:
            t = -sum(math.log2(p(h, w, ghead, gtwo, gtypes, fitted)) for h, w in every) / len(every)
            b = -sum(math.log2(p(h, w, head, two, types, plain)) for h, w in every) / len(every)
            assert abs(got[i].target_bits - t) < 1e-6 and abs(got[i].background_bits - b) < 1e-6 and got[i].n_tokens == len(every)
    rows = lm_corpus.corpus_digest(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg("difference").alias("d")).collect()
    score = {r.quality: r.d for r in rows}
    assert score[1] < score[0]


def test_corpus_digest_odd_inputs(spark):
    labels = spark.createDataFrame([(3, 1, None), (3, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    frame = odd(spark, "lm")
    for some in (labels, labels.limit(0)):
        rows = lm_corpus.corpus_digest(frame, some).collect()
        assert len(rows) == 6 and all((r.difference is None) == (r.n_tokens == 0) for r in rows)
    assert lm_corpus.corpus_digest(frame.limit(0), labels).count() == 0
    assert lm_corpus.corpus_digest(frame.where("doc_id < 3"), labels).count() == 2


@pytest.fixture(scope="module")
def many_good(spark):
    """2,400 documents of a word of their own, twice; the first 2,100 are good, as some labels say more than once."""
    frame = spark.createDataFrame([(i, f"w{i} W{i}") for i in range(2400)], "doc_id long, text string")
    rows = [(i, 1, 0) for i in range(2100)] + [(i, 1, None) for i in range(50)] + [(i, 1, 1) for i in range(2100, 2200)]
    rows += [(i, 1, 0) for i in range(2100, 2150)] + [(i, 0, 0) for i in range(2200, 2300)] + [(None, 1, 0), (9999, 1, 0)]
    return frame, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_corpus_target_is_every_good_document(many_good):
    import math

    frame, labels = many_good
    rows = lm_corpus.corpus_digest(frame, labels, batch_bytes=5_000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2400))
    for r in rows:
        good = r.doc_id < 2100
        fitted = (2 * good + 2100 * 2 / 4800) / (4200 + 2100)
        want = -math.log2(0.25 / 2100 * good + 0.75 * fitted) - math.log2(0.25 + 0.75 * fitted if good else fitted)
        assert r.n_tokens == 2 and abs(r.target_bits - want / 2) < 1e-8, r


def test_lm_lists_are_those_of_every_good_document(many_good):
    frame, labels = many_good
    target, background = lm_score.train(frame, labels)
    plain = lm_score.choose_lists([f"w{i} W{i}" for i in range(2100)])
    assert target.lists.id == plain.id and len(plain.id) == 2100
    assert (target.lists.bigrams == plain.bigrams).all() and (background.lists.bigrams == plain.bigrams).all() and len(plain.bigrams) == 4200
    assert (target.unigram[2:] == 3 / (4200 + plain.size - 1)).all()


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 5000, 900)
    for ids in (np.tile(passage, 60), np.zeros(20_000, np.int64), rng.zipf(1.3, 60_000) % 3000, rng.integers(0, 40, 60_000), np.zeros(11, np.int64), np.tile([7, 8], 6), np.tile(passage, 60) * 100_000):
        g = repair.Grammar.loads(repair.compress(ids).dumps())
        assert (g.decode() == ids).all() and (g.decode(5, len(ids) - 1) == ids[5:-1]).all() and (g.decode(3, 9) == ids[3:9]).all()
        s = g.sequence
        assert not len(s) > 1 or np.unique(s[:-1] << 32 | s[1:], return_counts=True)[1].max() < repair.MIN_COUNT
    assert len(repair.compress(np.tile(passage, 60)).sequence) < 200


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_pipeline_drops_passages_of_items_without_id(spark, tmp_path):
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "delta epsilon"), (1, "zeta eta")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "delta epsilon"), (3, "a zeta eta"), (4, "clean text"), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, rows, str(tmp_path)).collect()) == [4, 5]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(rows, items, 3, without_id=True).collect()) == [4, 5]
    found = decontam.find_contamination(rows, items, "found", without_id=True).select("doc_id", "found.items").collect()
    assert {r.doc_id: r["items"] for r in found} == {1: [], 2: [], 3: ["1"], 4: [], 5: []}


# Pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_leaves_one_row_of_each_group(spark):
    near = " ".join(f"w{k}" for k in range(80))
    schema = "doc_id long, text string, row string"
    rows = [(5, "one two", "a"), (5, "one two", "b"), (None, "one two", "c"), (None, "three", "d"), (None, "three", "e"), (7, near, "f"), (8, near + " x", "g"),
            (8, "another text", "h"), (8, None, "i"), (8, "", "j"), (9, "one two", "k"), (4, near + " y", "l")]
    frame = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    got = {r["row"] for r in kept.collect()}
    assert kept.columns == frame.columns and len(got & {"a", "b"}) == 1 and len(got & {"d", "e"}) == 1
    assert got - {"a", "b", "d", "e"} == {"h", "i", "j", "l"}
    assert jaccard.keep_one_row(frame.limit(0)).count() == 0


def test_pipeline_keeps_the_same_documents_where_ids_are_unique(spark, docs):
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(jaccard.keep_one_row(docs)) == ids(jaccard.keep_one(docs))

"""The corpus pipeline: its stages in order, each one's decisions on its own input, and the queries registered for them."""

import base64
import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from strataflow.llm import decontam, jaccard, lines, quality
from strataflow.llm.common import materialize
from strataflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_drop_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == columns and ids(kept) == ids(quality.quality_digest(docs, labels).where("kept"))
    deduped = corpus_pipeline.line_dedup(spark, kept, SF)
    want = {r.doc_id: r.text for r in lines.line_dedup_query(kept).collect()}
    rows = deduped.collect()
    assert deduped.columns == columns and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    single = corpus_pipeline.near_duplicates(spark, deduped, SF)
    assert single.columns == columns and ids(single) == ids(jaccard.jaccard_components(deduped).where("doc_id = component_id"))
    clean = corpus_pipeline.decontamination(spark, single, SF)
    assert clean.columns == columns and ids(clean) == ids(decontam.contamination_digest(single, benchmark).where("not contaminated"))
    final = corpus_pipeline.bpe(spark, clean, SF)
    assert ids(final) == ids(clean) and final.where("not intact").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    mark = lambda df: hashlib.sha256(str(sorted((r.doc_id, list(r.token_ids)) for r in df.collect())).encode()).hexdigest()
    assert mark(whole) == mark(final) and whole.schema == final.schema


def test_every_operator_has_one_query_over_the_whole_table(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in QUERIES.items():
        df = query(spark, SF)
        assert "doc_id" in df.columns
        if not name.startswith("op3_"):
            assert df.select("doc_id").distinct().count() == n, name
        else:
            assert df.agg(F.count("*")).first()[0] >= 0


def plain_quality(text):
    words = re.split("[ \t-\r]+", (text or "").strip(" \t\n\v\f\r"))
    words = [w for w in words if w]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words) >= 50 and 100 * len(again) <= 50 * len(words)


def plain_lines(rows):
    seen, out = {}, []
    for i, t in sorted(rows):
        lines_ = t.split("\n")
        gone = set()
        for p in range(len(lines_) - 2):
            window = tuple(lines_[p : p + 3])
            if seen.setdefault(window, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out.append((i, "\n".join(x for k, x in enumerate(lines_) if k not in gone)))
    return out


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_first_of_near(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", low(t)) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(i, t) for i, t in rows if root(i) == i]


def plain_clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    every = {tuple(w[k : k + 10]) for w in map(words, items) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in every}
    hit = lambda w: any(tuple(w[k : k + n]) in every for n in sizes for k in range(len(w) - n + 1))
    return [(i, t) for i, t in rows if not hit(words(t))]


def test_the_pipeline_equals_a_plain_program(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet"), labels)[1].where("t_symbols < 100 or t_repeats < 100").count() == 0
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    rows = [(i, t) for i, t in docs if plain_quality(t)]
    rows = plain_clean(plain_first_of_near(plain_lines(rows)), items)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, list(r.token_ids), r.n_tokens) for r in got} == {i: (t, tik.encode_ordinary(t), len(tik.encode_ordinary(t))) for i, t in rows}
    assert len(got) == len(rows) and 20 < len(rows) < len(docs)


def test_stages_on_odd_rows_and_clashing_names(spark):
    names = ["token_ids", "intact", "n_tokens", "text_hash_id", "text_hash", "covered", "hash_id", "row", "quality_counts", "quality_stratum", "quality_cut", "component_id", "name", "d1"]
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(None, long), (1, long), (1, long), (2, None), (3, ""), (4, "a\nb\nc\na\nb\nc"), (5, long + " more"), (None, None)]
    docs = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert out.columns[: len(docs.columns)] == docs.columns and empty.count() == 0 and empty.columns == out.columns, name
        found = materialize(out, "odd").collect()
        kept = Counter((r.doc_id, r.text) for r in found)
        if name == "quality":
            assert kept == Counter({(None, long): 1, (1, long): 2, (5, long + " more"): 1})
        elif name == "line_dedup":
            assert kept == Counter({**Counter(rows), (4, "a\nb\nc\na\nb\nc"): 0}) + Counter([(4, "a\nb\nc")])
        elif name == "near_duplicates":
            assert kept == Counter([(1, long), (2, None), (3, ""), (4, "a\nb\nc\na\nb\nc"), (None, None)])
        elif name == "decontamination":
            assert kept == Counter(rows)
        else:
            assert kept == Counter(rows) and all(r.intact_ and r.n_tokens_ == len(r.token_ids_) for r in found)

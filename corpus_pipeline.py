"""A training-corpus pipeline over ``documents``: five stages, each one operator, each over all that its predecessor kept.

1. quality: documents that the base rules or the risk-controlled cutoffs reject go.
2. line_dedup: lines covered by later occurrences of a three-line window go; every document keeps its row.
3. near_duplicates: of each component of 5-word shingle sets of similarity 0.8 or more one row with the smallest doc_id stays.
4. decontamination: documents that hold a benchmark window go, whether or not its item has an id.
5. bpe: token ids of each text, with the check that decoding gives back its bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.bpe import roundtrip
from strataflow.llm.common import discard, free_name, materialize, table
from strataflow.llm.decontam import drop_contaminated
from strataflow.llm.jaccard import keep_one_row
from strataflow.llm.lines import dedup_lines
from strataflow.llm.quality import quality_filter

TOKENIZER = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts have no words and go; without a ``lang`` column all documents are one stratum; repeated rows get one verdict each;
    empty labels leave the base rules; an empty table stays empty. Columns pass through."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null; rows that repeat id and text are one document; of equal windows the one of the smallest id and position
    stays. ``n_chars``, where it is, is taken again. Other columns pass through."""
    out, _, _ = dedup_lines(docs)
    out = out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words stay, as they link with nothing; rows are told apart by a number of their own, so that repeated and null
    ids are no matter; of equal ids in a component any one row stays. Columns pass through."""
    return keep_one_row(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and empty ones stay; benchmark items without id count, those without text do not; with no items all
    documents stay. Columns pass through."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), without_id=True)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All rows and columns, and token_ids, intact and n_tokens, each under the next free name if the input has it. Null texts
    have no ids."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    coded = roundtrip(docs, path, public_tokenizers.PATTERN)
    return coded.withColumn(free_name(coded, "n_tokens"), F.size(coded.columns[len(docs.columns)]).cast("long"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The quality stage's exact binomial test and BPE's merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again, as a job would."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

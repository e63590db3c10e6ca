"""A training corpus in five stages: quality, exact copies, near copies, the mix of sources, packed sequences.

Each stage is a function (spark, docs, sf_dir) that works on all that the stage before kept; run() writes each result as
Parquet to the shared folder and reads it again as the next stage's documents. All but the last return the columns of
documents, whatever others there are and whatever their names. SQL can't express the classifier, so tests/llm compares run() with
plain versions of the stages.

Null texts count as empty and pass through the first four stages as they are: the classifier scores them, equal ones are copies, they have no
shingles and so no near copies, and count one token. Texts are read whole, however long. An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from decisia.llm import exact, jaccard, mixing, packing, quality
from decisia.llm.common import table, written
from decisia.llm.encoding import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject; without usable labels, all. Rows that repeat an id are judged each by its text."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the least id (one row where that repeats); rows without an id stay only if their text has no other."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join, the document with the least id; rows without an id stay."""
    return jaccard.drop_near(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the words, by the target weights of domains, languages and sources, null ones being nodes of their own."""
    return mixing.mix_documents(docs, budget_share=0.8)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 ids; an empty text is its end id."""
    return packing.pack(docs, tokenizer_path(), end_id=1)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("source mixing", mix_stage), ("packing", pack_stage)]

#: SQL can express none of the stages that rest on the classifier's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

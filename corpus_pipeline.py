"""The corpus pipeline: quality rules, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, folder) and returns a DataFrame; all but the last keep the columns of ``documents``. The
decisions are those of the operators with their production parameters, but near copies are texts whose five-word
shingles have a Jaccard similarity of 0.8 or more (``op6_simhash_near_dedup`` keeps its own contract).

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns; what
becomes of them is said at each. An empty table passes through as an empty table with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import packing, quality, shingles, suffixdedup
from skerry.llm._shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go. A null or empty text has no words and fails; repeated rows are judged each for itself, and
    other columns are not read."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. SimHash finds near copies as the operator does, with a
    wider radius; an exact way follows for those beyond it, and whole sets of shingles prove all. Rows that repeat the kept id all stay; a row without an id stays if nothing with an id is near; texts without words are
    copies of each other."""
    return shingles.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that an earlier document has go from the texts; every document stays, and one that is all repeats has an
    empty text. A null text becomes an empty one; rows without an id come after all others; of rows with one id none is
    earlier. ``n_chars`` follows the text, all other columns come back as they were."""
    done = suffixdedup.dedup_texts(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, one row per piece. A null or empty text is one piece of one token; repeated rows and rows
    without an id are packed as often as they come."""
    file, ranks = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    return packing.pack(docs, file, ranks, added=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", pack)]

#: SQL cannot express fingerprint components or packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The training-data pipeline over `documents`: quality rules, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. `run` writes each stage's rows to the shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import mixing, packing, quality, simhash, toxicity
from sievelight.llm.common import spill, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject. Null and empty texts have no words and fail the base rules; each row is judged
    alone, so ties and repeated rows are kept or dropped alike. Empty table: empty. Columns of `docs` keep their values."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that score 0.5 or more. Null and empty texts hold no clause and stay; each row is judged alone. Long texts are
    read whole. Empty table: empty. Columns of `docs` keep their values."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest id (null ids last), among equal ids that of the smallest
    hash of the text. Null and empty texts are copies of each other; repeated rows are copies; rows that share an id but no
    text are judged apart. Empty table: empty. Columns of `docs` keep their values."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times. Null text: size 0. Null source: a source of its own. Ties are broken
    by id and text; rows alike in these and their source share their copies. Empty table: empty. Columns keep their values."""
    return mixing.emitted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence, not the columns of `docs`. Null and empty texts are the end
    id alone; repeated rows and null ids are documents like others; only documents above the capacity are cut. Empty table: empty."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("quality", reject_low_quality),
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned stages, fingerprints of 64-bit hashes and tokens have no SQL form.
ORACLE_SQL = None

"""From raw documents to token ids: each stage's output is written and read as the next one's input.

A stage begins by removing what the stages before it have stored on the way, so its
result is to be written before the next stage is called, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.durable import fresh_scratch, new_folder, written
from thicket.llm import exact_dedup, minhash, mix, quality
from thicket.llm.public import encoded_digests


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines.

    Null and empty texts do not pass; repeated rows are judged each for itself; an empty
    table gives no rows. All columns of ``docs`` stay, whatever their names.
    """
    fresh_scratch(spark)
    return quality.good_documents(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts: of the longest originals that of the smallest ``doc_id``.

    Null counts as empty, and empty texts equal each other; a null ``doc_id`` counts as the
    largest; of rows that are the same, one stays; an empty table gives no rows.
    """
    fresh_scratch(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, on shingles of five words: that of the smallest ``doc_id``.

    Texts that are null or have no words are near nothing and stay; a null ``doc_id`` counts as
    the largest; of rows that are the same, one stays; an empty table gives no rows.
    """
    fresh_scratch(spark)
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it; some not at all.

    A null source is a source; documents without words stay once; repeated rows are drawn
    each for itself; an empty table gives no rows.
    """
    fresh_scratch(spark)
    return mix.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, one row per row.

    Null counts as empty: no tokens, and the digests of nothing. An empty table gives no rows.
    """
    fresh_scratch(spark)
    return encoded_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]

# The line rule's near copies, near dedup, mixing and encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), new_folder(spark, keep=True))
    return STAGES[-1][1](spark, docs, sf_dir)

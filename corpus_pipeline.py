"""The corpus pipeline: from ``documents`` to packed training sequences, one written table per stage.

Every stage but the last returns the columns of ``documents``; each works on all that its predecessor kept. Stages
that run Python on the executors send this package there first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.cluster import ship
from lamella.llm import lines, minhash, packing, quality, toxicity
from lamella.llm.common import table
from lamella.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    ship(spark)
    return quality.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line found in ten documents or more stays at its first place (smallest doc_id) and goes everywhere else.
    Documents that lose all their words with it go; those that had none before stay."""
    had = "_lamella_had"
    marked = docs.withColumn(had, F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)))
    out = lines.drop_lines(marked, min_docs=10, keep_first=True)
    return out.where(~F.col(had) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).drop(had)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    ship(spark)
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048."""
    ship(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("packing", pack),
]

#: A trained model's scores and token ids can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole ``documents`` table; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, name.replace(" ", "-"))
    return docs

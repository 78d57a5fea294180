"""The corpus pipeline: documents in, packed sequences out. Each stage reads all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aksharaflow.llm import line_dedup, mixing, neardup, packing, toxicity
from aksharaflow.llm.common import free_name, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the segment search calls toxic; it learns from the labels that op3 may learn from."""
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False))
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn)
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold, but for the largest doc_id; n_chars follows the text."""
    kept = line_dedup.LineIndex.empty(spark).insert(docs).apply(docs, counted=False)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, similarity 0.8)."""
    kept = neardup.near_duplicates(docs).where("kept").select("doc_id")
    lone = docs.where(F.col("doc_id").isNull())
    return docs.join(kept.where(F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi").select(docs.columns).unionByName(lone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the mix of their sources, a row for each time a document is taken. Rows are numbered, so that
    rows that share a doc_id are taken each by its own."""
    row, times = free_name(docs, "row_no"), free_name(docs, "times")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mixing.mix(numbered, row_col=row).where("taken > 0").select(row, (F.col("taken") / F.col("size")).cast("int").alias(times))
    return numbered.join(taken, row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the taken documents into sequences of 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The first stage learns from labels, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact dedup by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, partitions, staged

#: What a row costs besides its bytes, in bytes, when hot texts are looked for.
ROW_BYTES = 512
#: Characters of the normalised text that lead the sort key; the digest follows, so that splitters stay small.
HEAD = 32


def _runs(df: DataFrame, cut: list[str], tie: list) -> DataFrame:
    """Sorts each cut by content and compares neighbours: adds first, run and keep (the id that leads the run)."""
    w = Window.partitionBy(*cut).orderBy("norm", *tie)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("first", F.coalesce(F.lag("norm").over(w) != F.col("norm"), F.lit(True)))
    return df.withColumn("run", F.sum(F.col("first").cast("int")).over(upto)).withColumn("keep", F.last(F.when(F.col("first"), F.struct("id")), ignorenulls=True).over(upto))


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. The one with the most code points in its original text
    stays, then the smallest id. Sampled splitters range-partition the normalised content (its head, then its digest);
    an external sort puts equal texts side by side, where whole texts are compared with their neighbours.
    A text whose copies cost more than half a mean task is cut by a hash of id and row number into pieces of about that size;
    each piece keeps its best row, and a second pass compares the at most 4 rows per shuffle partition that pieces keep.

    Null texts count as empty; empty texts are one group. Null ids come last in ties. Of repeated rows (same id
    and text) one is kept. An empty table gives no rows; other columns are ignored.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("chars"), F.regexp_replace(text, f"[{SPACE}]+", "").alias("norm"))

    piece = (docs.agg(F.sum(F.octet_length(text) + ROW_BYTES)).head()[0] or 0) / (2 * n)
    cost = F.sum(F.octet_length("norm") + ROW_BYTES).alias("cost")
    top = base.groupBy(F.xxhash64("norm").alias("hot")).agg(cost, F.count("*").alias("rows")).where("rows > 1").orderBy(F.desc("cost"), "hot").limit(2 * n).collect()
    hot = [(r["hot"], int(r["cost"] // piece) + 1) for r in top if r["cost"] > piece]

    pieces = spark.createDataFrame(hot, "hot long, pieces int")  # at most two rows per shuffle partition
    base = base.join(F.broadcast(pieces), F.xxhash64("norm") == F.col("hot"), "left").select(
        "id", "chars", "norm", F.substring("norm", 1, HEAD).alias("head"), F.sha2("norm", 256).alias("digest"),
        F.when(F.col("pieces").isNull(), -1).otherwise(F.pmod(F.xxhash64("id", "chars", F.monotonically_increasing_id()), F.coalesce("pieces", F.lit(1)))).cast("int").alias("piece"),
    )
    cut = ["head", "digest", "piece"]
    marked = _runs(base.repartitionByRange(*cut), cut, [F.desc("chars"), F.asc_nulls_last("id")])
    marked = marked.select("id", "chars", *cut, "first", "run", "keep", F.when(F.col("first") & (F.col("piece") >= 0), F.col("norm")).alias("norm"))
    marked = marked.withColumn("rows", F.count("*").over(Window.partitionBy(*cut, "run")))
    if hot:
        marked = staged(marked, "exact-dedup")
        lead = marked.where(F.col("norm").isNotNull()).select(*cut, "chars", "norm", F.col("run").alias("of"), F.col("keep.id").alias("id"), "rows")
        lead = _runs(lead, ["head", "digest"], [F.desc("chars"), F.asc_nulls_last("id"), "piece"]).withColumn("total", F.sum("rows").over(Window.partitionBy("head", "digest", "run")))
        lead = lead.select(*cut, F.col("of").alias("run"), F.col("keep").alias("lead"), F.col("first").alias("leads"), "total")
        marked = marked.join(F.broadcast(lead), [*cut, "run"], "left")  # as few rows as there are pieces
    else:
        marked = marked.withColumns({"lead": F.col("keep"), "leads": F.lit(True), "total": F.col("rows")})
    return marked.select(
        F.col("id").alias("doc_id"), F.when(F.col("lead").isNull(), F.col("keep.id")).otherwise(F.col("lead.id")).alias("keep_id"), F.coalesce("total", "rows").alias("group_size"),
        (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"), F.col("digest").alias("text_sha256"),
    )

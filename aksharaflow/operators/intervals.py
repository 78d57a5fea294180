"""Order-dependent operators: islands, interval merging, as-of picks, sessions, modes within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """rows with island: how many times flag has changed so far in its group."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_f", flag)
    return rows.withColumn("_c", (~F.col("_f").eqNullSafe(F.lag("_f").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn("island", F.sum("_c").over(w).cast("long")).drop("_f", "_c")


def changes(rows: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """The rows at which value differs from the row before, and each first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_v", value)
    return rows.withColumn("_p", F.lag("_v").over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_v").eqNullSafe(F.col("_p"))).drop("_v", "_p", "_n")


def merge_intervals(rows: DataFrame, by: list[str], a: str, b: str, gap=0) -> DataFrame:
    """by, a, b, n: intervals [a, b] of each group joined where they overlap or stand at most gap apart."""
    w = Window.partitionBy(*by).orderBy(a, b)
    top = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (top.isNull() | (F.col(a) > top + gap)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*by, "_run").agg(F.min(a).alias(a), F.max(b).alias(b), F.count("*").alias("n")).drop("_run")


def next_after(rows: DataFrame, by: list[str], order: list[str], hit: Column, value: str, name: str) -> DataFrame:
    """rows with the value of the first later row of the group where hit holds: an as-of pick in one ordered pass."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(F.when(hit, F.col(value)), ignorenulls=True).over(w))


def last_within(rows: DataFrame, by: list[str], time: str, hit: Column, value: str, seconds: int, name: str) -> DataFrame:
    """rows with the latest value where hit holds among the rows of the group up to `seconds` before, itself left out."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return rows.withColumn(name, F.max(F.when(hit, F.struct(F.col(time).alias("at"), F.col(value).alias("v")))).over(w)["v"])


def mode_within(rows: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """by, value, n: the value that most values of the group lie within tolerance of; ties go to the smaller value.

    Equal values are counted first, so a frame holds distinct values only."""
    each = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    near = F.expr(f"sum(_n) OVER (PARTITION BY {', '.join(by)} ORDER BY {value} RANGE BETWEEN {tolerance}D PRECEDING AND {tolerance}D FOLLOWING)")
    best = each.withColumn("n", near).groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m"))
    return best.select(*by, F.col("m.v").alias(value), (-F.col("m.k")).alias("n"))


def clear_winner(rows: DataFrame, by: list[str], name: str, least: int = 3, times: int = 2) -> DataFrame:
    """by, name, n: the most frequent name of each group, if it has `least` rows and `times` those of the next."""
    each = rows.groupBy(*by, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), name)
    ranked = each.withColumns({"r": F.row_number().over(w), "next": F.lead("n").over(w)})
    return ranked.where((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") >= times * F.coalesce("next", F.lit(0)))).drop("r", "next")

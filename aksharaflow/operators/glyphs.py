"""From the glyphs of a page to words and lines: ordered windows over rows, a page a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_overprint(glyphs: DataFrame, page: list[str], near: float = 0.8) -> DataFrame:
    """glyphs (page columns, seq, x, y, width, size, font, text) without those drawn over one of the same font and text that
    is at most `near` away in either direction and was drawn before.

    A page is dealt out once, for this and for what orders it next. A glyph stands in the bands of y that it may meet others in,
    two of them; in its own band a window over x, as wide as `near` on both sides, holds the few glyphs that lie so close."""
    band = lambda y: F.floor(y / (2 * near))
    rows = glyphs.repartition(*page).withColumn("_b", F.explode(F.array_distinct(F.array(band(F.col("y") - near), band(F.col("y")), band(F.col("y") + near)))))
    same = ", ".join(f"`{c}`" for c in (*page, "font", "text", "_b"))
    close = F.expr(f"collect_list(struct(seq, y)) OVER (PARTITION BY {same} ORDER BY x RANGE BETWEEN {near}D PRECEDING AND {near}D FOLLOWING)")
    over = F.exists("_close", lambda g: (g["seq"] < F.col("seq")) & (F.abs(g["y"] - F.col("y")) <= near))
    return rows.withColumn("_close", close).where((F.col("_b") == band(F.col("y"))) & ~over).select(*glyphs.columns)


def words(glyphs: DataFrame, page: list[str], rise: float = 0.5, gap: float = 0.2) -> DataFrame:
    """A row for each word: page columns, line, word (numbers in drawing order), x0, x1, y, text.

    A line ends where the baseline moves by more than `rise` of the size; a word ends there, at white space, and where
    the next glyph starts more than `gap` of the size behind the last one's end, or before its start."""
    w = Window.partitionBy(*page).orderBy("seq")
    end = F.lag(F.col("x") + F.col("width")).over(w)
    blank = F.col("text").rlike(r"(?U)^\s*$")
    line = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)) > rise * F.col("size"), F.lit(True))
    word = line | (F.col("x") - end > gap * F.col("size")) | (F.col("x") + F.col("width") < F.lag("x").over(w)) | F.lag(blank).over(w)
    rows = glyphs.withColumns({"_line": line.cast("int"), "_word": F.coalesce(word, F.lit(True)).cast("int"), "_blank": blank})
    rows = rows.withColumns({"line": F.sum("_line").over(w).cast("long"), "word": F.sum("_word").over(w).cast("long")}).where(~F.col("_blank"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda g: g["text"]), "")
    return rows.groupBy(*page, "line", "word").agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.first("y").alias("y"), text.alias("text"))

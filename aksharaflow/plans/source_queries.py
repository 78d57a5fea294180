"""Queries over glyphs as a page holds them, made of the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glyphs
from .registry import query, table


def page_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a page of glyphs of one font: a line of text is a line of the page, white space draws nothing, and every
    third glyph is drawn twice, slightly apart, as bold text is in old files."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    chars = lines.select("doc_id", "page", "line", F.posexplode(F.split("text", "")).alias("i", "text")).where(~F.col("text").rlike(r"^\s*$"))
    drawn = chars.select("doc_id", "page", (F.col("line") * 100_000_000 + F.col("i") * 2).cast("long").alias("seq"), (F.col("i") * 6.0).alias("x"), (F.col("line") * -14.0).alias("y"), F.lit(5.5).alias("width"), F.lit(10.0).alias("size"), F.lit("regular").alias("font"), "text")
    again = drawn.where(F.col("seq") % 3 == 0).withColumns({"seq": F.col("seq") + 1, "x": F.col("x") + 0.4})
    return drawn.unionByName(again)


_WORDS = r"""SELECT conv_id AS doc_id, turn, line, i, w FROM (SELECT conv_id, turn, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
  (SELECT conv_id, turn, line, regexp_extract_all(t, '[^\t\n\x0B\f\r ]+') AS ws FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations)))"""


@query(f"SELECT doc_id, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY turn, line, i)) AS words_md5 FROM ({_WORDS}) GROUP BY doc_id")
def glyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations, put together again from the places of their glyphs."""
    found = glyphs.words(glyphs.without_overprint(page_glyphs(spark, sf_dir), ["doc_id", "page"]), ["doc_id", "page"])
    each = F.array_sort(F.collect_list(F.struct("page", "word", "text")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.md5(F.array_join(F.transform(each, lambda x: x["text"]), " ")).alias("words_md5"))


@query(f"SELECT doc_id, turn AS page, CAST(count(DISTINCT line) AS BIGINT) AS n_lines, CAST(max(length(w)) AS BIGINT) AS longest FROM ({_WORDS}) GROUP BY doc_id, turn")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page, and its longest word, from the places of glyphs."""
    found = glyphs.words(glyphs.without_overprint(page_glyphs(spark, sf_dir), ["doc_id", "page"]), ["doc_id", "page"])
    return found.groupBy("doc_id", "page").agg(F.countDistinct("line").alias("n_lines"), F.max(F.char_length("text")).cast("long").alias("longest"))

"""Queries that learn from whole corpora: glyph readings, confusions by alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import devanagari as deva
from ..functions.staging import staged
from ..operators import alignment, glyph_readings, learning, swaps
from .registry import query, table
from .text_queries import keyed_words

#: Letters whose glyphs tell nothing, by font; each font takes them for the next letter of the list at first.
HIDDEN = {"en": "aetnrs", "de": "eniru", "fr": "aoltd"}


def glyph_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of documents as glyphs of a font for each language, whose hidden letters are private characters; candidates for
    these, any hidden letter and a few signs; and all words of documents, which hold many wrong readings too."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = staged(words, "language-words")  # read by each font and as the lexicon
    fonts, tried = None, []
    for font, letters in HIDDEN.items():
        coded = F.translate("word", letters, "".join(chr(0xE000 + ord(x)) for x in letters))
        rows = words.where(F.col("lang") == font).select(F.lit(font).alias("font"), F.filter(F.split(coded, ""), lambda x: x != "").alias("glyphs"), "n")
        fonts = rows if fonts is None else fonts.unionByName(rows)
        for i, x in enumerate(letters):
            others = [letters[(i + 1) % len(letters)], *(c for c in "aeioustnrldmbcfghkpvwz" if c != letters[(i + 1) % len(letters)])]
            tried += [(font, chr(0xE000 + ord(x)), rank, c) for rank, c in enumerate(others)]
    return fonts, spark.createDataFrame(tried, "font string, glyph string, rank int, reading string"), words.select("word")


_HIDDEN_SQL = ", ".join(f"('{font}', '{x}')" for font, letters in HIDDEN.items() for x in letters)


@query(f"""SELECT v.font, chr(57344 + ascii(v.x)) AS glyph, v.x AS reading FROM (VALUES {_HIDDEN_SQL}) v (font, x)
WHERE EXISTS (SELECT 1 FROM documents d WHERE d.lang = v.font AND len(list_filter(regexp_extract_all(lower(d.text), '[a-z]{{2,}}'), lambda w: contains(w, v.x))) > 0)""")
def glyph_readings_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hidden glyphs of three fonts draw, found from the words that they make."""
    return glyph_readings.learn_readings(*glyph_words(spark, sf_dir), enough=1.0).select("font", "glyph", "reading")


#: What the text layer shows for what in the planted lines: an exchange of several characters, a loss, and an addition.
PLANTED_SWAPS = [("ment", "mem"), ("sch", "sh"), ("ou", "oou"), ("th", "tb")]


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of documents as they are and as a damaged text layer shows them; a word in three is damaged."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("real"))
    words, shown = F.split("real", " "), lambda w: w
    for good, bad in PLANTED_SWAPS:
        shown = lambda w, f=shown, g=good, b=bad: F.replace(f(w), F.lit(g), F.lit(b))
    return lines.select("real", F.array_join(F.transform(words, lambda w, i: F.when(i % 3 == 1, shown(w)).otherwise(w)), " ").alias("shown"))


@query()
def confusions_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions learned from damaged lines and their real text, over all lines of documents."""
    lines = damaged_lines(spark, sf_dir)
    lexicon = lines.select(F.explode(F.regexp_extract_all("real", F.lit(r"\p{L}+"), 0)).alias("word"))
    return alignment.learn_confusions(lines, lexicon)


def swapped_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words of documents as a damaged layer of each language shows them, which stores one letter as another and two as one; what
    was learned there, where the stored letters have several meanings; and all words as the lexicon."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("word")).distinct()
    shown = F.translate(F.replace(F.replace("word", F.lit("th"), F.lit("q")), F.lit("en"), F.lit("x")), "ai", "zz")
    learned = [("q", "th", 40), ("q", "ch", 9), ("x", "en", 30), ("x", "er", 12), ("z", "a", 50), ("z", "i", 45), ("xz", "sta", 3)]
    rows = spark.createDataFrame(learned, "src string, dst string, n long")
    per_language = words.select(F.col("lang").alias("doc_id")).distinct().join(F.broadcast(rows))  # a fixed list
    return words.select(F.col("lang").alias("doc_id"), shown.alias("word")), per_language, words.select("word")


@query()
def swap_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged words with the one known word that their readings make."""
    return swaps.only_readings(*swapped_words(spark, sf_dir))


@query()
def drawn_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions that drawing suggests, over key runs of documents as Devanagari words in the order on screen.

    Distinct runs are staged: of two groupings in a row Spark keeps the later one alone, and would convert every occurrence."""
    words = staged(keyed_words(spark, sf_dir).select("w"), "key-runs").select(deva.to_visual(deva.from_keys(F.col("w"))).alias("word"))
    return swaps.drawn_swaps(words)


#: What the planted text layer of each language stores for two of its letters.
STORED = {"en": ("ae", "01"), "de": ("ei", "23"), "fr": ("ou", "45"), "es": ("ar", "67")}


@query("SELECT v.lang AS doc_id, v.src, v.dst FROM (VALUES " + ", ".join(f"('{lang}', '{code}', '{letter}')" for lang, (letters, codes) in STORED.items() for letter, code in zip(letters, codes, strict=True)) + """) v (lang, src, dst)
WHERE v.lang IN (SELECT lang FROM documents)""")
def document_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text layers of four languages store for what, learned from all words of each at once."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("word")).distinct()
    shown = F.col("word")
    for lang, (letters, codes) in STORED.items():
        shown = F.when(F.col("lang") == lang, F.translate("word", letters, codes)).otherwise(shown)
    stored = words.where(F.col("lang").isin(*STORED)).select(F.col("lang").alias("doc_id"), shown.alias("word"))
    return learning.document_swaps(stored, words.select("word"), list("aeiouñrstn"), longest=1).select("doc_id", "src", "dst")

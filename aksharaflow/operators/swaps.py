"""Readings of damaged words under substitutions learned from their document, strongest first, and what drawing suggests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import devanagari as deva
from ..functions.keymaps import REPH_MARK

#: Readings of a word that are kept while it is read, the strongest.
WIDTH = 48
#: Characters of a piece that a substitution replaces, at most.
LONGEST = 5
_BEAM = "array<struct<weight:double,text:string>>"


def swap_tables(swaps: DataFrame) -> DataFrame:
    """doc_id, table: a map from each shown piece to its meanings (text, weight: the logarithm of its count), from learned swaps
    (doc_id, src, dst, n). One row a document; a document has few swaps."""
    each = swaps.where(F.char_length("src").between(1, LONGEST)).groupBy("doc_id", "src", "dst").agg(F.max("n").alias("n"))
    meant = each.groupBy("doc_id", "src").agg(F.collect_list(F.struct(F.log1p("n").alias("weight"), F.col("dst").alias("text"))).alias("meant"))
    return meant.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "meant"))).alias("table"))


def _readings(word: Column, table: Column, width: int) -> Column:
    """An array of (weight, text), strongest first. From left to right, the longest piece that has meanings is taken; it may also
    stand for itself, which weighs nothing. Ties go to the text that sorts first."""
    size = F.char_length(word)
    none = F.array().cast("array<struct<weight:double,text:string>>")

    def step(acc: Column, i: Column) -> Column:
        piece = lambda k: F.substring(word, i, F.lit(k))
        length = F.lit(1)
        for k in range(2, LONGEST + 1):
            length = F.when((i + k - 1 <= size) & F.map_contains_key(table, piece(k)), k).otherwise(length)
        taken = F.substring(word, i, length)
        options = F.concat(F.coalesce(F.try_element_at(table, taken), none), F.array(F.struct(F.lit(0.0).alias("weight"), taken.alias("text"))))
        grown = F.flatten(F.transform(acc["beam"], lambda b: F.transform(options, lambda o: F.struct((b["weight"] + o["weight"]).alias("weight"), F.concat(b["text"], o["text"]).alias("text")))))
        ranked = F.array_sort(F.array_distinct(F.transform(grown, lambda x: F.struct((-x["weight"]).alias("cost"), x["text"].alias("text")))))
        best = F.transform(F.slice(ranked, 1, width), lambda x: F.struct((-x["cost"]).alias("weight"), x["text"].alias("text")))
        read = F.struct((length - 1).cast("int").alias("skip"), best.cast(_BEAM).alias("beam"))
        return F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).cast("int").alias("skip"), acc["beam"].alias("beam"))).otherwise(read)

    start = F.struct(F.lit(0).alias("skip"), F.array(F.struct(F.lit(0.0).alias("weight"), F.lit("").alias("text"))).cast(_BEAM).alias("beam"))
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(1), size), start, step)["beam"]).otherwise(none)


def all_readings(words: DataFrame, swaps: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, word, rank, reading, weight: the `width` strongest readings of distinct words (doc_id, word) under their document's
    swaps, rank 1 first. A word of a document without swaps reads as itself."""
    rows = words.select("doc_id", "word").distinct().join(swap_tables(swaps), "doc_id", "left")
    table = F.coalesce("table", F.create_map().cast(f"map<string,{_BEAM}>"))
    rows = rows.withColumn("t", table).select("doc_id", "word", F.posexplode(_readings(F.col("word"), F.col("t"), width)).alias("rank", "r"))
    return rows.select("doc_id", "word", (F.col("rank") + 1).alias("rank"), F.col("r.text").alias("reading"), F.col("r.weight").alias("weight"))


def only_readings(words: DataFrame, swaps: DataFrame, lexicon: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, word, fixed: words (in the order on screen) with the one word of the lexicon that their readings make, put into
    logical order; words that make none, or several, have no row."""
    made = all_readings(words, swaps, width).select("doc_id", "word", deva.nfc(deva.from_visual(F.col("reading"))).alias("made"))
    known = made.where("made <> word").join(lexicon.select(F.col("word").alias("made")).distinct(), "made", "left_semi").distinct()
    one = F.count("*").over(Window.partitionBy("doc_id", "word")) == 1
    return known.withColumn("one", one).where("one").select("doc_id", "word", F.col("made").alias("fixed"))


def drawn_swaps(words: DataFrame) -> DataFrame:
    """word, src, dst: substitutions that drawing suggests for words in the order on screen: of three, two letters and a sign
    beneath, the sign may belong to the first; of two letters, the first may be an i-sign, or the second, if it is the
    same, a reph. A letter behind a virama is part of a conjunct and isn't taken apart.

    Patterns that look ahead find the places, overlapping ones too, in one pass each. Outer explode, so that Spark adds no
    filter by the array's size."""
    c, below = "[क-ह\u0958-\u095f]", "[ुूृ]"
    places = lambda pattern: F.regexp_extract_all("word", F.lit(pattern), 1)
    at = lambda x, i: F.substring(x, i, 1)
    swaps = lambda pattern, dst: F.transform(places(pattern), lambda x: F.struct(x.alias("src"), F.concat(*dst(x)).alias("dst")))
    each = F.concat(
        swaps(f"(?=({c}{c}{below}))", lambda x: [at(x, 1), at(x, 3), at(x, 2)]),
        swaps(f"(?<!्)(?=(({c})\\2))", lambda x: [at(x, 1), F.lit(REPH_MARK)]),
        swaps(f"(?<!्)(?=({c}{c}))", lambda x: [F.lit("ि"), at(x, 2)]),
    )
    return words.select("word").distinct().select("word", F.explode_outer(F.array_distinct(each)).alias("s")).where("s IS NOT NULL").select("word", "s.src", "s.dst")

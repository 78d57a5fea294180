"""Readings of glyphs that no table gives: coordinate ascent over the words in which the glyphs stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import discard, staged

#: Words of a glyph, the most frequent ones, that judge its readings, and those that judge them in the first, cheaper look.
TOP, FIRST_LOOK = 200, 40
#: Readings of a glyph that the first look leaves.
BEAM = 12
#: A glyph whose words are known to this share keeps its reading, unless a caller asks for more.
ENOUGH = 0.6
#: Shares of a font's words, each of which meets a copy of the font's readings.
SALTS = 16
#: How what is as large as the corpus meets other tables: shuffled, never as a whole in the driver, however small its files are.
MEET = "merge"


def _with_texts(words: DataFrame, reading: DataFrame) -> DataFrame:
    """words with parts, the reading of each of their glyphs; a glyph without a reading reads as itself. A font's readings
    are one map; words meet it by (font, salt), as one font may have most of them."""
    maps = reading.groupBy("font").agg(F.map_from_entries(F.collect_list(F.struct("glyph", "reading"))).alias("of")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = words.withColumn("salt", F.pmod("wid", F.lit(SALTS)).cast("int")).join(maps, ["font", "salt"], "left")
    part = lambda g: F.coalesce(F.try_element_at("of", g), g)
    return both.select("font", "wid", "glyphs", "n", F.when(F.col("of").isNull(), F.col("glyphs")).otherwise(F.transform("glyphs", part)).alias("parts"))


def _scores(now: DataFrame, places: DataFrame, tried: DataFrame, lexicon: DataFrame) -> DataFrame:
    """font, glyph, reading, rank, score: how many words (n) of places (font, glyph, wid) are known if the glyph is read so
    and all others as they are now, staged. Tried texts, few beside the lexicon (word), are staged and looked for in it, so that it is
    read, not shuffled or held, unless these are many as well."""
    rows = places.join(now.select("wid", "glyphs", "parts", "n"), "wid").join(tried, ["font", "glyph"])
    text = F.array_join(F.zip_with("glyphs", "parts", lambda g, p: F.when(g == F.col("glyph"), F.col("reading")).otherwise(p)), "")
    rows = staged(rows.select("font", "glyph", "reading", "rank", "n", text.alias("word")), "glyph-trials")
    known = lexicon.join(rows.select("word").distinct(), "word", "left_semi").withColumn("known", F.lit(True))
    scores = rows.join(known.hint(MEET), "word", "left").groupBy("font", "glyph", "reading", "rank").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("score"))
    scores = staged(scores, "glyph-scores")
    discard(rows)
    return scores


def learn_readings(words: DataFrame, candidates: DataFrame, lexicon: DataFrame, rounds: int = 12, beam: int = BEAM, enough: float = ENOUGH) -> DataFrame:
    """font, glyph, reading, hits, total: for each glyph of candidates (font, glyph, rank, reading), the reading that makes most
    words of the lexicon (word) out of words (font, glyphs: an array, n: how often). The reading of rank 0 is what the glyph
    is taken for at first. hits of total are the glyph's TOP most frequent words, counted by n, that are known at the end.

    A round scores, for all fonts at once, each glyph's readings with all other glyphs as they are. A glyph with more than
    `beam` readings is looked at on its FIRST_LOOK most frequent words first, and keeps the best. Of the glyphs that gain,
    those change whose gain is the largest in every word that they stand in, so that no two changes meet in a word and each
    round makes more words known. A glyph of which `enough` of the words are known isn't tried. Ties go to the present reading, then to the lower rank. Only glyphs that share a word
    with a changed one are scored again; after `rounds` rounds, or when nothing changes, it ends. Glyphs of words that
    candidates don't have read as themselves. Texts meet the lexicon in joins; what is carried between rounds is staged. Rounds hold no
    words but those that judge a glyph, TOP for each at most."""
    words = staged(words.groupBy("font", "glyphs").agg(F.sum("n").alias("n")).withColumn("wid", F.monotonically_increasing_id()), "glyph-words")
    lexicon = staged(lexicon.select("word").distinct(), "lexicon")
    candidates = candidates.groupBy("font", "glyph", "reading").agg(F.min("rank").alias("rank"))
    # a glyph with one reading has nothing to choose
    several = F.count("*").over(Window.partitionBy("font", "glyph"))
    candidates = staged(candidates.withColumn("several", several > 1), "glyph-candidates")
    reading = staged(candidates.groupBy("font", "glyph").agg(F.min_by("reading", F.struct("rank", "reading")).alias("reading")), "glyph-readings")
    open_ = candidates.where("several").select("font", "glyph").distinct()
    places = words.select("font", "wid", "glyphs", "n", F.explode(F.array_distinct("glyphs")).alias("glyph")).join(open_, ["font", "glyph"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("font", "glyph").orderBy(F.desc("n"), "glyphs"))
    places = staged(places.withColumn("nth", nth).where(F.col("nth") <= TOP).select("font", "glyph", "wid", "glyphs", "nth", "n"), "glyph-places")
    words = staged(places.select("font", "wid", "glyphs", "n").dropDuplicates(["wid"]), "glyph-words")
    totals = staged(places.groupBy("font", "glyph").agg(F.sum("n").alias("total")), "glyph-totals")
    todo = staged(open_, "glyphs-to-do")
    for _ in range(rounds):
        now = staged(_with_texts(words, reading), "glyph-texts")
        own = reading.join(todo, ["font", "glyph"]).withColumn("rank", F.lit(-1))
        base = _scores(now, places.select("font", "glyph", "wid"), own, lexicon).select("font", "glyph", F.col("score").alias("base"))
        unsettled = staged(base.join(totals, ["font", "glyph"]).where(F.col("base") < enough * F.col("total")).select("font", "glyph", "base"), "glyphs-unsettled")
        tried = candidates.join(unsettled, ["font", "glyph"]).select("font", "glyph", "reading", "rank")
        many = F.count("*").over(Window.partitionBy("font", "glyph")) > beam
        tried = staged(tried.withColumn("many", many), "glyph-tries")
        looked = _scores(now, places.where(F.col("nth") <= FIRST_LOOK).select("font", "glyph", "wid"), tried.where("many").drop("many"), lexicon)
        best_few = F.row_number().over(Window.partitionBy("font", "glyph").orderBy(F.desc("score"), "rank", "reading"))
        few = looked.withColumn("r", best_few).where(F.col("r") <= beam).select("font", "glyph", "reading", "rank")
        scored = _scores(now, places.select("font", "glyph", "wid"), tried.where("NOT many").drop("many").unionByName(few), lexicon)
        best = scored.groupBy("font", "glyph").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "reading")).alias("b"))
        better = best.join(unsettled, ["font", "glyph"]).where(F.col("b.score") > F.col("base"))
        better = staged(better.select("font", "glyph", F.col("b.reading").alias("reading"), (F.col("b.score") - F.col("base")).alias("gain")), "glyph-gains")
        # the largest gain of each word
        met = places.join(better, ["font", "glyph"])
        top = F.max(F.struct("gain", "glyph")).over(Window.partitionBy("wid")) == F.struct("gain", "glyph")
        free = met.withColumn("free", top).groupBy("font", "glyph").agg(F.bool_and("free").alias("free")).where("free").select("font", "glyph")
        changed = staged(better.join(free, ["font", "glyph"]).select("font", "glyph", F.col("reading").alias("new")), "glyph-changes")
        if changed.isEmpty():
            discard(now, unsettled, tried, better, changed)
            break
        new = staged(reading.join(changed, ["font", "glyph"], "left").select("font", "glyph", F.coalesce("new", "reading").alias("reading")), "glyph-readings")
        near = places.select("wid", "font", "glyph").join(places.join(changed, ["font", "glyph"]).select("wid").distinct(), "wid").select("font", "glyph").distinct()
        next_ = staged(near, "glyphs-to-do")
        discard(now, unsettled, tried, better, changed, todo, reading)
        todo, reading = next_, new
    final = _scores(_with_texts(words, reading), places.select("font", "glyph", "wid"), reading.withColumn("rank", F.lit(0)), lexicon)
    return final.join(totals, ["font", "glyph"]).select("font", "glyph", "reading", F.col("score").alias("hits"), "total")



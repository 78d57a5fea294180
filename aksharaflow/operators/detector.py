"""Legacy-text detection: a bigram model, token scores, line decisions, conversion of legacy runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Thresholds in hundredths: a word looks legacy, stands alone as legacy, looks English.
LEGACY, STRONG, ENGLISH = 300, 600, -100


def bigrams(word: Column) -> Column:
    """Bigrams of ^word$."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.char_length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))


def bigram_counts(words: DataFrame) -> DataFrame:
    """bg, n: counts over words (word, n)."""
    return words.select(F.explode(bigrams(F.col("word"))).alias("bg"), "n").groupBy("bg").agg(F.sum("n").alias("n"))


def train_bigrams(legacy: DataFrame, plain: DataFrame, least: int = 5) -> DataFrame:
    """bg, w_centi: log-ratio in hundredths of the conditional probabilities (add one half over the seen alphabet) of a
    bigram in two word lists (word, n); ratios of up to `least` hundredths are left out. Each list has a row a word."""
    both = bigram_counts(legacy).select("bg", F.col("n").alias("a")).join(bigram_counts(plain).select("bg", F.col("n").alias("b")), "bg", "full")
    both = both.select("bg", F.substring("bg", 1, 1).alias("c"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    sums = both.groupBy("c").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    size = both.agg(F.countDistinct(F.substring("bg", 2, 1)).alias("k"))
    ratio = F.log((F.col("a") + 0.5) / (F.col("sa") + 0.5 * F.col("k"))) - F.log((F.col("b") + 0.5) / (F.col("sb") + 0.5 * F.col("k")))
    rows = both.join(sums, "c").crossJoin(F.broadcast(size)).select("bg", F.round(100 * ratio, 0).cast("long").alias("w_centi"))  # size is one row
    return rows.where(F.abs("w_centi") > least)


def score_words(words: DataFrame, model: DataFrame, english: DataFrame) -> DataFrame:
    """word, score in hundredths: sum of bigram weights (missing ones 0), 400 for each of at most three signature hits,
    less 1200 for a common English word or 600 for another one (english: word, common); an address scores -2000.

    words holds distinct tokens (word); a token's core is what counts, and a token without a letter scores 0."""
    core = words.select("word", tx.core(F.col("word")).alias("core"))
    each = core.select("word", F.explode(bigrams(F.col("core"))).alias("bg")).join(model, "bg", "left")
    sums = each.groupBy("word").agg(F.sum(F.coalesce("w_centi", F.lit(0))).alias("s"))
    lex = english.select(F.lower("word").alias("low"), "common").groupBy("low").agg(F.max("common").alias("common"))
    both = core.withColumn("low", F.lower("core")).join(lex, "low", "left").join(sums, "word")
    penalty = F.when(F.col("common"), 1200).when(F.col("common").isNotNull() & (F.char_length("core") >= 3), 600).otherwise(0)
    score = F.when(~F.col("core").rlike("[A-Za-zÀ-ÿ]"), 0).when(F.col("word").rlike(tx.URLISH), -2000).otherwise(F.col("s") + 400 * tx.signature_hits(F.col("core")) - penalty)
    return both.select("word", score.cast("long").alias("score"), F.col("common").isNotNull().alias("english"))


def decide_lines(tokens: DataFrame, scores: DataFrame, line: list[str]) -> DataFrame:
    """tokens (line columns, pos, token, is_space) with score and is_legacy.

    A line votes: with two legacy tokens and three times as many as English ones, or one strong and none English, all of it
    is legacy but for clearly English tokens; otherwise a token must be strong itself. White space isn't joined with the
    scores; what is, is joined on distinct tokens. Where tokens have a column is_code, lines that it marks, and in any line
    addresses, plain numbers and bare signs, are never legacy. A line is one group, as it is in every text."""
    found = tokens.where(~F.col("is_space")).join(scores.select(F.col("word").alias("token"), "score", "english"), "token", "left")
    spaces = tokens.where("is_space").withColumns({"score": F.lit(None).cast("long"), "english": F.lit(None).cast("boolean")})  # half of all rows, on few keys
    rows = found.unionByName(spaces).withColumns({"score": F.coalesce("score", F.lit(0)), "english": F.coalesce("english", F.lit(False))})
    score = F.when((F.col("score") >= LEGACY) & F.col("english") & (tx.signature_hits(F.col("token")) == 0), ENGLISH).otherwise(F.col("score"))
    rows = rows.withColumn("score", score)
    w = Window.partitionBy(*line)
    rows = rows.withColumns({"n_legacy": F.sum((F.col("score") >= LEGACY).cast("int")).over(w), "n_english": F.sum((F.col("score") <= ENGLISH).cast("int")).over(w), "n_strong": F.sum((F.col("score") >= STRONG).cast("int")).over(w)})
    vote = ((F.col("n_legacy") >= 2) & (F.col("n_legacy") >= 3 * F.col("n_english"))) | ((F.col("n_strong") >= 1) & (F.col("n_english") == 0))
    legacy = F.when(F.col("is_space") | ~F.col("token").rlike("[A-Za-z]"), F.lit(False)).when(vote, F.col("score") > -400).otherwise((F.col("score") >= STRONG) & (F.char_length("token") >= 4))
    never = F.col("token").rlike(tx.URLISH) | F.col("token").rlike(tx.PLAIN_NUMBER) | tx.is_bare_sign(F.col("token"))
    never = never | F.coalesce("is_code", F.lit(False)) if "is_code" in tokens.columns else never
    return rows.withColumn("is_legacy", legacy & ~never).drop("n_legacy", "n_english", "n_strong", "english")


def force_tokens(tokens: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """tokens (token, is_space and others) with is_legacy for text that is known to be typed in a legacy layout: everything
    but addresses, numbers in plain digits, bare signs and, if given, English words (word) of three letters or more."""
    core = tx.core(F.col("token"))
    keep = F.col("is_space") | F.col("token").rlike(tx.URLISH) | core.rlike(tx.PLAIN_NUMBER) & ~tx.is_symbol_number(F.col("token")) | tx.is_bare_sign(F.col("token"))
    if english is None:
        return tokens.withColumn("is_legacy", ~keep)
    lex = english.select(F.lower("word").alias("_low"), F.lit(True).alias("_known")).distinct()
    rows = tokens.where(~F.col("is_space")).withColumn("_low", F.lower(core)).join(lex, "_low", "left")
    known = F.coalesce("_known", F.lit(False)) & (F.char_length("_low") >= 3)
    return rows.withColumn("is_legacy", ~keep & ~known).drop("_low", "_known").unionByName(tokens.where("is_space").withColumn("is_legacy", F.lit(False)))


def runs(rows: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Gaps and islands: rows with a column run that counts the changes of flag so far."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int"), F.lit(1))
    return rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")


def convert_mixed(decided: DataFrame, line: list[str], convert) -> DataFrame:
    """One row per line: the text with each maximal run of legacy tokens, and the spaces between them, converted by a
    function of a column."""
    w = Window.partitionBy(*line).orderBy("pos")
    between = F.col("is_space") & F.coalesce(F.lag("is_legacy").over(w) & F.lead("is_legacy").over(w), F.lit(False))
    rows = runs(decided.withColumn("_l", F.col("is_legacy") | between), line, "pos", "_l")
    each = rows.groupBy(*line, "run", "_l").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("t"))
    each = each.withColumn("t", F.when(F.col("_l"), convert(F.col("t"))).otherwise(F.col("t")))
    return each.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "t"))), lambda x: x["t"]), "").alias("text"), F.sum(F.col("_l").cast("int")).alias("n_legacy_runs"))

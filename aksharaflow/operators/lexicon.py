"""Lexicon operators: word tests, affix rules, skeletons, candidates that the lexicon proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged

# English endings, with what a stem may have lost in front of them.
ENGLISH_ENDINGS = ("'s", "s'", "ies", "es", "s", "ed", "ing", "ly", "er", "est")
RESTORED = {"ies": "y", "ed": "e", "ing": "e", "er": "e", "est": "e"}

#: Rows of 64 bits that hold the hashes of a lexicon, at most.
BLOCKS = 1 << 21


def known(words: DataFrame, lexicon: DataFrame, col: str = "word") -> DataFrame:
    """words with a column known: whether the lexicon (a column word) has it. Both sides are joined on the word; distinct
    words should come in, so that no word is hot."""
    has = lexicon.select(F.col("word").alias(col), F.lit(True).alias("known")).dropDuplicates([col])
    return words.join(has, col, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def english_stems(word: Column) -> Column:
    """The word, and each stem that one of the endings leaves, at least three characters long."""
    stems = [word]
    for end in ENGLISH_ENDINGS:
        stem = F.substring(word, F.lit(1), F.char_length(word) - len(end))
        fits = F.endswith(word, F.lit(end)) & (F.char_length(word) - len(end) >= 3)
        stems.append(F.when(fits, stem))
        if end in RESTORED:
            stems.append(F.when(fits, F.concat(stem, F.lit(RESTORED[end]))))
    return F.array_distinct(F.array_compact(F.array(*stems)))


def known_by_stem(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct words (word) that the lexicon has, as such or as a stem before an English ending."""
    stems = words.select("word", F.explode(english_stems(F.lower("word"))).alias("stem"))
    return stems.join(lexicon.select(F.lower("word").alias("stem")).distinct(), "stem", "left_semi").select("word").distinct()


def affix_forms(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """Every form that rules (kind 'S' or 'P', flag, strip, add, cond) make of stems (word, flags array): word, form, flag.

    A suffix rule applies to stems with its flag that end in strip and in what its condition, a regular expression, asks for,
    a prefix rule to those that begin so."""
    each = stems.select("word", F.explode("flags").alias("flag")).join(rules, "flag")
    front = F.col("kind") == "P"
    fits = F.when(front, F.startswith("word", F.col("strip")) & F.expr("word rlike concat('^(?:', cond, ')')")).otherwise(F.endswith("word", F.col("strip")) & F.expr("word rlike concat('(?:', cond, ')$')"))
    rest = F.char_length("word") - F.char_length("strip")
    form = F.when(front, F.concat("add", F.substring("word", F.char_length("strip") + 1, rest))).otherwise(F.concat(F.substring("word", F.lit(1), rest), "add"))
    return each.where(fits).select("word", form.alias("form"), "flag")


def known_by_affix(words: DataFrame, stems: DataFrame, rules: DataFrame) -> DataFrame:
    """Words (word) that a rule makes of a stem: word, stem, flag. Each word is cut at every place, the pieces are joined on what a
    rule adds, and the rebuilt stem is joined on the lexicon; nothing is generated for words that don't occur."""
    size = F.char_length("word")
    cut = words.select("word", F.explode(F.sequence(F.lit(0), size)).alias("n"))
    behind = cut.select("word", F.lit("S").alias("kind"), F.substring("word", size - F.col("n") + 1, F.col("n")).alias("add"), F.substring("word", F.lit(1), size - F.col("n")).alias("rest"))
    before = cut.select("word", F.lit("P").alias("kind"), F.substring("word", F.lit(1), F.col("n")).alias("add"), F.substring("word", F.col("n") + 1, size).alias("rest"))
    made = behind.unionByName(before).join(rules, ["kind", "add"])
    made = made.withColumn("stem", F.when(F.col("kind") == "P", F.concat("strip", "rest")).otherwise(F.concat("rest", "strip")))
    each = stems.select(F.col("word").alias("stem"), F.explode("flags").alias("flag"))
    fits = F.when(F.col("kind") == "P", F.expr("stem rlike concat('^(?:', cond, ')')")).otherwise(F.expr("stem rlike concat('(?:', cond, ')$')"))
    return made.join(each, ["stem", "flag"]).where(fits).select("word", "stem", "flag")


def skeleton(word: Column, signs: str = "[aeiou]") -> Column:
    return F.regexp_replace(word, signs, "")


def unique_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the only value that the key has; keys with several values are ambiguous and left out."""
    seen = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_top"))
    return seen.where(F.col(value) == F.col("_top")).drop("_top")


def candidates(words: DataFrame, cands: Column, lexicon: DataFrame) -> DataFrame:
    """word, fixed: for words that aren't known, the candidate that is, if there is exactly one; others have no row."""
    open_ = known(words, lexicon).where(~F.col("known")).select("word", F.explode(cands).alias("fixed")).where("fixed <> word").distinct()
    good = open_.join(lexicon.select(F.col("word").alias("fixed")).distinct(), "fixed", "left_semi")
    return unique_by(good, "word", "fixed")


def one_letter_variants(word: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each form in which one character is exchanged for its partner."""
    swap = {a: b for x in pairs for a, b in (x, x[::-1])}
    table = F.create_map(*[F.lit(x) for kv in swap.items() for x in kv])
    at = F.sequence(F.lit(1), F.char_length(word))
    one = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.element_at(table, F.substring(word, i, F.lit(1))), F.substring(word, i + 1, F.char_length(word)))
    return F.array_compact(F.transform(at, one))


def splits(word: Column, least: int = 2) -> Column:
    """Every cut of a word in two parts of at least `least` characters: structs a, b."""
    n = F.char_length(word)
    at = F.when(n >= 2 * least, F.sequence(F.lit(least), n - least)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.substring(word, F.lit(1), i).alias("a"), F.substring(word, i + 1, n).alias("b")))


def split_in_two(words: DataFrame, lexicon: DataFrame, least: int = 2) -> DataFrame:
    """word, a, b: unknown words that are two known ones, cut where the shorter part is longest, then furthest left."""
    each = known(words, lexicon).where(~F.col("known")).select("word", F.explode(splits(F.col("word"), least)).alias("p")).select("word", "p.a", "p.b")
    lex = lexicon.select("word").distinct()
    good = each.join(lex.select(F.col("word").alias("a")), "a", "left_semi").join(lex.select(F.col("word").alias("b")), "b", "left_semi")
    key = F.struct((-F.least(F.char_length("a"), F.char_length("b"))).alias("k"), F.char_length("a").alias("n"), "a", "b")
    return good.groupBy("word").agg(F.min(key).alias("m")).select("word", "m.a", "m.b")


def without_repeats(word: Column, longest: int = 4) -> Column:
    """Each form in which a piece that stands twice in a row is kept once: array of forms."""
    def shorter(n: int) -> Column:
        at = F.when(F.char_length(word) >= 2 * n, F.sequence(F.lit(1), F.char_length(word) - 2 * n + 1)).otherwise(F.array().cast("array<int>"))
        twice = F.filter(at, lambda i: F.substring(word, i, F.lit(n)) == F.substring(word, i + n, F.lit(n)))
        return F.transform(twice, lambda i: F.concat(F.substring(word, F.lit(1), i + n - 1), F.substring(word, i + 2 * n, F.char_length(word))))

    return F.array_distinct(F.concat(*map(shorter, range(longest, 0, -1))))


def strippings(word: Column, endings: list[str], least: int = 2, depth: int = 2) -> Column:
    """The word, and what is left of it when up to `depth` endings are taken off one after another; at least `least`
    characters stay."""
    every = level = F.array(word)
    for _ in range(depth):
        cut = lambda w: F.array(*[F.when(F.endswith(w, F.lit(e)) & (F.char_length(w) - len(e) >= least), F.substring(w, F.lit(1), F.char_length(w) - len(e))) for e in endings])
        level = F.array_compact(F.flatten(F.transform(level, cut)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def known_with_endings(words: DataFrame, lexicon: DataFrame, endings: list[str], depth: int = 2, compounds: bool = True) -> DataFrame:
    """word, how: distinct words that the lexicon has ('word'), has without up to depth endings ('ending'), or has as two
    parts, the second perhaps with endings ('compound'); the first that holds. Every candidate stem of a word is a row, and
    the lexicon is joined once for stems and once for each part."""
    lex = lexicon.select("word").distinct()
    stems = words.select("word", F.explode(strippings(F.col("word"), endings, depth=depth)).alias("stem"))
    found = stems.join(lex.withColumnRenamed("word", "stem"), "stem", "left_semi").select("word", F.when(F.col("stem") == F.col("word"), 0).otherwise(1).alias("n"))
    if compounds:
        two = stems.select("word", F.explode(splits(F.col("stem"))).alias("p")).select("word", "p.a", "p.b")
        two = two.join(lex.withColumnRenamed("word", "a"), "a", "left_semi").join(lex.withColumnRenamed("word", "b"), "b", "left_semi")
        found = found.unionByName(two.select("word", F.lit(2).alias("n")))
    kinds = F.array(*map(F.lit, ("word", "ending", "compound")))
    return found.groupBy("word").agg(F.min("n").alias("n")).select("word", F.get(kinds, F.col("n")).alias("how"))


def confusions(pairs: DataFrame) -> DataFrame:
    """src, dst, n: characters of shown words that stand for others of real words, over pairs (shown, real, n) of equal
    length, most frequent first when ordered by n."""
    at = F.transform(F.sequence(F.lit(1), F.char_length("shown")), lambda i: F.struct(F.substring("shown", i, F.lit(1)).alias("src"), F.substring("real", i, F.lit(1)).alias("dst")))
    same = F.char_length("shown") == F.char_length("real")
    each = pairs.where(same & (F.col("shown") != F.col("real"))).select("n", F.explode(at).alias("c")).select("n", "c.*").where("src <> dst")
    return each.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def hash_bits(lexicon: DataFrame) -> DataFrame:
    """block, mask: a bit for the hash of each word of the lexicon (word), 64 of them a row, staged. However large the lexicon is,
    there are at most BLOCKS rows."""
    slot = F.pmod(F.xxhash64("word"), F.lit(64 * BLOCKS))
    return staged(lexicon.select(F.floor(slot / 64).alias("block"), _bit(slot).alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("mask")), "lexicon-bits")


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))


def possible(rows: DataFrame, bits: DataFrame, column: str = "word") -> DataFrame:
    """Rows whose word the lexicon of hash_bits() may have: all that it has, and of the others one in so many as bits are set. What is
    tried by the dozen for each word is sifted so where it is made, before what is left meets the lexicon itself."""
    slot = F.pmod(F.xxhash64(column), F.lit(64 * BLOCKS))
    return rows.join(F.broadcast(bits), (F.floor(slot / 64) == F.col("block")) & (F.col("mask").bitwiseAND(_bit(slot)) != 0), "left_semi")  # at most BLOCKS rows


def swap_fixes(words: DataFrame, lexicon: DataFrame, swaps: list[tuple[str, str]], depth: int = 3) -> DataFrame:
    """word, fixed: unknown words with the only known word that at most `depth` swaps of one character make of them; the
    fewest swaps count, and a word that they make two known ones of has no row. Each round goes on with what is unknown."""
    table = {}
    for a, b in swaps:
        table.setdefault(a, []).append(b)
    options = F.create_map(*[x for a, bs in table.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    swap = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.transform(F.coalesce(F.try_element_at(options, F.substring(w, i, F.lit(1))), F.array().cast("array<string>")), lambda b: F.concat(F.substring(w, F.lit(1), i - 1), b, F.substring(w, i + 1, F.char_length(w))))))
    lex, done = staged(lexicon.select("word").distinct(), "lexicon"), None
    bits = hash_bits(lex)
    now = known(words.select("word").distinct(), lex).where(~F.col("known")).select("word", F.col("word").alias("form"))
    for left in range(depth - 1, -1, -1):
        now = now.select("word", F.explode(swap(F.col("form"))).alias("form")).where("form <> word")
        if left:  # the last round's forms, which are the most, are only looked up
            now = staged(now.distinct(), "swap-forms")
        hits = possible(now, bits, "form").join(lex.withColumnRenamed("word", "form"), "form", "left_semi").groupBy("word").agg(F.min("form").alias("fixed"), F.max("form").alias("other"))
        hits = staged(hits, "swap-hits")
        done = hits if done is None else done.unionByName(hits)
        now = now.join(hits.select("word"), "word", "left_anti")
    return done.where("fixed = other").drop("other")

"""Learning from a corpus: substitutions by greedy rounds, and grouping of pieces by dynamic programming."""

from __future__ import annotations

import json
from collections.abc import Container
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from . import lexicon
from .pieces import chunk_of, read_beside


def swap_gains(words: DataFrame, lex: DataFrame, targets: list[str], longest: int = 1, bits: DataFrame | None = None) -> DataFrame:
    """src, dst, n: for each piece of an unknown word (word, given) exchanged for a target, how many given words become known.
    bits are the lexicon's hashes, if the caller has them, which most of what is tried doesn't pass."""
    n = F.char_length("now")
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring("now", i, F.lit(k)))
    pieces = F.flatten(F.array(*map(cut, range(1, longest + 1))))
    open_ = lexicon.known(words.withColumnRenamed("word", "now"), lex, "now").where(~F.col("known"))
    tried = open_.select("given", "now", F.explode(F.array_distinct(pieces)).alias("src")).select("given", "now", "src", F.explode(F.array(*map(F.lit, targets))).alias("dst"))
    tried = tried.select("given", "src", "dst", F.replace("now", F.col("src"), F.col("dst")).alias("word"))
    tried = lexicon.possible(tried, lexicon.hash_bits(lex) if bits is None else bits)
    return tried.join(lex.select("word").distinct(), "word", "left_semi").groupBy("src", "dst").agg(F.countDistinct("given").alias("n"))


def best_swap(words: DataFrame, lex: DataFrame, targets: list[str], longest: int = 1) -> DataFrame:
    """The swap with the largest gain; ties go to the smaller source, then the smaller target."""
    return swap_gains(words.select("word", F.col("word").alias("given")), lex, targets, longest).orderBy(F.desc("n"), "src", "dst").limit(1)


def learn_swaps(words: DataFrame, lex: DataFrame, targets: list[str], rounds: int = 12, least: int = 5, longest: int = 1) -> DataFrame:
    """rank, src, dst, n: each round applies what was learned and takes the best further swap, while it helps `least` words.

    One row a round comes to the driver; words stay in staged tables, so that a round starts from the last one's."""
    spark, learned = words.sparkSession, []
    now, lex = words.select("word", F.col("word").alias("given")), staged(lex.select("word").distinct(), "lexicon")
    bits = lexicon.hash_bits(lex)
    for rank in range(1, rounds + 1):
        now = staged(now, "words")
        top = swap_gains(now, lex, targets, longest, bits).orderBy(F.desc("n"), "src", "dst").head()
        if top is None or top["n"] < least:
            break
        learned.append((rank, top["src"], top["dst"], top["n"]))
        done = lexicon.known(now, lex)
        now = done.select(F.when(F.col("known"), F.col("word")).otherwise(F.replace("word", F.lit(top["src"]), F.lit(top["dst"]))).alias("word"), "given")
    return spark.createDataFrame(learned, "rank int, src string, dst string, n long")


def best_groups(pieces: list[str], known: Container[str], most: int) -> list[str]:
    """Pieces joined to the groups of the best total score: groups of known words score their length to the power 1.4 less 1 a join. A piece
    alone scores 0 at least; ties go to the shorter last group."""
    whole, ends = "".join(pieces), [0, *accumulate(map(len, pieces))]
    sums, last = [0.0], [0]
    for i, piece in enumerate(pieces, 1):
        best, size, end = sums[-1] + (len(piece) ** 1.4 if piece in known else 0.0), 1, ends[i]
        for k in range(2, min(most, i) + 1):
            gram = whole[ends[i - k] : end]
            if gram in known:
                score = sums[i - k] + (len(gram) ** 1.4 - (k - 1))
                if score > best:
                    best, size = score, k
        sums.append(best)
        last.append(size)
    out, i = [], len(pieces)
    while i:
        out.append(whole[ends[i - last[i]] : ends[i]])
        i -= last[i]
    return out[::-1]


def group_pieces(lines: DataFrame, lex: DataFrame, by: list[str], most: int = 4) -> DataFrame:
    """by, text: pieces of each line (an array) joined to known words, groups of at most `most` pieces, best total score.

    A known group scores its length to the power 1.4 less 1 a join, an unknown piece alone scores 0; ties go to the shorter
    last group. Groups are n-grams, of which distinct ones of a chunk of lines that the lexicon has are dealt to its lines; the sums then
    run along each line, in time linear in its pieces. Lines are shuffled once, and no list is put together again."""
    rows = lines.select(F.lit(0).alias("doc_id"), F.struct(*by).alias("item"), F.to_json("pieces").alias("text"), "pieces")
    at = F.sequence(F.lit(1), F.size("pieces"))
    starts = rows.where(F.size("pieces") > 0).select(chunk_of(), "pieces", F.explode(at).alias("i"))
    grams = starts.select("chunk", F.explode(F.array(*[F.when(F.col("i") + k - 1 <= F.size("pieces"), F.array_join(F.slice("pieces", F.col("i"), F.lit(k)), "")) for k in range(1, most + 1)])).alias("word"))
    good = grams.where("word IS NOT NULL").join(lex.select("word").distinct(), "word", "left_semi").distinct()

    grouped = lambda text, known: " ".join(best_groups(json.loads(text), known, most))
    told = good.select("chunk", F.col("word").alias("key"), F.lit("").alias("made"))
    return read_beside(rows.select("doc_id", "item", "text"), told, grouped).select("item.*", "text")


def document_swaps(words: DataFrame, lex: DataFrame, targets: list[str], rounds: int = 12, least: int = 5, longest: int = 2) -> DataFrame:
    """doc_id, rank, src, dst, n: what each document stores for what, learned from its own distinct words (doc_id, word).

    As learn_swaps, but for all documents at once: in each round every document takes the exchange that makes the most of its
    unknown words known, while that helps `least` words; ties go to the shorter source, then the smaller source and target.
    A document whose round finds none is left alone. Nothing comes to the driver but whether any document learned."""
    n = F.char_length("now")
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring("now", i, F.lit(k)))
    pieces = F.array_distinct(F.flatten(F.array(*map(cut, range(1, longest + 1)))))
    lex = staged(lex.select("word").distinct(), "lexicon")
    bits = lexicon.hash_bits(lex)
    now = staged(words.select("doc_id", F.col("word").alias("given"), F.col("word").alias("now")).distinct(), "document-words")
    learned = None
    for rank in range(1, rounds + 1):
        open_ = now.join(lex.select(F.col("word").alias("now")), "now", "left_anti")
        tried = open_.select("doc_id", "given", "now", F.explode(pieces).alias("src")).select("doc_id", "given", "src", F.explode(F.array(*map(F.lit, targets))).alias("dst"), "now").where("src <> dst")
        tried = tried.select("doc_id", "given", "src", "dst", F.replace("now", F.col("src"), F.col("dst")).alias("word"))
        gains = lexicon.possible(tried, bits).join(lex, "word", "left_semi").groupBy("doc_id", "src", "dst").agg(F.countDistinct("given").alias("n")).where(F.col("n") >= least)
        first = F.min(F.struct((-F.col("n")).alias("less"), F.char_length("src").alias("size"), "src", "dst"))
        best = gains.groupBy("doc_id").agg(first.alias("b")).select("doc_id", F.lit(rank).alias("rank"), "b.src", "b.dst", (-F.col("b.less")).alias("n"))
        best = staged(best, "document-swaps")
        if best.isEmpty():
            return best if learned is None else learned
        learned = best if learned is None else learned.unionByName(best)
        known = now.join(lex.select(F.col("word").alias("now"), F.lit(True).alias("known")), "now", "left")
        swapped = known.join(best.select("doc_id", "src", "dst"), "doc_id")  # documents that have learned nothing more are done
        now = staged(swapped.select("doc_id", "given", F.when(F.col("known"), F.col("now")).otherwise(F.replace("now", F.col("src"), F.col("dst"))).alias("now")), "document-words")
    return learned

"""Which shown characters gave which real ones: maps carried through rewriting rules, and the real text of any range of a line."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import devanagari as deva
from ..functions.keymaps import key_table

Span = tuple[int, int]
AKSHARAS = "array<struct<text:string,a:int,b:int>>"


@cache
def _compiled(rules: tuple[tuple[str, str], ...]) -> list[tuple[re.Pattern, list[str | int]]]:
    """Patterns, and replacements as literal characters and numbers of groups."""
    return [(re.compile(p), [int(x[1:]) if x[0] == "$" else x for x in re.findall(r"\$\d|\\?[\s\S]", new)]) for p, new in rules]


def traced(chars: list[str], spans: list[Span], rules: deva.Rules) -> tuple[list[str], list[Span]]:
    """Characters rewritten by ordered rules, each still with the range of the shown text that it came from: what a group
    of the replacement repeats keeps its ranges, and what is written anew has that of the whole match."""
    for pattern, new in _compiled(tuple(rules)):
        text = "".join(chars)
        if not pattern.search(text):
            continue
        out, ranges, at = [], [], 0
        for m in pattern.finditer(text):
            a, b = m.span()
            out += chars[at:a]
            ranges += spans[at:a]
            around = spans[a:b] or spans[max(0, a - 1) : a] or [(0, 0)]
            whole = min(x for x, _ in around), max(y for _, y in around)
            for part in new:
                i, j = m.span(part) if isinstance(part, int) else (0, 0)
                out += chars[i:j] if isinstance(part, int) else [part[-1]]
                ranges += spans[i:j] if isinstance(part, int) else [whole]
            at = b
        chars, spans = out + chars[at:], ranges + spans[at:]
    return chars, spans


def key_map(word: str, encoding: str = "preeti") -> list[tuple[str, int, int]]:
    """The orthographic syllables of a key word's real text, each with the range of keys that it came from, as from_keys()
    reads it. Neighbours may share keys, as a sign typed behind its syllable's neighbour does."""
    table = key_table(encoding)
    drawn = [(x, (i, i + 1)) for i, key in enumerate(word) for x in table.get(key, key)]
    chars, spans = traced([x for x, _ in drawn], [s for _, s in drawn], deva.WORD_RULES + deva.NFC)
    out, at = [], 0
    for syllable in re.findall(deva.AKSHARA, "".join(chars)):
        here = spans[at : at + len(syllable)]
        out.append((syllable, min(a for a, _ in here), max(b for _, b in here)))
        at += len(syllable)
    return out


def word_maps(words: DataFrame, encoding: str = "preeti") -> DataFrame:
    """word, aksharas: distinct key words with the map of each, worked out once a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps = [[{"text": t, "a": a, "b": b} for t, a, b in key_map(w, encoding)] for w in batch["word"]]
            yield pd.DataFrame({"word": batch["word"], "aksharas": maps})

    return words.where("word IS NOT NULL").select("word").distinct().mapInPandas(run, f"word string, aksharas {AKSHARAS}")


def line_maps(lines: DataFrame, encoding: str = "preeti") -> DataFrame:
    """doc_id, item, at, stop, shown, aksharas: the pieces of lines (doc_id, item, text) in key text, words and the white space between
    them, with the places where they begin and end and the map of each. White space is its own syllable, as a whole."""
    pieces = lines.select("doc_id", "item", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+|\s+"), 0)).alias("pos", "shown"))
    stop = F.sum(F.char_length("shown")).over(Window.partitionBy("doc_id", "item").orderBy("pos")).cast("int")
    pieces = pieces.withColumn("stop", stop).withColumn("at", F.col("stop") - F.char_length("shown"))
    maps = word_maps(pieces.select(F.col("shown").alias("word")), encoding).withColumnRenamed("word", "shown")
    own = F.array(F.struct(F.col("shown").alias("text"), F.lit(0).alias("a"), F.char_length("shown").alias("b")))
    return pieces.join(maps, "shown").select("doc_id", "item", "at", "stop", "shown", F.when(F.col("shown").rlike(r"^\s"), own).otherwise(F.col("aksharas")).alias("aksharas"))


def _in_order(key: str, value: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]), "")


def range_texts(maps: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (doc_id, item, offset, length) of lines with real: the real text of the syllables that the range touches, in order,
    and from_, to: the shown range that these came from. Pieces and ranges meet on their line; ranges beyond a line's end have
    no row. White space is cut to the range."""
    met = maps.join(ranges, ["doc_id", "item"]).where((F.col("at") < F.col("offset") + F.col("length")) & (F.col("stop") > F.col("offset")))
    a, b = F.col("offset") - F.col("at"), F.col("offset") + F.col("length") - F.col("at")
    hit = F.filter("aksharas", lambda x: (x["a"] < b) & (x["b"] > a))
    cut = F.substring("shown", F.greatest(a, F.lit(0)) + 1, F.least(b, F.char_length("shown")) - F.greatest(a, F.lit(0)))
    blank = F.col("shown").rlike(r"^\s")
    rows = met.withColumns({"hit": hit, "text": F.when(blank, cut).otherwise(F.array_join(F.transform(hit, lambda x: x["text"]), ""))}).where(F.size("hit") > 0)
    lo = F.when(blank, F.greatest(F.col("offset"), F.col("at"))).otherwise(F.col("at") + F.array_min(F.transform("hit", lambda x: x["a"])))
    hi = F.when(blank, F.least(F.col("offset") + F.col("length"), F.col("stop"))).otherwise(F.col("at") + F.array_max(F.transform("hit", lambda x: x["b"])))
    return rows.groupBy("doc_id", "item", "offset", "length").agg(_in_order("at", F.col("text")).alias("real"), F.min(lo).alias("from_"), F.max(hi).alias("to"))


def word_around(maps: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, item, offset) of lines with at, stop and shown of the word that stands there, and its real text; a place in
    white space belongs to no word and has no row."""
    met = maps.join(places, ["doc_id", "item"]).where((F.col("at") <= F.col("offset")) & (F.col("offset") < F.col("stop")) & ~F.col("shown").rlike(r"^\s"))
    return met.select("doc_id", "item", "offset", "at", "stop", "shown", F.array_join(F.transform("aksharas", lambda x: x["text"]), "").alias("real"))

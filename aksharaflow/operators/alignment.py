"""Alignment of shown with real text: words of a line, then characters of a word; what stands for what is counted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import devanagari as deva
from ..functions.staging import staged

KEPT, SWAPPED, LEFT_OUT, PUT_IN = range(4)
#: Distinct pairs of words that a task holds before it hands them on.
HELD = 100_000


def _stretches(at: Iterator[int]) -> list[tuple[int, int, int, int]]:
    """Ascending places that differ in both, as stretches."""
    out: list[tuple[int, int, int, int]] = []
    for i in at:
        if out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1, out[-1][2], i + 1)
        else:
            out.append((i, i + 1, i, i + 1))
    return out


def align(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """Stretches (i1, i2, j1, j2) in which a and b differ, in order, by an alignment with the fewest edits: an exchange, a
    removal or an insertion costs 1. Ties keep or exchange first, then remove, seen from the end. What both begin and
    end with is set aside first.

    Equally many words are compared place by place first: that costs the fewest edits if two places differ at most, or if no word of
    the places that differ is in both, as then no alignment keeps more. Otherwise only cells are worked out that an alignment no dearer
    than the one place by place may pass, row by row, and one byte a cell is kept for the way back."""
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(x), len(y)
    apart = [i for i, (v, w) in enumerate(zip(x, y, strict=False)) if v != w]
    if n == m and (len(apart) <= 2 or {x[i] for i in apart}.isdisjoint(y[i] for i in apart)):
        return _stretches(head + i for i in apart)
    longer = m - n
    most = abs(longer) + min(len(apart), sum(v != w for v, w in zip(reversed(x), reversed(y), strict=False)))
    low, high = -((most - longer) // 2), (most + longer) // 2  # of j - i: further off, more is put in and left out than that
    number: dict = {}
    codes = [np.array([number.setdefault(v, len(number)) for v in part], np.int64) for part in (x, y)]
    step = np.empty((n + 1, high - low + 1), np.uint8)
    step[0] = PUT_IN
    along = np.arange(m + 1)
    cost = np.where(along <= high, along, n + m + 1)
    for i in range(1, n + 1):
        j0, j1 = max(0, i + low), min(m, i + high)
        edge = int(j0 == 0)  # the cell before the first word, which all of a is left out for
        same = codes[1][j0 - 1 + edge : j1] == codes[0][i - 1]
        over = cost[j0 - 1 + edge : j1] + ~same
        down = cost[j0 : j1 + 1] + 1
        best = np.minimum(over, down[edge:])
        if edge:
            best = np.concatenate([[i], best])
        here = along[j0 : j1 + 1]
        new = np.minimum.accumulate(best - here) + here  # an insertion continues from the cell before
        row = step[i, j0 - i - low : j1 - i - low + 1]
        row[:edge] = LEFT_OUT
        row[edge:] = np.where(over == new[edge:], np.where(same, KEPT, SWAPPED), np.where(down[edge:] == new[edge:], LEFT_OUT, PUT_IN))
        cost[j0 : j1 + 1] = new
    ways, i, j = [], n, m
    while i or j:
        way = int(step[i, j - i - low])
        ways.append(way)
        i, j = i - (way != PUT_IN), j - (way != LEFT_OUT)
    out, i, j, at = [], head, head, None
    for way in [*reversed(ways), KEPT]:
        if way != KEPT and at is None:
            at = i, j
        elif way == KEPT and at is not None:
            out.append((at[0], i, at[1], j))
            at = None
        i, j = i + (way != PUT_IN), j + (way != LEFT_OUT)
    return out


def _lists(column: pa.ListArray) -> Iterator[list[str]]:
    """The lists of a column without nulls."""
    at, values = column.offsets.to_numpy().tolist(), column.values.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes an object of Arrow's for each
    return (values[i:j] for i, j in zip(at, at[1:], strict=False))


def word_pairs(lines: DataFrame) -> DataFrame:
    """shown, real, n: words that stand for each other in lines (shown, real: arrays of words), from stretches of equally many
    words on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()
        full = lambda: pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], "string"), pa.array([r for _, r in held], "string"), pa.array(held.values(), "int64")], ["shown", "real", "n"])
        for batch in batches:
            for a, b in zip(*map(_lists, batch.columns), strict=True):
                for i1, i2, j1, j2 in align(a, b):
                    if i2 - i1 == j2 - j1:
                        held.update(zip(a[i1:i2], b[j1:j2], strict=True))
                if len(held) >= HELD:
                    yield full()
                    held.clear()
        if held:
            yield full()

    return lines.where(F.col("shown").isNotNull() & F.col("real").isNotNull()).select("shown", "real").mapInArrow(run, "shown string, real string, n long").groupBy("shown", "real").agg(F.sum("n").alias("n"))


def confused(pairs: DataFrame, ratio: float = 0.6, longest: int = 3) -> DataFrame:
    """src, dst, n: pieces of shown words that stand for pieces of real ones, over distinct pairs (shown, real, n). Pairs whose
    aligned characters are under `ratio` of both words, and pieces of more than `longest` characters, don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, n in zip(batch["shown"], batch["real"], batch["n"], strict=True):
                parts = align(a, b)
                same = len(a) - sum(i2 - i1 for i1, i2, _, _ in parts)
                if 2 * same >= ratio * (len(a) + len(b)):
                    rows += [(a[i1:i2], b[j1:j2], n) for i1, i2, j1, j2 in parts if i2 - i1 <= longest and j2 - j1 <= longest]
            yield pd.DataFrame(rows, columns=["src", "dst", "n"])

    return pairs.select("shown", "real", "n").mapInPandas(run, "src string, dst string, n long").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def learn_confusions(lines: DataFrame, lexicon: DataFrame, least: int = 2) -> DataFrame:
    """src, dst, n: what a damaged text layer shows for what, from lines (shown, real) of the same page, by count.

    Words are what white space separates, without punctuation at their ends. Words that stand for each other count if the
    lexicon (word) has the real one and not the shown one. They are compared in the order on screen, in which a vowel
    sign drawn before its letters comes before them. Confusions seen fewer than `least` times are left out, as are
    insertions alone: a confusion has to have something that it is shown by."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<!\S)[\p{P}।॥•]+|[\p{P}।॥•]+(?!\S)", "")
    words = lambda c: F.filter(F.split(bare(c), r"\s+"), lambda w: w != "")
    pairs = word_pairs(lines.select(words(F.col("shown")).alias("shown"), words(F.col("real")).alias("real")))
    lex = staged(lexicon.select("word").distinct(), "lexicon")
    pairs = pairs.join(lex.withColumnRenamed("word", "real"), "real", "left_semi").join(lex.withColumnRenamed("word", "shown"), "shown", "left_anti")
    seen = confused(pairs.select(deva.to_visual(F.col("shown")).alias("shown"), deva.to_visual(F.col("real")).alias("real"), "n"))
    return seen.where((F.col("n") >= least) & (F.col("src") != "")).orderBy(F.desc("n"), "src", "dst")

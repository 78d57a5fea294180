"""Mixing sources to target weights: whole passes, then subset sums over the length histogram."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, staged

#: Words of a source's budget that are left to the exact knapsack after the proportional fill.
KNAPSACK = 1 << 15
#: Documents that a bucket of one length should hold at most, on average, when documents are ranked.
BUCKET = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: pd.DataFrame, weights: tuple[float, ...], share: float, most: float) -> pd.DataFrame:
    """sizes: source (by code point, null last), source_size. Adds target: weights repeat over the sources and share the
    given part of all words; a source stops at most times its size, and what is over goes to the others by weight."""
    size = sizes["source_size"].to_numpy(np.float64)
    weight = np.resize(np.array(weights, np.float64), len(size))
    target, open_, left = np.zeros(len(size)), size > 0, share * size.sum()
    while open_.any() and left > 0:
        want = np.where(open_, left * weight / weight[open_].sum(), 0)
        full = open_ & (want >= most * size)
        if not full.any():
            target = np.where(open_, want, target)
            break
        target[full] = most * size[full]
        left -= target[full].sum()
        open_ &= ~full
    return sizes.assign(target=target)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their sizes sum to the budget or as near below as found.

    Takes the same part of each length first, then fills up longest first, down to a rest of at most KNAPSACK words;
    a bounded knapsack by dynamic programming (a bit per reachable sum) fits the rest."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = (counts * max(0, budget - KNAPSACK) // max(1, total)).astype(np.int64)
    left = budget - int((take * lengths).sum())
    order = np.argsort(-lengths)
    for k in order:
        if left <= KNAPSACK:
            break
        n = min(int(counts[k] - take[k]), (left - KNAPSACK) // int(lengths[k]))
        take[k], left = take[k] + n, left - n * int(lengths[k])
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for k in order:
        n, part = min(int(counts[k] - take[k]), left // int(lengths[k])), 1
        while n > 0:  # binary splitting: 1, 2, 4 … documents of a length at once
            part = min(part, n)
            steps.append((k, part, reach))
            reach |= (reach << (part * int(lengths[k]))) & mask
            n, part = n - part, 2 * part
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> at & 1:
            take[k], at = take[k] + part, at - part * int(lengths[k])
    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), and
    row_col, if given, a column that tells rows apart where ids repeat.

    Each source gets whole passes over all its documents, as many as its target holds; the rest of the target is a
    subset sum over its histogram of document sizes. Of each size the documents with the smallest seeded hash of
    their id are taken. No document is taken more than most times. Null texts have size 0 and are never taken; null
    sources are one source, the last; reruns agree. An empty table gives no rows.

    The histogram has a row for each source and distinct size. A source's histogram is fitted in one task: sizes up to
    L words make at most L rows. Documents are ranked in buckets of one size that hold BUCKET of them, so that a
    size that many documents share is spread."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("row")), "mix-sizes").withColumn("k", key)
    hist = rows.groupBy("k", "size").agg(F.first("source").alias("source"), F.count("*").alias("docs"))

    def plan(batch: pd.DataFrame) -> pd.DataFrame:
        order = batch.assign(code=[[ord(c) for c in k] for k in batch["k"]]).sort_values(by="code", key=lambda s: s.map(tuple))
        order = pd.concat([order[order["k"] != "-"], order[order["k"] == "-"]]).reset_index(drop=True)
        return targets(order[["k", "source_size"]], weights, share, most)

    totals = hist.groupBy("k").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    totals = totals.groupBy().applyInPandas(plan, "k string, source_size long, target double")  # a row per source

    def choose(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        total, target = int(batch["source_size"].iloc[0]), float(batch["target"].iloc[0])
        passes = min(int(most), int(target // total)) if total else 0
        some = batch["size"].to_numpy() > 0
        extra = np.zeros(len(batch), np.int64)
        if passes < most and total:
            extra[some] = fit(batch["size"].to_numpy(np.int64)[some], batch["docs"].to_numpy(np.int64)[some], round(target) - passes * total)
        return batch.assign(passes=passes, extra=extra)[["k", "size", "source_size", "target", "passes", "docs", "extra"]]

    chosen = staged(hist.join(totals, "k").groupBy("k").applyInPandas(choose, "k string, size long, source_size long, target double, passes int, docs long, extra long"), "mix-plan")
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    rows = rows.join(chosen, ["k", "size"])
    rows = rows.withColumn("hash", hashed).withColumn("bucket", (F.col("hash") * (1 + F.col("docs") / BUCKET).cast("long") / (1 << 40)).cast("long"))
    rows = rows.select("doc_id", "row", "source", "k", "size", "source_size", "target", "passes", "docs", "extra", "hash", "bucket")
    # Documents in buckets before the one where the count is reached are in, those after it are out; in it they are ranked.
    fill = rows.where("extra > 0 AND extra < docs").groupBy("k", "size", "bucket").agg(F.count("*").alias("here"), F.first("extra").alias("extra"))
    before = F.sum("here").over(Window.partitionBy("k", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    fill = fill.select("k", "size", "bucket", (F.col("extra") - F.coalesce(before, F.lit(0))).alias("room"))
    rank = F.row_number().over(Window.partitionBy("k", "size", "bucket").orderBy("hash", "doc_id", "row"))
    rows = rows.join(fill, ["k", "size", "bucket"], "left").withColumn("rank", rank)
    once = F.when(F.col("extra") >= F.col("docs"), 1).when(F.col("rank") <= F.col("room"), 1).otherwise(0)
    return rows.select("doc_id", "source", *([F.col("row").alias(row_col)] if row_col else []), "size", "source_size", "target", (F.col("size") * (F.col("passes") + once)).alias("taken"))

"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged

#: Vectors in a block at most, and queries in a group on average.
ROWS, QUERIES = 2048, 1024
#: Blocks that a group of queries meets in one task, on average.
SLOT = 16
#: Steps of the length of a block's longest vector, per power of two, by which groups find the blocks they need.
STEPS = 64
#: Blocks with the longest vectors that every query sees before any block is pruned.
SEEDS = 2
#: Leading components that are rotated; longer vectors keep the rest as it is, and bounds stay exact.
ROTATED = 1024
LONG = 2**63 - 1


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond 63 bits they stop at the ends of that range."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)


def _best(query: np.ndarray, row: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query, ties to the smaller id, then to the smaller row."""
    order = np.lexsort((row, other, -score, query))
    query, row, other, score = query[order], row[order], other[order], score[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = rank < k
    return pd.DataFrame({"query": query[keep], "row": row[keep], "vec_id": other[keep], "score": score[keep], "rank": (rank[keep] + 1).astype(np.int32)})


def _usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(scale: float) -> Column:
    return F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))


BLOCK = "block long, top double, rows binary, ids binary, short boolean, ints binary"


def numbered(vectors: DataFrame, queries: Column, scale: float = 1024.0) -> DataFrame:
    """Usable rows of vectors (vec_id, embedding) with a number of their own: row, vec_id, x (integers), asks."""
    rows = vectors.where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), _integers(scale).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Packs numbered rows by descending length: blocks of at most ROWS vectors as integers.

    Ranges of (length, id) are dealt to tasks, so that equal vectors, however many, are split as well. A block's number is
    its own, made of the task and a count: its ids may begin other blocks too."""
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = rows.select("row", "vec_id", "x", norm.alias("norm")).repartitionByRange(F.desc("norm"), "vec_id", "row").sortWithinPartitions(F.desc("norm"), "vec_id", "row")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                ints = np.zeros((len(part), dims), np.int64)
                for i, v in enumerate(part["x"]):
                    ints[i, : len(v)] = v
                ids, at_rows = part["vec_id"].to_numpy(np.int64), part["row"].to_numpy(np.int64)
                ints = ints if np.abs(ints).max(initial=0) >= 2**31 else ints.astype(np.int32)
                yield pd.DataFrame({"block": [block], "top": [float(np.sqrt(part["norm"].max()))], "rows": [at_rows.tobytes()], "ids": [ids.tobytes()], "short": [ints.dtype == np.int32], "ints": [ints.tobytes()]})
                block += 1

    return rows.mapInPandas(gather, BLOCK)


def _ints(ids: bytes, short: bool, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(data, np.int32 if short else np.int64).reshape(len(found), -1).astype(np.int64)


def rotation(packed: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the leading components of all vectors, strongest first, from the sum of the blocks' Gram
    matrices: at most ROTATED x ROTATED numbers come to the driver."""
    dims = min(dims, ROTATED)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for row in zip(batch["ids"], batch["short"], batch["ints"], strict=True):
                x = _ints(*row)[1][:, :dims].astype(np.float64)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dims), "row": list(total)})

    sums = packed.select("ids", "short", "ints").mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dims, dims))
    for r in sums:
        total[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    out = x.astype(np.float64)
    out[:, : len(turn)] = out[:, : len(turn)] @ turn
    return out


def _groups(needs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(step, first group, groups) of (step of need, queries): groups of about QUERIES, of like needs."""
    out, group, room = [], 0, QUERIES
    for step, n in sorted(needs):
        if n >= QUERIES:
            group += room < QUERIES
            several = -(-n // QUERIES)
            out.append((step, group, several))
            group, room = group + several, QUERIES
            continue
        if n > room:
            group, room = group + 1, QUERIES
        out.append((step, group, 1))
        room -= n
    return out


HITS = "query long, row long, vec_id long, score long, rank int"


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector where queries holds, the k others with the largest inner products.

    Components become floor(scale * x). Vectors that are null, or hold null or non-finite components, take no part, nor
    do rows without an id; shorter vectors are padded with zeros, and vectors may be of any length. Rows that repeat an
    id are queries of their own, each with its ranks, and find each other: only a query's own row is left out. Ties go to the
    smaller id. Scores beyond 63 bits stop at the ends of that range. Other columns are ignored. An empty table gives no rows.

    Every query first sees the SEEDS blocks with the longest vectors, which gives it a bound to beat: the length a vector
    needs at least is that bound over the query's own length. Queries are then grouped by what they need, about QUERIES in a
    group, and a group meets the blocks whose longest vector reaches the least need in it; only those are shuffled to it,
    in slots of about SLOT blocks. In a task blocks come by descending length, a block is left out if its
    longest vector can't reach a query's bound, and within it partial sums over the leading singular directions plus the
    Cauchy-Schwarz bound of the rest leave few vectors to be multiplied exactly. A bound must be missed by more than
    rounding can explain. The bound of a query rises as its task finds better vectors."""
    spark = vectors.sparkSession
    rows = staged(numbered(vectors, queries, scale), "vectors")
    dims, n_queries = rows.agg(F.max(F.size("x")), F.count_if("asks")).head()
    packed = staged(blocks(rows, dims or 0), "blocks")
    n_blocks = packed.count()
    if not dims or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn, lead = rotation(packed, dims), max(1, min(dims, ROTATED) // 4)
    n_groups = -(-n_queries // QUERIES)
    n_slots = max(-(-n_blocks // SLOT), min(n_blocks, -(-partitions(spark) // n_groups)))

    def search(key: tuple, asked: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        none = _best(*np.zeros((4, 0), np.int64), k)
        if not len(asked) or not len(met):
            return none
        q_rows, q = asked["row"].to_numpy(np.int64), np.zeros((len(asked), dims), np.int64)
        for i, v in enumerate(asked["x"]):
            q[i, : len(v)] = v
        floor = asked["kth"].fillna(-np.inf).to_numpy(np.float64).copy()
        qf = _turned(q, turn)
        q_norm, q_rest = np.sqrt((qf**2).sum(1)), np.sqrt((qf[:, lead:] ** 2).sum(1))
        found = none
        for r in met.sort_values("top", ascending=False).itertuples():
            slack = 1e-9 * q_norm * r.top + 1e-6
            alive = np.flatnonzero(q_norm * r.top + slack >= floor)
            if not len(alive):
                continue
            (ids, x), x_rows = _ints(r.ids, r.short, r.ints), np.frombuffer(r.rows, np.int64)
            xf = _turned(x, turn)
            rest = np.sqrt((xf[:, lead:] ** 2).sum(1))
            bound = qf[alive, :lead] @ xf[:, :lead].T + q_rest[alive, None] * rest[None, :] + slack[alive, None]
            maybe = (bound >= floor[alive, None]) & (q_rows[alive, None] != x_rows[None, :])
            some = np.flatnonzero(maybe.any(0))
            i, j = np.nonzero(maybe[:, some])
            score = _dot(q[alive], x[some])
            new = pd.DataFrame({"query": q_rows[alive][i], "row": x_rows[some][j], "vec_id": ids[some][j], "score": score[i, j]})
            both = pd.concat([found[["query", "row", "vec_id", "score"]], new])
            found = _best(*(both[c].to_numpy(np.int64) for c in ("query", "row", "vec_id", "score")), k)
            full = found[found["rank"] == k].set_index("query")["score"]
            floor = np.maximum(floor, full.reindex(q_rows).fillna(-np.inf).to_numpy(np.float64))
        return found

    each = F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int")
    asked = rows.where("asks").select(each.alias("group"), "row", "vec_id", "x")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group")
    seeds = staged(packed.orderBy(F.desc("top"), "block").limit(SEEDS), "seeds")
    first = asked.withColumn("kth", F.lit(None).cast("double")).groupBy("group").cogroup(seeds.select("*", every).groupBy("group")).applyInPandas(search, HITS)
    first = staged(first, "seed-hits")

    kth = first.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("kth"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double")))
    # The least length of a vector that can reach a query's bound; 0 if it has no bound yet.
    need = F.when((F.coalesce("kth", F.lit(0.0)) <= 0) | (norm == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("kth") - 1e-6) / norm * (1 - 1e-8)))
    step = lambda c: F.floor(STEPS * F.log2(1 + c)).cast("int")
    asked = staged(asked.join(kth, "row", "left").withColumn("need", need).withColumn("at", step(F.col("need"))).drop("group"), "queries")
    plan = spark.createDataFrame(_groups([(r["at"], r["n"]) for r in asked.groupBy("at").agg(F.count("*").alias("n")).collect()]), "at int, first int, groups int")
    asked = asked.join(F.broadcast(plan), "at").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("groups"))).cast("int"))  # a row per step
    need = asked.groupBy("group").agg(F.min("need").alias("need"))
    slot = F.pmod(F.xxhash64("block"), F.lit(n_slots)).cast("int").alias("slot")
    others = packed.join(seeds.select("block"), "block", "left_anti")
    slim = staged(others.select("block", "top", step(F.col("top")).alias("step"), slot), "block-tops")
    most = slim.agg(F.max("step")).head()[0]
    hits = first
    if most is not None:
        tops = need.where(step(F.col("need")) <= most).select("group", "need", F.explode(F.sequence(step(F.col("need")), F.lit(most))).alias("step"))
        met = staged(tops.join(slim, "step").where(F.col("top") >= F.col("need")).select("group", "slot", "block"), "blocks-met")
        asked = asked.select("group", "row", "x", "kth").join(met.select("group", "slot").distinct().toDF("group", "slot"), "group")
        hits = hits.unionByName(asked.groupBy("group", "slot").cogroup(met.join(packed, "block").groupBy("group", "slot")).applyInPandas(search, HITS))
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("rank") <= k)
    ids = rows.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query").select("query_id", "rank", "vec_id", "score")

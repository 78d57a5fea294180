"""Vector code compression: product codes by Lloyd rounds whose members stay with the owner of their entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, partitions, staged

LONG = 2**63 - 1
PART = "row long, pos int, x array<long>, entry int, was int, err long"


def _usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each integer row and its squared distance, ties to the lower index; exact, as numbers that 53 or 63
    bits can't hold are worked out as Python's integers, and distances then stop at 63 bits."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)), int(codebook.max(initial=0)), -int(codebook.min(initial=0)))
    most = 4 * top * top * max(1, x.shape[1])
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    a, b = x.astype(kind), codebook.astype(kind)
    away = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    entry = np.argmin(away, 1)
    best = away[np.arange(len(x)), entry]
    return entry.astype(np.int32), np.array([min(int(v), LONG) for v in best], np.int64) if kind is object else best.astype(np.int64)


def _assign(books: list[np.ndarray]):
    """A function for mapInPandas that gives each part its nearest entry; what it had is in was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entry, err = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            pos = batch["pos"].to_numpy()
            for p in np.unique(pos):
                here = np.flatnonzero(pos == p)
                entry[here], err[here] = nearest(np.stack(batch["x"].iloc[here].to_list()), books[p])
            yield batch.assign(was=batch["entry"], entry=entry, err=err)[["row", "pos", "x", "entry", "was", "err"]]

    return run


def _resident_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each entry, the members of this task: how many, and the sums of the high and low 32 bits of their components."""
    total: dict[tuple[int, int], list] = {}
    for batch in batches:
        for key, members in batch.groupby(["pos", "entry"])["x"]:
            x = np.stack(members.to_list())
            held = total.setdefault(key, [0, 0, 0])
            held[0], held[1], held[2] = held[0] + len(x), held[1] + (x >> 32).sum(0), held[2] + (x & 0xFFFFFFFF).sum(0)
    yield pd.DataFrame([(*k, n, list(high), list(low)) for k, (n, high, low) in total.items()], columns=["pos", "entry", "n", "high", "low"])


def _updated(books: list[np.ndarray], members: DataFrame) -> list[np.ndarray]:
    """New entries as the mean of their members, rounded down. A row per entry comes to the driver: the size of the codebooks."""
    parts = members.select("pos", "entry", "x").mapInPandas(_resident_sums, "pos int, entry int, n long, high array<long>, low array<long>")
    wide = books[0].shape[1]
    sums = lambda c: [F.sum(F.get(c, F.lit(i)).cast("decimal(38,0)")) for i in range(wide)]
    new = [b.copy() for b in books]
    for r in parts.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*sums("high")).alias("high"), F.array(*sums("low")).alias("low")).collect():
        new[r["pos"]][r["entry"]] = [((int(h) << 32) + int(low)) // r["n"] for h, low in zip(r["high"], r["low"], strict=True)]
    return new


def _owned(moving: DataFrame, every: DataFrame) -> DataFrame:
    """Parts that move, at the owners of their entries: tables dealt by (position, entry, salt). An entry has an owner for each
    task's share of all parts that its members make up, so that none has much more than a share; a row per entry is broadcast."""
    share = max(1.0, every.count() / partitions(every.sparkSession))
    owners = every.groupBy("pos", "entry").agg(F.ceil(F.count("*") / share).alias("owners"))
    salt = F.pmod(F.xxhash64("row"), F.col("owners")).cast("int")
    moving = moving.join(F.broadcast(owners), ["pos", "entry"]).select("row", "pos", "x", "entry", salt.alias("salt"))
    return staged(moving.repartition("pos", "entry", "salt").drop("salt"), "members")


def compress(vectors: DataFrame, scale: float = 1024.0, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", extra: tuple[str, ...] = ()) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors, a row for each (id_col, the columns of extra, code, error), and the codebooks, an array per part.

    Components become floor(scale * x), within 63 bits; vectors are cut into equal consecutive parts, shorter ones (empty ones
    too) are filled up with zeros, as are all if the longest can't be cut evenly. A codebook starts as that part of the vectors
    with the smallest ids (then by content; null ids last), at most `entries` of them. A round assigns each part to the nearest
    entry, ties to the lower index, and moves each entry to the floor of its members' mean; entries without members stay. code
    has two hex digits (more, if entries need them) per part, error is the sum of its final squared distances, which stop at 63 bits.
    Vectors that are null, or hold null or non-finite components, are left out. Rows that repeat an id are rows of their own.
    An empty table gives no rows and no codebooks.

    Parts lie with the owner of their entry: tables dealt by (position, entry, salt), where the salt splits entries that have
    more members than a task's share. A round reads members where they lie, sums them up there, and shuffles only those whose entry changed.
    The driver sees codebooks and a sum per entry, entries x dimensions numbers, however many vectors there are."""
    vec = F.col(vec_col)
    kept = vectors.where(_usable(vec)).select(F.col(id_col).alias("id"), *(F.col(c).alias(f"extra_{c}") for c in extra), F.transform(vec, lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    kept = staged(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dims = kept.agg(F.count("*"), F.max(F.size("x"))).head()
    if not n:
        return kept.select(F.col("id").alias(id_col), *(F.col(f"extra_{c}").alias(c) for c in extra), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    wide = max(1, -(-dims // parts))
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(wide * parts) - F.size("x")))
    first = kept.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select(padded.alias("x")).collect()
    start = np.array([r["x"] for r in first], np.int64)
    books = [start[:, p * wide : (p + 1) * wide] for p in range(parts)]

    cut = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("pos")
    pieces = kept.select("row", padded.alias("all"), cut).select("row", "pos", F.slice("all", F.col("pos") * wide + 1, wide).alias("x"), F.lit(-1).alias("entry"))
    found = staged(pieces.mapInPandas(_assign(books), PART), "assigned")
    resident = _owned(found, found)
    done = [found, resident]
    for turn in range(rounds):
        books = _updated(books, resident)
        found = staged(resident.select("row", "pos", "x", "entry").mapInPandas(_assign(books), PART), "assigned")
        discard(*done)
        if turn + 1 == rounds:
            break
        arrived = _owned(found.where("entry <> was"), found)
        resident, done = found.where("entry = was").select("row", "pos", "x", "entry").unionByName(arrived.select("row", "pos", "x", "entry")), [found, arrived]
    digits = max(2, len(f"{entries - 1:x}"))
    code = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda c: F.lpad(F.lower(F.hex(c["entry"].cast("long"))), digits, "0")))
    error = F.least(F.sum(F.col("err").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    codes = found.groupBy("row").agg(code.alias("code"), error.alias("error"))
    return kept.drop("x").join(codes, "row").select(F.col("id").alias(id_col), *(F.col(f"extra_{c}").alias(c) for c in extra), "code", "error"), books


def with_group_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over rows with the same key (nulls together) as column name.

    Keys with more rows than two tasks' share are few, at most as many as half the shuffle partitions, so their sums are
    broadcast; the others' meet their rows in a shuffled join."""
    rows = staged(rows, "rows")
    sums = staged(rows.groupBy(key).agg(F.sum(value).alias(name), F.count("*").alias("n")), "sums")
    least = 2 * rows.count() / partitions(rows.sparkSession)
    is_hot, k = free_name(rows, "is_hot"), free_name(rows, "k")
    many = F.broadcast(sums.where(F.col("n") > least).select(F.col(key).alias(k), F.col(name), F.lit(True).alias(is_hot)))
    marked = rows.join(many, rows[key].eqNullSafe(F.col(k)), "left").drop(k)
    others = sums.where(F.col("n") <= least).select(F.col(key).alias(k), F.col(name))
    rest = marked.where(F.col(is_hot).isNull()).drop(name, is_hot)
    return marked.where(is_hot).drop(is_hot).unionByName(rest.join(others, rest[key].eqNullSafe(F.col(k))).drop(k))

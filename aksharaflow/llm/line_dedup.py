"""Reversible line dedup: exact reference counts of lines, with sharded cuckoo filters in front of them."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, free_name, partitions, staged

#: Lines of a shard; an index that outgrows its shards gets more of them.
SHARD_LINES = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets, of which one follows from the other. A key may be
    held several times, at most as often as both its buckets have room."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets, self.table = buckets, np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(keys / 0.8 / cls.SLOTS).bit_length()))

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _spots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = keys.astype(np.uint64) * _MIX[0]
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = ((h >> np.uint64(8)) % np.uint64(self.buckets)).astype(np.int64)
        return mark, one, one ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * _MIX[1]) >> np.uint64(20)).astype(np.int64) & (self.buckets - 1)

    def held(self, keys: np.ndarray) -> np.ndarray:
        """How often each key is held, or more where others look like it."""
        mark, one, two = self._spots(keys)
        return (self.table[one] == mark[:, None]).sum(1) + (self.table[two] == mark[:, None]).sum(1) * (one != two)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        return self.held(keys) > 0

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; it must then be built anew from the exact table. All keys move at once: those
        that find no free slot in either bucket put another one out, one a bucket and round."""
        mark, at, _ = self._spots(keys)
        for turn in range(self.KICKS):
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            first = np.r_[True, at[1:] != at[:-1]][: len(at)]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            full = self.table[at] != 0
            fits = rank < self.SLOTS - full.sum(1)
            self.table[at[fits], np.argsort(full, axis=1, kind="stable")[fits, rank[fits]]] = mark[fits]
            mark, at = mark[~fits], at[~fits]
            if not len(at):
                return True
            if turn:
                _, one = np.unique(at, return_index=True)
                slot = (mark[one] + turn) % self.SLOTS
                mark[one], self.table[at[one], slot] = self.table[at[one], slot], mark[one]
                at[one] ^= self._jump(mark[one])
            else:
                at ^= self._jump(mark)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes each key out once for each time that it is given; keys must have been inserted."""
        mark, one, two = self._spots(keys)
        flat = self.table.reshape(-1)
        while len(mark):
            hit = np.concatenate([self.table[one] == mark[:, None], self.table[two] == mark[:, None]], 1)
            slot = hit.argmax(1)
            spot = np.where(slot < self.SLOTS, one * self.SLOTS + slot, two * self.SLOTS + slot - self.SLOTS)
            there = hit.any(1)
            _, take = np.unique(np.where(there, spot, -1), return_index=True)
            take = take[there[take]]
            flat[spot[take]] = 0
            left = there.copy()
            left[take] = False
            mark, one, two = mark[left], one[left], two[left]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(key: Column) -> Column:
    return F.unhex(F.sha2(key, 256))


def postings(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of a document: key (digest), doc_id. Rows that share an id are one document."""
    keys = F.filter(F.transform(_lines(F.col(text_col)), line_key), lambda k: F.char_length(k) >= min_chars)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_distinct(F.transform(keys, _digest)).alias("keys"))
    again = staged(docs.groupBy(F.col(id_col).alias("doc_id")).count().where("count > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    if again.isEmpty():
        return rows.select(F.explode("keys").alias("key"), "doc_id")
    rows = rows.join(again.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left").select(F.explode("keys").alias("key"), "doc_id", "again")
    return rows.where("again IS NULL").drop("again").unionByName(rows.where("again").select("key", "doc_id").distinct())


@dataclass(frozen=True)
class LineIndex:
    """What is known of the lines of a corpus. insert() and delete() give a new index and leave the old as it was.

    postings: (key, doc_id), each line of each document once. counts: (key, refs, keeper), the exact number of documents
    that hold a line and the largest doc_id of them. filters: (shard, filter), cuckoo filters that hold every line as
    often as there are documents with it, but at most min_docs times: a line that its filter holds less often needs no
    look at the counts. Insertions and deletions change the filters; one that gets too full is built anew from the
    counts, and so are all when lines outgrow the shards. Lines are told apart by SHA-256. Rows that share a doc_id are
    one document; rows without an id are one document too, which can't be deleted and comes before all others."""

    spark: SparkSession
    shards: int
    min_chars: int
    min_docs: int
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    #: Nothing has been inserted yet.
    fresh: bool = False

    @classmethod
    def empty(cls, spark: SparkSession, shards: int | None = None, min_chars: int = 20, min_docs: int = 3) -> LineIndex:
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(spark, shards or partitions(spark), min_chars, min_docs, none("key binary, doc_id long"), none("key binary, refs long, keeper long"), none("shard int, filter binary"), fresh=True)

    def _count(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("keeper"))

    def _sharded(self, rows: DataFrame, *more: Column) -> DataFrame:
        h = F.xxhash64("key")
        return rows.select(F.pmod(h, F.lit(self.shards)).cast("int").alias("shard"), h.alias("h"), *more)

    def _times(self, refs: str) -> Column:
        """How often a filter holds a line that so many documents have."""
        return F.least(F.col(refs), F.lit(self.min_docs)).cast("int")

    def _built(self, counts: DataFrame) -> DataFrame:
        """Filters of all lines of counts."""

        def build(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
            keys = np.repeat(lines["h"].to_numpy(np.int64), lines["now"].to_numpy())
            size, made = len(keys), CuckooFilter.sized(len(keys))
            while not made.insert(keys):
                size = 2 * size + 1
                made = CuckooFilter.sized(size)
            return pd.DataFrame({"shard": [key[0]], "filter": [made.dumps()]})

        return self._sharded(counts, self._times("refs").alias("now")).groupBy("shard").applyInPandas(build, "shard int, filter binary")

    def _changed(self, rows: DataFrame, counts: DataFrame) -> LineIndex:
        """The index with these postings and counts (key, refs, keeper, was: refs before)."""
        now = counts.where("refs > 0").select("key", "refs", "keeper")
        need = -(-counts.count() // SHARD_LINES)
        if need > self.shards or self.filters.isEmpty():
            new = replace(self, fresh=False, postings=rows, counts=now, shards=max(self.shards, 2 * need if need > self.shards else 0))
            return replace(new, filters=staged(new._built(now), "line-filters"))
        moved = self._sharded(counts.where(self._times("was") != self._times("refs")), self._times("was").alias("was"), self._times("refs").alias("now"))

        def update(key: tuple, old: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
            h, more = lines["h"].to_numpy(np.int64), (lines["now"] - lines["was"]).to_numpy(np.int64)
            made = CuckooFilter.loads(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(2 * int(more.clip(0).sum()))
            made.delete(np.repeat(h, (-more).clip(0)))
            return pd.DataFrame({"shard": [key[0]], "filter": [made.dumps() if made.insert(np.repeat(h, more.clip(0))) else None]})

        filters = staged(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, "shard int, filter binary"), "line-filters")
        full = filters.where("filter IS NULL").select("shard")
        if not full.isEmpty():
            again = now.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")).join(full, "shard", "left_semi")
            filters = staged(filters.where("filter IS NOT NULL").unionByName(self._built(again)), "line-filters")
        return replace(self, fresh=False, postings=rows, counts=now, filters=filters)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents (doc_id, text). Lines that the index holds of a document already are left out, so that a batch may be
        inserted again, after a failure, say, and still be deleted once."""
        new = postings(docs, self.min_chars)
        if not self.fresh:
            held = self.postings.select(F.col("key").alias("held"), F.col("doc_id").alias("by"))
            new = new.join(held, (F.col("key") == F.col("held")) & F.col("doc_id").eqNullSafe(F.col("by")), "left_anti")
        new = staged(new, "line-postings")
        both = self.counts.withColumn("was", F.col("refs")).unionByName(self._count(new).withColumn("was", F.lit(0).cast("long")))
        both = both.groupBy("key").agg(F.sum("refs").alias("refs"), F.max("keeper").alias("keeper"), F.sum("was").alias("was"))
        return self._changed(self.postings.unionByName(new), staged(both, "line-counts"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (a column doc_id) out again; lines that only they made frequent come back."""
        ids = doc_ids.select("doc_id").distinct()
        gone = self._count(self.postings.join(ids, "doc_id", "left_semi")).select("key", F.col("refs").alias("less"))
        kept = staged(self.postings.join(ids, "doc_id", "left_anti"), "line-postings")
        again = self._count(kept.join(gone, "key", "left_semi")).select("key", F.col("keeper").alias("next"))
        counts = self.counts.join(gone, "key", "left").join(again, "key", "left")
        counts = counts.select("key", (F.col("refs") - F.coalesce("less", F.lit(0))).alias("refs"), F.when(F.col("less").isNull(), F.col("keeper")).otherwise(F.col("next")).alias("keeper"), F.col("refs").alias("was"))
        return self._changed(kept, staged(counts, "line-counts"))

    def frequent(self, rows: DataFrame) -> DataFrame:
        """Of the lines in postings rows, those that min_docs documents hold: key, keeper. The filter of each shard sees
        its distinct lines, in pieces of about SHARD_LINES; what it lets pass is looked up in the counts, which also ends
        its false positives."""
        pieces, most = max(1, -(-rows.count() // (SHARD_LINES * self.shards))), self.min_docs

        def probe(key: tuple, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            found = CuckooFilter.loads(old["filter"].iloc[0]).held(keys["h"].to_numpy(np.int64)) >= most if len(old) else np.zeros(len(keys), bool)
            return keys.loc[found, ["key"]]

        keys = self._sharded(rows.select("key").distinct(), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(pieces)).cast("int").alias("piece"), F.col("key"))
        filters = self.filters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        passed = keys.groupBy("shard", "piece").cogroup(filters.groupBy("shard", "piece")).applyInPandas(probe, "key binary")
        return passed.join(self.counts.where(F.col("refs") >= self.min_docs), "key").select("key", "keeper")

    def apply(self, docs: DataFrame, counted: bool = True) -> DataFrame:
        """Docs without the frequent lines that another document keeps: all their columns, with text replaced, and, if
        counted, n_lines (before) and n_dropped in place of columns of these names. Null and empty texts are one empty
        line; a text that loses all lines is empty.

        The numbers of the lines to drop come to each row by its id and the hash of its text; what stays are the slices
        between them, so that a text costs as much as it has lines."""
        of, hash_, gone, lines = (free_name(docs, c) for c in ("line_of", "line_hash", "line_gone", "lines"))
        key = line_key(F.col("line"))
        rows = docs.select(F.col("doc_id").alias(of), F.xxhash64("text").alias(hash_), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
        rows = staged(rows.where(F.char_length(key) >= self.min_chars).select(_digest(key).alias("key"), of, hash_, "at"), "line-keys")
        drop = rows.join(staged(self.frequent(rows), "frequent-lines"), "key").where(~F.col(of).eqNullSafe(F.col("keeper")))
        drop = drop.groupBy(of, hash_).agg(F.sort_array(F.collect_set("at")).alias(gone))
        columns = [c for c in docs.columns if not counted or c.lower() not in ("n_lines", "n_dropped")]
        both = docs.join(drop, docs["doc_id"].eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left").withColumn(lines, _lines(F.col("text")))
        last, at = F.size(gone), lambda k: F.element_at(gone, k)
        begin = lambda k: F.when(k == 0, 1).otherwise(at(F.greatest(k, F.lit(1))) + 2)
        stop = lambda k: F.when(k == last, F.size(lines)).otherwise(at(F.least(k + 1, last)))
        left = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(lines, begin(k), stop(k) - begin(k) + 1)))
        text = F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n")).alias("text")
        counts = [F.size(lines).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(last).cast("long").alias("n_dropped")] if counted else []
        return both.select(*[text if c == "text" else F.col(f"`{c}`") for c in columns], *counts)

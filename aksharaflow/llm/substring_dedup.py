"""Substring dedup: fixed blocks as anchors, probed by every rolling window, extended to whole repeated windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, worker_cache

#: Bytes of text that a chunk of documents holds, about, windows that a shard answers for, about, and bytes of a word, about.
CHUNK_BYTES, SHARD_WINDOWS, WORD_BYTES = 6 << 20, 1 << 21, 6
#: Windows that a chunk asks a shard about, at least; both grow, by the square root, as the corpus outgrows that.
ASKED = 16
#: Bits of a window's hash that tell windows of one shard apart when anchors are looked for; a false hit is found out later.
ANCHOR_BITS = 24
#: Words whose hashes a worker keeps from one chunk to the next.
CACHE = 300_000
#: What the hash of a window of words is made of: two sums of word hashes times powers of an odd number.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class _Words(dict):
    """Numbers of the words that a worker has met, and their 128-bit hashes by number."""

    def __init__(self) -> None:
        self.hashes = bytearray()

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.hashes += xxhash.xxh3_128_digest(word)
        self[word] = n = len(self)
        return n

    def of(self, texts: list[list[bytes]], n: int) -> np.ndarray:
        """Two halves of the hash of each of n words."""
        if len(self) >= CACHE:
            self.clear()
            self.hashes = bytearray()
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, n)
        return np.frombuffer(bytes(self.hashes), np.uint64).reshape(-1, 2)[numbers]


def _worker_words() -> _Words:
    cache = worker_cache("substring-words")
    found = cache.get("words")
    return cache.setdefault("words", _Words()) if found is None else found


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Chunk:
    """The words of some documents in a row, and where each document's begin."""

    words: list[list[bytes]]
    lo: np.ndarray
    hi: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Chunk:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        start = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        both = _worker_words().of(words, int(start[-1]))
        return cls(words, both[:, 0].copy(), both[:, 1].copy(), start)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows of that many words of one document start, and two hashes of each."""
        n = len(self.lo)
        at = np.flatnonzero(np.arange(n) + size <= np.repeat(self.start[1:], np.diff(self.start)))
        out = []
        for h, base in ((self.lo, _BASES[0]), (self.hi, _BASES[1])):
            back = _powers(base, n)  # of base: sums run from the end, so that a window's own power can be divided out
            inverse = _powers(np.uint64(pow(int(base), -1, 2**64)), n)
            total = np.concatenate([[np.uint64(0)], np.cumsum(h * back[:n], dtype=np.uint64)])
            out.append(_mixed((total[at + size] - total[at]) * inverse[at]))
        return at, out[0], out[1]


def _pack(values: np.ndarray) -> bytes:
    """Sorted distinct numbers as 16-bit steps; a step of 65535 goes on to the next."""
    steps = np.diff(np.concatenate([[-1], values.astype(np.int64)])) - 1
    far = steps // 65535
    out = np.full(len(steps) + int(far.sum()), 65535, np.uint16)
    out[np.cumsum(far + 1) - 1] = steps % 65535
    return out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16).astype(np.int64)
    last = steps != 65535
    return (np.cumsum(steps + last) - 1)[last]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _of_shards(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Of sorted shard numbers, each shard and its place."""
    cut = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]), strict=True):
        if b > a:
            yield int(owner[a]), slice(int(a), int(b))


@dataclass(frozen=True)
class Repeats:
    """The steps of the search, each a function of a chunk of documents or of a shard of hashes. size: words of a window;
    shards: 2 ** that many of them."""

    size: int
    shards: int

    @property
    def block(self) -> int:
        """Words of a block: every window holds a whole block, wherever it starts."""
        return (self.size + 1) // 2

    def _anchors(self, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """Where rolling windows of a block's size start, their numbers among the distinct ones, these, and which of them are blocks."""
        at, lo, _ = chunk.windows(self.block)
        found, which = np.unique(lo >> np.uint64(64 - self.shards - ANCHOR_BITS), return_inverse=True)
        first = np.repeat(chunk.start[:-1], np.diff(chunk.start))[at]
        blocks = np.zeros(len(found), bool)
        blocks[which[(at - first) % self.block == 0]] = True
        return at, which, found, blocks

    def ask_anchors(self, docs: pd.DataFrame) -> pd.DataFrame:
        """The distinct windows of a chunk, and its blocks, for each shard."""
        _, _, found, blocks = self._anchors(Chunk.of(docs["text"].to_list()))
        key, rows = found & np.uint64(2**ANCHOR_BITS - 1), []
        for shard, here in _of_shards((found >> np.uint64(ANCHOR_BITS)).astype(np.int64)):
            rows.append((shard, int(docs["chunk"].iloc[0]), _pack(key[here]), _pack(key[here][blocks[here]])))
        return pd.DataFrame(rows, columns=["shard", "chunk", "windows", "blocks"])

    def answer_anchors(self, asked: pd.DataFrame) -> pd.DataFrame:
        """For each chunk, which of its windows equal a block and are found in another chunk too."""
        windows = [_unpack(x) for x in asked["windows"]]
        found, times = np.unique(np.concatenate(windows), return_counts=True)
        blocks = np.unique(np.concatenate([_unpack(x) for x in asked["blocks"]]))
        live = np.intersect1d(found[times > 1], blocks, assume_unique=True)
        return pd.DataFrame({"shard": asked["shard"], "chunk": asked["chunk"], "hit": [_bits(np.isin(w, live, assume_unique=True)) for w in windows]})

    def _extended(self, chunk: Chunk, ids: np.ndarray, hits: np.ndarray | None, answers: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Windows of full size about the anchors that were hit elsewhere, or twice in the chunk: where they start, their numbers
        among the distinct ones, and of these shard, hashes and smallest document. Last, the hits."""
        at, which, found, blocks = self._anchors(chunk)
        if hits is None:
            hits, by_shard = np.zeros(len(found), bool), dict(zip(answers["shard"], answers["hit"], strict=True))
            for shard, here in _of_shards((found >> np.uint64(ANCHOR_BITS)).astype(np.int64)):
                hits[here] = _flags(by_shard[shard], here.stop - here.start)
            hits |= blocks & (np.bincount(which, minlength=len(found)) > 1)
        else:
            hits = _flags(hits, len(found))
        near = np.zeros(len(chunk.lo) + 1, np.int64)
        near[at[hits[which]] + 1] = 1
        near = np.cumsum(near)
        start, lo, hi = chunk.windows(self.size)
        live = near[start + self.size - self.block + 1] > near[start]
        start, lo, hi = start[live], lo[live], hi[live]
        doc = ids[np.searchsorted(chunk.start, start, "right") - 1]
        order = np.lexsort((doc, hi, lo))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[new]
        return start, doc, number, lo[lead], hi[lead], doc[lead], hits

    def _shard(self, lo: np.ndarray) -> np.ndarray:
        return (lo >> np.uint64(63 - self.shards) >> np.uint64(1)).astype(np.int64)

    def ask_windows(self, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The distinct windows that may repeat, with their smallest document; a row with the hits goes along, for the last step."""
        names = ["shard", "chunk", "lo", "hi", "doc"]
        if not len(docs):
            return pd.DataFrame([], columns=names)
        number = int(docs["chunk"].iloc[0])
        *_, lo, hi, doc, hits = self._extended(Chunk.of(docs["text"].to_list()), docs["id"].to_numpy(np.int64), None, answers)
        rows = [(-1 - number, number, _bits(hits), b"", b"")]
        owner = self._shard(lo)
        for shard, here in _of_shards(owner):
            order = np.argsort(doc[here], kind="stable")
            rows.append((shard, number, lo[here][order].tobytes(), hi[here][order].tobytes(), doc[here][order].tobytes()))
        return pd.DataFrame(rows, columns=names)

    def answer_windows(self, asked: pd.DataFrame) -> pd.DataFrame:
        """For each chunk, which of its windows start in a smaller document of another chunk."""
        shard = int(asked["shard"].iloc[0])
        if shard < 0:
            return pd.DataFrame({"shard": asked["shard"], "chunk": asked["chunk"], "hit": asked["lo"]})
        joined = lambda c, kind: np.frombuffer(b"".join(asked[c]), kind)
        lo, hi, doc = joined("lo", np.uint64), joined("hi", np.uint64), joined("doc", np.int64)
        order = np.lexsort((doc, hi, lo))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
        least = np.empty(len(order), np.int64)
        least[order] = doc[order][new][np.cumsum(new) - 1]
        lost = np.split(least < doc, np.cumsum([len(x) // 8 for x in asked["doc"]])[:-1])
        return pd.DataFrame({"shard": asked["shard"], "chunk": asked["chunk"], "hit": [_bits(x) for x in lost]})

    def cut(self, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The documents of a chunk without repeated words."""
        names = ["no_id", "id", "n_words", "n_removed", "text", "spans"]
        if not len(docs):
            return pd.DataFrame([], columns=names)
        chunk, by_shard = Chunk.of(docs["text"].to_list()), dict(zip(answers["shard"], answers["hit"], strict=True))
        start, doc, number, lo, _, least, _ = self._extended(chunk, docs["id"].to_numpy(np.int64), by_shard[-1 - int(docs["chunk"].iloc[0])], answers)
        lost = np.zeros(len(lo), bool)
        for shard, here in _of_shards(self._shard(lo)):
            order = np.argsort(least[here], kind="stable")
            lost[np.arange(here.start, here.stop)[order]] = _flags(by_shard[shard], len(order))
        gone = start[lost[number] | (doc > least[number])]
        edge = np.zeros(len(chunk.lo) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.size, -1)
        removed = np.cumsum(edge[:-1]) > 0
        rows = []
        for words, a, no_id, doc_id in zip(chunk.words, chunk.start, docs["no_id"], docs["id"], strict=False):
            out = removed[a : a + len(words)]
            kept = [w for w, x in zip(words, out.tolist(), strict=True) if not x] if out.any() else words
            turns = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))).reshape(-1, 2)
            rows.append((no_id, doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [{"start": int(x), "stop": int(y)} for x, y in turns]))
        return pd.DataFrame(rows, columns=names)


def drop_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, text (the kept words, joined by one space) and spans (start, stop) of
    removed words: those that a window of `size` consecutive words covers which also starts in a document with a smaller id.

    Words are what ASCII white space separates. Windows are judged on the input, not on what is left. Null texts have no
    words; texts with fewer than `size` lose none. Null ids come after all others. Rows that share an id don't cut each
    other, and rows that repeat id and text are cut alike. An empty table gives no rows; other columns are ignored.

    A chunk is the documents with one hash, a few MB of text. It asks each shard of the hash space about its distinct windows
    of size / 2 words, and names those that are blocks: its own texts cut into pieces of that many words without overlap.
    A window of another chunk that equals a block is an anchor, as is one found twice in a chunk. Every repeat of `size` words
    holds a whole block of the document it repeats, wherever that begins, so windows of full size are made about anchors
    only; their 128-bit hashes and smallest ids meet in shards, and neighbouring ones that repeat grow together to maximal
    repeats. A chunk asks about a window once, however many of its documents hold it, so a passage that all documents share is
    one entry per chunk. Texts are shuffled once; the three steps read the same shuffle."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = (base.agg(F.sum(F.octet_length("text"))).head()[0] or 0) / WORD_BYTES
    grow = max(1.0, (ASKED * words * WORD_BYTES / CHUNK_BYTES / SHARD_WINDOWS) ** 0.5)
    chunks = max(partitions(spark), int(words * WORD_BYTES / CHUNK_BYTES / grow))
    shards = max(partitions(spark), int(words / SHARD_WINDOWS / grow)).bit_length()
    steps = Repeats(size, shards)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    dealt = base.select(chunk, F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text").repartition("chunk")
    of = lambda df: df.groupBy("chunk")
    anchors = of(dealt).applyInPandas(lambda d: steps.ask_anchors(d), "shard long, chunk long, windows binary, blocks binary").groupBy("shard").applyInPandas(lambda a: steps.answer_anchors(a), "shard long, chunk long, hit binary")
    windows = of(dealt).cogroup(of(anchors)).applyInPandas(lambda d, a: steps.ask_windows(d, a), "shard long, chunk long, lo binary, hi binary, doc binary").groupBy("shard").applyInPandas(lambda a: steps.answer_windows(a), "shard long, chunk long, hit binary")
    cut = of(dealt).cogroup(of(windows)).applyInPandas(lambda d, a: steps.cut(d, a), "no_id boolean, id long, n_words long, n_removed long, text string, spans array<struct<start:long,stop:long>>")
    return cut.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *cut.columns[2:])

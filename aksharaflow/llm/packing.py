"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged, worker_cache

#: Entries that a worker keeps of looked-up chunks, and of looked-up words.
CACHE = 250_000
#: Pieces of one length that a bucket should hold on average when pieces are ranked.
BUCKET = 128
#: What the tokenizer's own regular expression calls words; fixed by the vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks whose normal form is their lower case and that hold no special token.
PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")


class _Looked(dict):
    """A dict that computes what is missing and starts anew when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[key] = made = self.make(key)
        return made


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with a vocabulary whose tokens never cross white space, chunk by chunk, each chunk looked up first."""

    def __init__(self, name: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(tokenizer_path(name))
        self.split, self.chars = regex.compile(WORDS).findall, _byte_chars()
        self.words, self.chunks = _Looked(self._word), _Looked(self._chunk)

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(self.chars[b] for b in word.encode())
        return np.array([t.id for t in self.whole.model.tokenize(mapped)], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):
            return b"".join(map(self.words.__getitem__, self.split(chunk.lower())))
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenize_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, longest: int = 4096, with_ids: bool = False) -> DataFrame:
    """Cuts the ids of each text, end_id behind them, into pieces of at most longest ids: PIECE, and ids if asked for.

    A null or empty text is one piece that holds end_id alone; a long text is encoded whole and then cut."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("encoders")
        encoder = cache.get(tokenizer) or cache.setdefault(tokenizer, Encoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, longest):
                    part = ids[4 * start : 4 * (start + longest)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total, *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pieces, PIECE + ", ids array<int>" * with_ids)


def pack_histogram(lengths: list[int], counts: list[int], longest: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (how often, piece lengths) that hold every piece of the histogram.

    Lengths come longest first. Each goes to the shortest pack begun so far, if it fits there: as many pieces as that
    pattern has packs are added, which splits the pattern where there are fewer pieces. What fits nowhere begins packs."""
    free: list[tuple[int, int, int, tuple]] = []  # (-room, number, packs, lengths as a linked list), shortest pack first
    done, number = [], 0
    for length, left in sorted(zip(lengths, counts, strict=True), reverse=True):
        while left:
            number += 1
            if free and -free[0][0] >= length:
                room, _, packs, inside = heapq.heappop(free)
                used = min(packs, left)
                if packs > used:
                    heapq.heappush(free, (room, number, packs - used, inside))
                    number += 1
            else:
                room, used, inside = -longest, left, ()
            left -= used
            item = (room + length, number, used, (length, inside))
            heapq.heappush(free, item) if room + length else done.append(item)
    out = []
    for _, _, packs, inside in done + sorted(free):
        found = []
        while inside:
            found.append(inside[0])
            inside = inside[1]
        out.append((packs, found[::-1]))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length an array of (first rank, first sequence, offset, ids in the sequence): pieces ranked from first rank on
    go to sequences from first sequence on, one each."""
    found: dict[int, list] = {}
    ranked: dict[int, int] = {}
    first = 0
    for packs, inside in patterns:
        offset = 0
        for length in inside:
            rank = ranked.get(length, 0)
            found.setdefault(length, []).append((rank, first, offset, sum(inside)))
            ranked[length], offset = rank + packs, offset + length
        first += packs
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pack(pieces: DataFrame, longest: int = 4096) -> DataFrame:
    """Pieces (doc_id, start, length and any others, whatever their names but these four) with sequence_id, offset, sequence_tokens and padded_tokens.

    The histogram of lengths, of at most longest rows, is packed on the driver; the patterns number a small multiple of
    the lengths, whatever the corpus. Pieces are ranked within their length, in buckets of about BUCKET pieces, and
    find their pattern by rank. A sequence is padded to longest ids, except one whose ids number a power of two.
    Repeated rows are pieces of their own; an empty table gives no rows."""
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most longest rows
    if not hist:
        return pieces.select("*", *[F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset", "sequence_tokens", "padded_tokens")])
    sent = pieces.sparkSession.sparkContext.broadcast(slots(pack_histogram(list(hist), list(hist.values()), longest)))  # of at most longest lengths
    side = int(np.ceil(np.sqrt(-(-max(hist.values()) // BUCKET))))
    hi, lo, rank = (free_name(pieces, c) for c in ("hi", "lo", "rank"))
    h = F.xxhash64("doc_id", "start")
    rows = pieces.withColumns({hi: F.pmod(h, F.lit(side)), lo: F.pmod(F.xxhash64(h), F.lit(side))})
    # Buckets in two levels, so that no window orders more than about the square root of a length's buckets.
    before = lambda *by: F.coalesce(F.sum("here").over(Window.partitionBy("length", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = staged(rows.groupBy("length", hi, lo).agg(F.count("*").alias("here")), "piece-buckets")
    large = small.groupBy("length", hi).agg(F.sum("here").alias("here")).select("length", hi, before(hi).alias("above"))
    base = small.select("length", hi, lo, before(hi, lo).alias("beside")).join(large, ["length", hi]).select("length", hi, lo, (F.col("above") + F.col("beside")).alias(rank))
    within = F.row_number().over(Window.partitionBy("length", hi, lo).orderBy("doc_id", "start"))
    rows = rows.join(base, ["length", hi, lo]).withColumn(rank, (F.col(rank) + within - 1).cast("long")).select(*pieces.columns, rank)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = sent.value
        for batch in batches:
            put = np.zeros((len(batch), 3), np.int64)
            length, at = batch["length"].to_numpy(), batch[rank].to_numpy()
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                table = of[int(length[own[0]])]
                row = table[np.searchsorted(table[:, 0], at[own], "right") - 1]
                put[own] = np.stack([row[:, 1] + at[own] - row[:, 0], row[:, 2], row[:, 3]], 1)
            used = put[:, 2]
            yield batch.drop(columns=rank).assign(sequence_id=put[:, 0], offset=put[:, 1], sequence_tokens=used, padded_tokens=np.where(used & (used - 1), longest, used))

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return rows.mapInPandas(place, f"{kinds}, sequence_id long, offset long, sequence_tokens long, padded_tokens long")


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """One row per sequence: sequence_id, ids (padded), and pieces (doc_id, start, offset, length) in order. Pieces need ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"), F.first("sequence_tokens").alias("used"), F.first("padded_tokens").alias("padded"))
    ids = F.concat(F.flatten("p.ids"), F.array_repeat(F.lit(pad_id), (F.col("padded") - F.col("used")).cast("int")))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, longest: int = 4096, with_ids: bool = False) -> DataFrame:
    """Tokenizes documents (doc_id, text) once, into a staged table, and packs the pieces."""
    return pack(staged(tokenize_pieces(docs, tokenizer, end_id, longest, with_ids), "pieces"), longest)

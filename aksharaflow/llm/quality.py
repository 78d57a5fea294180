"""Quality by supervised subword embeddings: hashed word and n-gram vectors, averaged, with a softmax on top."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_cache

#: Words whose vectors a worker keeps.
CACHE = 300_000
#: Code points of a word that is cached at most, and of the slices that longer words are read in.
SHORT, SLICE = 64, 1 << 16
#: Lengths of character n-grams, taken from the word between < and >.
GRAMS = (3, 4)
#: The word that stands for a repetition of the one before; white space keeps it apart from any word of a text.
AGAIN = "\n"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dims: int = 8
    epochs: int = 4
    step: float = 0.5
    #: Labelled rows of each class that the fit uses at most, those with the smallest hash of their id.
    sample: int = 3000
    #: Bytes of their texts at most, in all: what the task of the fit holds.
    sample_bytes: int = 1 << 28
    seed: int = 7


def word_features(word: str, buckets: int) -> list[int]:
    """Buckets of the word and of its n-grams of UTF-8 bytes; bucket 0 is that of AGAIN."""
    if word == AGAIN:
        return [0]
    full = b"<%s>" % word.encode("utf-8", "surrogatepass")
    grams = [full[i : i + n] for n in GRAMS for i in range(len(full) - n + 1)]
    return [1 + zlib.crc32(x) % (buckets - 1) for x in (full, *grams)]


def _crc_steps() -> np.ndarray:
    """The table of CRC-32: what a byte does to the sum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_steps()


def long_features(word: str, buckets: int) -> Iterator[np.ndarray]:
    """The features of word_features in arrays of bounded size, whatever the length of the word."""
    whole, before = 0, b""
    for at in range(0, len(word), SLICE):
        new = b"<" * (at == 0) + word[at : at + SLICE].encode("utf-8", "surrogatepass") + b">" * (at + SLICE >= len(word))
        whole = zlib.crc32(new, whole)
        data = np.frombuffer(before + new, np.uint8)
        for n in GRAMS:
            first = max(0, len(before) - n + 1)  # the grams before it lie in the last slice
            count = len(data) - n + 1 - first
            if count > 0:
                crc = np.full(count, 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    crc = CRC[(crc ^ data[first + k : first + k + count]) & 0xFF] ^ (crc >> 8)
                yield 1 + (~crc).astype(np.int64) % (buckets - 1)
        before = data[-(max(GRAMS) - 1) :].tobytes()
    yield np.array([1 + whole % (buckets - 1)], np.int64)


def words(text: str) -> list[str]:
    """Words by white space; one that repeats the word before it is followed by AGAIN."""
    found = text.split()
    same = [i for i in range(1, len(found)) if found[i] == found[i - 1]]
    return found + [AGAIN] * len(same)


class _Sums:
    """Per word, the sum of its feature vectors and their number: rows of a table, found by a dict."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = table, {}
        self.rows = np.zeros((CACHE, table.shape[1] + 1), np.float32)

    def learn(self, found: set[str]) -> None:
        new = list(found.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(found)
        if new:
            each = [word_features(w, len(self.table)) for w in new]
            size = np.fromiter(map(len, each), np.int64, len(each))
            at = np.fromiter((b for x in each for b in x), np.int64, int(size.sum()))
            first = len(self.known)
            self.rows[first : first + len(new), :-1] = np.add.reduceat(self.table[at], np.cumsum(size) - size)
            self.rows[first : first + len(new), -1] = size
            self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def sums(self, found: list[str]) -> np.ndarray:
        total = np.zeros(self.rows.shape[1])
        if max(map(len, found), default=0) > SHORT:
            for word in found:
                for at in long_features(word, len(self.table)) if len(word) > SHORT else ():
                    total[:-1] += self.table[at].sum(0, dtype=np.float64)
                    total[-1] += len(at)
            found = [w for w in found if len(w) <= SHORT]
        for i in range(0, len(found), CACHE // 4):
            part = found[i : i + CACHE // 4]
            self.learn(set(part))
            total += self.rows[np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))].sum(0, dtype=np.float64)
        return total


@dataclass(frozen=True, eq=False)
class QualityModel:
    """Vectors of the feature buckets, and the softmax layer over the mean of a text's vectors (class 0, class 1)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def probability(self, mean: np.ndarray) -> float:
        z = mean @ self.weights + self.bias
        return float(1 / (1 + np.exp(np.clip(z[0] - z[1], -30, 30))))


def bag(text: str, buckets: int, cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and how often each occurs, over all its features."""
    parts, n = [], np.zeros(buckets, np.int64)
    for word in words(text):
        if len(word) > SHORT:
            for at in long_features(word, buckets):
                n += np.bincount(at, minlength=buckets)
            continue
        at = cache.get(word)
        if at is None:
            if len(cache) >= CACHE:
                cache.clear()
            at = cache[word] = np.array(word_features(word, buckets), np.int64)
        parts.append(at)
    if parts:
        n += np.bincount(np.concatenate(parts), minlength=buckets)
    ids = np.flatnonzero(n)
    return ids.astype(np.int32), (n[ids] / max(1, n.sum())).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, s: Settings) -> QualityModel:
    """Stochastic gradient descent over whole texts, a step per text, with a step size that falls to zero."""
    rng = np.random.default_rng(s.seed)
    vectors = ((rng.random((s.buckets, s.dims)) - 0.5) / s.dims).astype(np.float32)
    weights, bias = np.zeros((s.dims, 2), np.float32), np.zeros(2, np.float32)
    cache: dict[str, np.ndarray] = {}
    bags = [bag(t, s.buckets, cache) for t in texts]
    steps = 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(bags)):
            rate = s.step * (1 - steps / (s.epochs * len(bags)))
            steps += 1
            ids, share = bags[i]
            mean = share @ vectors[ids] if len(ids) else np.zeros(s.dims, np.float32)
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            if len(ids):
                vectors[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back[None, :]
    return QualityModel(vectors, weights, bias)


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> QualityModel:
    """Learns from labels (doc_id, quality) of the rows of docs (doc_id, text) where learn (a Column over doc_id) holds.

    The fit runs in one task on at most settings.sample labelled ids of each class, and on twice as many rows at most where
    ids repeat, of settings.sample_bytes bytes of text in all, those with the smallest hashes; rows are taken in order of id and text. Null labels are no labels; of
    repeated labels the largest counts, null texts are empty. Without labelled rows every text scores 0.5."""
    known = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    few = [known.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample) for c in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few[0].unionByName(few[1])), "doc_id")  # at most 2 * settings.sample ids
    order = [F.xxhash64("doc_id"), F.xxhash64("text"), "text"]
    rows = rows.orderBy(*order).limit(2 * settings.sample)  # an id may repeat
    rows = rows.withColumn("upto", F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= settings.sample_bytes).drop("upto")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "text"])
        m = fit(batch["text"].tolist(), batch["quality"].to_numpy(), settings)
        return pd.DataFrame({"vectors": [m.vectors.tobytes()], "weights": [m.weights.tobytes()], "bias": [m.bias.tobytes()]})

    made = rows.groupBy().applyInPandas(run, "vectors binary, weights binary, bias binary").collect()
    d = settings.dims
    if not made:
        return QualityModel(np.zeros((2, d), np.float32), np.zeros((d, 2), np.float32), np.zeros(2, np.float32))
    r = made[0]
    return QualityModel(np.frombuffer(r["vectors"], np.float32).reshape(-1, d), np.frombuffer(r["weights"], np.float32).reshape(d, 2), np.frombuffer(r["bias"], np.float32))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, score (likelihood of label 1), predicted. Whole texts are scored, null and empty
    ones by the bias alone; repeated rows and null ids like any other; other columns are ignored."""
    # buckets x dims numbers, whatever the corpus; arrays, as a class could be read only where this package is installed
    sent = docs.sparkSession.sparkContext.broadcast((model.vectors, model.weights, model.bias))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cache = QualityModel(*sent.value), worker_cache("quality-words")
        if cache.get("model") != name:
            cache.update(model=name, sums=_Sums(model.vectors))
        sums = cache["sums"].sums
        for batch in batches:
            scores = []
            for text in batch["text"]:
                total = sums(words(text))
                scores.append(model.probability((total[:-1] / max(1.0, total[-1])).astype(np.float32)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": np.array(scores, np.float64)})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

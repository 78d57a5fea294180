"""Toxicity by maximum-scoring segments: token log-odds with Dirichlet priors, extreme-value calibration."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged, worker_cache

#: Distinct tokens that a task counts before it hands on what it has.
FLUSH = 200_000
#: Largest number of labels that is broadcast to the documents; more are joined by shuffling.
BROADCAST_LABELS = 1_000_000
#: Telling features in a broadcast table; a model with more of them is read in as many passes as it takes.
PART = 1_000_000
#: Tokens whose scores a worker keeps.
CACHE = 400_000
#: Lengths of token prefixes that are features beside the token itself, longest first.
PREFIXES = (7, 6, 5, 4)
#: Code points around a token that don't belong to it.
EDGE = re.compile(r"^\W+|\W+$")


def tokens(text: str) -> list[str]:
    return text.lower().split()


def features(token: str) -> list[str]:
    """The token without punctuation around it, marked as whole, and its prefixes."""
    core = EDGE.sub("", token)
    return [f"{core}$", *[core[:n] for n in PREFIXES if len(core) >= n]] if core else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, behind the last, score) of a sequence, in linear time, from left to right.

    Runs of negative scores between two positive ones count as one step, as no maximal segment begins or ends in them."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    kept: list[tuple[int, int, float, float]] = []  # first, behind the last, sum before it, sum with it
    for k in up.tolist():
        first, low, high = k, total[k], total[k + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, k + 1, low, high))
    return [(a, b, float(h - w)) for a, b, w, h in kept]


@dataclass(frozen=True)
class ToxicModel:
    """odds: a staged table of the telling features (f, odds), in parts. off: score of every token without one. rate, scale: of the
    extreme-value law of the best segment of n clean tokens, P(S >= s) = 1 - exp(-scale * n * exp(-rate * s)). line:
    logistic calibration."""

    odds: DataFrame | None = field(default=None, repr=False)
    parts: int = 0
    off: float = -0.25
    rate: float = 1.0
    scale: float = 0.1
    line: tuple[float, float] = (0.0, 1.0)

    def part(self, k: int) -> dict[str, float]:
        """The k-th part of the features, about PART of them."""
        return {r["f"]: r["odds"] for r in self.odds.where(F.col("part") == k).select("f", "odds").collect()}

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sums over the significant segments -ln of how many as good a clean text of n tokens is expected to have, where
        a text is taken to be long enough for one that scores nothing."""
        each = (self.rate * s - max(0.0, np.log(self.scale * max(1, n))) for _, _, s in found)
        return float(sum(e for e in each if e > 0))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * evidence, -700, 700))))


def damp(found: list[str], scores: np.ndarray) -> np.ndarray:
    """The r-th time that a text holds a token, its positive score counts a r-th part: repetition alone is no passage."""
    times: Counter = Counter()
    for k in np.flatnonzero(scores > 0).tolist():
        times[found[k]] += 1
        scores[k] /= times[found[k]]
    return scores


class _Told(dict):
    """Per token the log-odds of its most telling feature, 0 where none tells."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[token] = told = max((self.odds[f] for f in features(token) if f in self.odds), key=abs, default=0.0)
        return told


def _lookup(name: str, odds: dict[str, float]):
    """A function of a list of tokens to their log-odds; workers keep what they have looked up for the table of that name."""
    cache = worker_cache("toxic-tokens")
    if cache.get("name") != name:
        cache.update(name=name, told=_Told(odds))
    look = cache["told"].__getitem__
    return lambda found: np.fromiter(map(look, found), np.float64, len(found))


def token_counts(docs: DataFrame) -> DataFrame:
    """Documents that hold each token without punctuation around it: token, docs, toxic, clean; docs has text and toxic (1, 0, or null if not to be learned from)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_, by = Counter(), {1: Counter(), 0: Counter()}

        def out() -> pd.DataFrame:
            cores: dict[str, list[int]] = {}
            for token, n in all_.items():
                told = cores.setdefault(EDGE.sub("", token), [0, 0, 0])
                told[0] += n
                told[1] += by[1][token]
                told[2] += by[0][token]
            cores.pop("", None)
            return pd.DataFrame({"token": pd.Series(list(cores), dtype=object), **dict(zip(("docs", "toxic", "clean"), np.array(list(cores.values()), np.int64).reshape(-1, 3).T, strict=True))})

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                held = set(tokens(text))
                all_.update(held)
                if toxic in by:
                    by[toxic].update(held)
                if len(all_) >= FLUSH:
                    yield out()
                    all_, by = Counter(), {1: Counter(), 0: Counter()}
        yield out()

    parts = docs.select("text", F.col("toxic").cast("double").alias("toxic")).mapInPandas(count, "token string, docs long, toxic long, clean long")
    return parts.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")])


def log_odds(counts: DataFrame, least_docs: int = 3, least_z: float = 4.0) -> DataFrame | None:
    """f, odds: log-odds of features between toxic and clean documents, under Dirichlet priors in proportion to the counts of
    the whole corpus, with the mass of the smaller of the two classes. Kept are all features that at least least_docs
    labelled documents hold and whose z passes least_z either way. None without documents of both kinds."""
    core = F.col("token")
    feats = F.array(F.concat(core, F.lit("$")), *[F.when(F.char_length(core) >= n, F.substring(core, 1, n)) for n in PREFIXES])
    each = counts.select(F.explode(F.array_compact(feats)).alias("f"), "docs", "toxic", "clean")
    each = staged(each.groupBy("f").agg(*[F.sum(c).cast("double").alias(c) for c in ("docs", "toxic", "clean")]), "toxic-features")
    total = each.agg(*[F.sum(c).alias(c) for c in ("docs", "toxic", "clean")]).head()
    if not total["toxic"] or not total["clean"]:
        return None
    prior = min(total["toxic"], total["clean"])
    a = F.col("docs") * (prior / total["docs"])
    t, c = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(t / (total["toxic"] + prior - t)) - F.log(c / (total["clean"] + prior - c))
    z = odds / F.sqrt(1 / t + 1 / c)
    return each.where(F.col("toxic") + F.col("clean") >= least_docs).withColumns({"odds": odds, "z": z}).where(F.abs(F.col("z")) >= least_z).select("f", "odds")


SCORED = "doc_id long, tokens long, evidence double, best double, up long, segments array<struct<start:bigint,length:bigint,score:double,expected:double>>"


def _told(docs: DataFrame, model: ToxicModel) -> tuple[DataFrame, str, object]:
    """Docs ready for the last part of the model: with a column of that name for what the other parts have told of each
    token (null if there is one part), and the last part as a broadcast variable."""
    sc, name = docs.sparkSession.sparkContext, free_name(docs, "told")
    docs = docs.withColumn(name, F.lit(None).cast("array<double>"))
    for k in range(model.parts - 1):
        sent, key = sc.broadcast(model.part(k)), uuid.uuid4().hex

        def run(batches, sent=sent, key=key):
            import pyarrow as pa

            look = _lookup(key, sent.value)
            for batch in batches:
                at = batch.schema.get_field_index(name)
                told = []
                for text, old in zip(batch.column("text").to_pylist(), batch.column(at).to_pylist(), strict=True):
                    new = look(tokens(text or ""))
                    told.append(new if old is None else np.where(np.abs(new) > np.abs(old), new, old))
                yield batch.set_column(at, name, pa.array(told, pa.list_(pa.float64())))

        docs = docs.mapInArrow(run, docs.schema)
    return docs, name, sc.broadcast(model.part(model.parts - 1) if model.parts else {})  # at most about PART features


def _scores(look, found: list[str], old, off: float) -> np.ndarray:
    """Scores of the tokens of a text: the most telling feature's log-odds and off, repetitions damped."""
    told = look(found)
    if old is not None and len(found):
        old = np.asarray(old)
        told = np.where(np.abs(told) > np.abs(old), told, old)
    return damp(found, told + off)


def find_segments(docs: DataFrame, model: ToxicModel, with_spans: bool = True) -> DataFrame:
    """Per document: tokens, evidence, best segment score, number of tokens with a positive score, and the significant ones
    of all maximal segments as (start, length) in code points of the text, score, and how many as good a clean text
    would have. Lower case maps no character to or from white space, so that tokens and spans agree."""
    docs, name, sent = _told(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model)
    key, law = uuid.uuid4().hex, ToxicModel(None, 0, model.off, model.rate, model.scale, model.line)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _lookup(key, sent.value)
        for batch in batches:
            rows = []
            for doc, text, old in zip(batch["doc_id"], batch["text"], batch[name], strict=True):
                found = tokens(text)
                scores = _scores(look, found, old, law.off)
                segs = segments(scores)
                told = [(a, b, s, e) for a, b, s in segs if (e := law.scale * max(1, len(found)) * float(np.exp(-law.rate * s))) < 1]
                spans = []
                if told and with_spans:
                    at = [m.span() for m in re.finditer(r"\S+", text)]
                    spans = [{"start": at[a][0], "length": at[b - 1][1] - at[a][0], "score": s, "expected": e} for a, b, s, e in told]
                rows.append((doc, len(found), law.evidence(len(found), segs), max((s for *_, s in segs), default=0.0), int((scores > 0).sum()), spans))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCORED.split(", ")]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, SCORED)


def train(docs: DataFrame, labels: DataFrame, learn, sample: int = 10_000) -> ToxicModel:
    """Learns from labels (doc_id, toxic) of the rows of docs (doc_id, text) where learn (a Column over doc_id) holds.

    Token counts cover all documents; log-odds all labelled ones that may be learned from. The extreme-value law and
    the logistic line are fitted to the segments of at most `sample` rows of the latter, by smallest hash of the id, then
    of the text. Labels that are null count as no label; of repeated labels the largest counts. Without labels of both
    kinds every document scores 0.5 or below."""
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = staged(known, "toxic-labels")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id", "left")
    odds = log_odds(token_counts(joined))
    if odds is None:
        return ToxicModel(line=(-1.0, 0.0))
    odds = staged(odds, "toxic-odds")
    parts = -(-odds.count() // PART)
    if not parts:
        return ToxicModel(line=(-1.0, 0.0))
    model = ToxicModel(odds.withColumn("part", F.pmod(F.xxhash64("f"), F.lit(parts))), parts)
    few = F.broadcast(known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).select("doc_id", F.col("toxic").alias("t")))  # at most `sample` rows
    rows = docs.select("doc_id", "text").join(few, "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample)  # an id may repeat
    rows = staged(rows.select(F.monotonically_increasing_id().alias("doc_id"), "text", "t"), "toxic-sample")
    told = lambda m, *columns: find_segments(rows, m, False).join(rows.select("doc_id", "t"), "doc_id").select("t", *columns).toPandas()  # noqa: E731  at most `sample` rows of numbers
    clean = told(model, "tokens", "best", "up")
    clean = clean[clean["t"] == 0]
    model = replace(model, **dict(zip(("rate", "scale"), extreme_law(clean["best"].to_numpy(), clean["tokens"].to_numpy(), int(clean["up"].sum()), model.off), strict=True)))
    got = told(model, "evidence")
    return replace(model, line=logistic_line(got["evidence"].to_numpy(np.float64), got["t"].to_numpy(np.float64)))


def extreme_law(best: np.ndarray, n: np.ndarray, up: int, off: float) -> tuple[float, float]:
    """rate and scale of the law of the best segments of clean texts of n tokens. The rate balances the tokens with a
    positive score, of mean gain g, against the others (sum over p * exp(rate * score) = 1); one more positive token than
    seen is assumed. The scale then is the maximum-likelihood one."""
    total = float(n.sum()) + 1
    p = (up + 1) / (total + 1)
    gain = float(best[best > 0].mean()) if (best > 0).any() else 4.0
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p * np.exp(min(600.0, mid * gain)) + (1 - p) * np.exp(mid * off) < 1 else (low, mid)
    rate = max(0.05, low)
    scale = (len(n) + 1) / max(1e-9, float((n * np.exp(-rate * best)).sum()) + 1)
    return rate, float(min(1.0, max(1e-9, scale)))


def logistic_line(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """a, b of P(1) = 1 / (1 + exp(-(a + b * x))), by Newton's method; b isn't negative."""
    z = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, z.T @ (p - y) + ridge * w), -5, 5)
    return float(w[0]), float(max(0.0, w[1]))


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, and the significant segments.

    Whole texts are scored; a null or empty text has no segment and scores what no evidence scores. Repeated rows and
    null ids are scored like any other; other columns are ignored."""
    rows = find_segments(docs, model)
    score = 1 / (1 + F.exp(-(F.lit(model.line[0]) + F.lit(model.line[1]) * F.col("evidence"))))
    return rows.select("doc_id", score.alias("score"), "segments").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose whole text scores below the threshold; order and repeats stay."""
    import pyarrow as pa

    columns = docs.columns
    docs, name, sent = _told(docs, model)
    key, law = uuid.uuid4().hex, ToxicModel(None, 0, model.off, model.rate, model.scale, model.line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _lookup(key, sent.value)
        for batch in batches:
            keep = []
            for text, old in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
                found = tokens(text or "")
                keep.append(law.probability(law.evidence(len(found), segments(_scores(look, found, old, law.off)))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns([name])

    return docs.mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in columns]).schema)

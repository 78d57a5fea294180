import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aksharaflow.llm import quality, toxicity


def rows(n=600, seed=1):
    rng = random.Random(seed)
    syll = ["an", "be", "co", "du", "er", "fi"]
    out, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syll) for _ in range(3)) for _ in range(rng.randint(20, 80))]
        toxic, bad = i % 6 == 0, i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nastyan", "nastybe", "nastyco"]) + rng.choice(["", ".", "!"]))
        text = " ".join(w + "$$" if bad else w for w in words)
        out.append((i, text, "x"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return out, labels


def test_segments_match_brute_force():
    rng = np.random.default_rng(1)

    def brute(s, off=0):
        if not len(s) or max(s) <= 0:
            return []
        c = np.concatenate([[0], np.cumsum(s)])
        _, _, i, j = max((round(c[j] - c[i], 9), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        return brute(s[:i], off) + [(off + i, off + j)] + brute(s[j:], off + j)

    for _ in range(200):
        s = rng.integers(-4, 5, size=rng.integers(1, 14)) + rng.random() * 0.01
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(s)


def test_toxicity_held_out(spark):
    data, labels = rows()
    docs = spark.createDataFrame(data + [(9000, None, ""), (9001, "", ""), (None, "vile nastyan vile", "")], "doc_id long, text string, tokens string")
    lab = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in labels if i % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[9000]["score"] == got[9001]["score"] < 0.5 and got[9000]["segments"] == []
    texts = {i: t for i, t, _ in data}
    hit = next(r for r in got.values() if r["segments"] and r["doc_id"] in texts)
    s = hit["segments"][0]
    assert any(w in texts[hit["doc_id"]][s["start"] : s["start"] + s["length"]] for w in ("vile", "nasty"))
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score_toxicity(docs, model).head()["predicted"] == 0
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0


def test_quality_held_out(spark):
    data, labels = rows()
    docs = spark.createDataFrame(data + [(9000, None, ""), (9001, "", ""), (None, "x", ""), (9002, "y " * 30_000, "")], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, lab, F.col("doc_id") % 4 != 2, quality.Settings(buckets=1 << 12, epochs=3))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    held = [(got[i]["predicted"], q) for i, q, _ in labels if i % 4 == 2] + [(got[i]["predicted"], q) for i, q, _ in labels if i % 4 == 0][:40]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    assert len(got) == len(data) + 4 and all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["score"] == got[9001]["score"]
    none = quality.train(docs, lab.where("false"), F.lit(True))
    assert quality.score_quality(docs, none).head()["score"] == 0.5


def test_quality_reads_whole_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE", 50)
    rng = random.Random(3)
    for n in (1, 49, 50, 51, 65, 99, 100, 101, 1000):
        word = "".join(rng.choice("ab<>éक😀\udc80") for _ in range(n))
        got = np.sort(np.concatenate(list(quality.long_features(word, 1 << 12))))
        assert got.tolist() == sorted(quality.word_features(word, 1 << 12)) and len(got) == 2 * len(word.encode("utf-8", "surrogatepass")), n
    # without white space, alike in the first 64 code points
    texts = [(i, "字" * 64 + "".join(rng.choice("良好" if i % 2 else "坏差") for _ in range(200))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") < 60, quality.Settings(buckets=1 << 12))
    held = quality.score_quality(docs.where("doc_id >= 60"), model, 0.5).collect()
    assert len(held) == 20 and all(r["predicted"] == r["doc_id"] % 2 for r in held) and len({r["score"] for r in held}) > 2
    table = np.random.default_rng(1).random((1 << 12, 4)).astype(np.float32)
    found = quality.words("x " + "y" * 300 + " " + "y" * 300)
    sums = quality._Sums(table)
    each = [b for w in found for b in quality.word_features(w, len(table))]
    assert np.allclose(sums.sums(found), [*table[each].sum(0, dtype=np.float64), len(each)]) and "y" * 300 not in sums.known
    cache = {}
    ids, share = quality.bag(" ".join(found[:3]), len(table), cache)
    assert np.allclose(np.bincount(each, minlength=len(table))[ids] / len(each), share) and set(cache) == {"x", quality.AGAIN}


def brute_buckets(text, buckets):
    """Every feature bucket of a text, one by one: words, their n-grams of bytes, and a mark for a repeated word."""
    found, out = text.split(), []
    for i, w in enumerate(found):
        full = b"<" + w.encode() + b">"
        for x in [full] + [full[k : k + n] for n in (3, 4) for k in range(len(full) - n + 1)]:
            out.append(1 + zlib.crc32(x) % (buckets - 1))
        if i and found[i - 1] == w:
            out.append(0)
    return out


def brute_forward(text, vectors, weights, bias):
    at = brute_buckets(text, len(vectors))
    mean = [sum(vectors[b][d] for b in at) / max(1, len(at)) for d in range(len(weights))]
    z = [sum(mean[d] * weights[d][c] for d in range(len(weights))) + bias[c] for c in (0, 1)]
    top = max(z)
    p = [math.exp(x - top) for x in z]
    return at, mean, [x / sum(p) for x in p]


def test_quality_fit_matches_plain_gradient_steps():
    texts, labels = ["good words here here", "bad bad text", "", "more good words"], [1, 0, 0, 1]
    s = quality.Settings(buckets=64, dims=3, epochs=2, step=0.5, seed=4)
    got = quality.fit(texts, np.array(labels), s)
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in row] for row in ((rng.random((64, 3)) - 0.5) / 3).astype(np.float32)]
    weights, bias, steps = [[0.0, 0.0] for _ in range(3)], [0.0, 0.0], 0
    for _ in range(2):
        for i in rng.permutation(4):
            rate = 0.5 * (1 - steps / 8)
            steps += 1
            at, mean, p = brute_forward(texts[i], vectors, weights, bias)
            error = [p[c] - (labels[i] == c) for c in (0, 1)]
            back = [sum(weights[d][c] * error[c] for c in (0, 1)) for d in range(3)]
            for d in range(3):
                for c in (0, 1):
                    weights[d][c] -= rate * mean[d] * error[c]
            for c in (0, 1):
                bias[c] -= rate * error[c]
            for b in set(at):
                for d in range(3):
                    vectors[b][d] -= rate * len(set(at)) ** 0.5 * at.count(b) / len(at) * back[d]
    assert np.allclose(got.vectors, vectors, atol=1e-5) and np.allclose(got.weights, weights, atol=1e-5) and np.allclose(got.bias, bias, atol=1e-5)


def test_quality_scores_match_a_plain_forward_pass(spark):
    data, labels = rows(120)
    data += [(9000, None, ""), (9001, "again again again", ""), (5, "the id 5 once more", ""), (None, "é 字字", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, lab, F.col("doc_id") % 4 != 2, quality.Settings(buckets=256, dims=4))
    want = sorted(brute_forward(t or "", model.vectors.tolist(), model.weights.tolist(), model.bias.tolist())[2][1] for _, t, _ in data)
    assert np.allclose(sorted(r["score"] for r in quality.score_quality(docs, model).collect()), want, atol=1e-5)
    again = quality.train(docs.repartition(7), lab, F.col("doc_id") % 4 != 2, quality.Settings(buckets=256, dims=4))
    assert (again.vectors == model.vectors).all() and (again.weights == model.weights).all()


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_toxicity_scores_match_plain_python(spark, part, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", part)
    data, labels = rows(240)
    data += [(9000, None, "x"), (9001, "vile " * 60 + "nastyan nastybe!", "x"), (5, "vile nastyco", "x"), (None, "İx vile\u00a0x", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, told string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab, F.col("doc_id") % 5 != 0)
    kind = {i: t for i, _, t in labels if i % 5}
    core = lambda w: re.sub(r"^\W+|\W+$", "", w)
    marks = lambda w: [core(w) + "$", *[core(w)[:n] for n in (7, 6, 5, 4) if len(core(w)) >= n]] if core(w) else []
    n = {}
    for i, text, _ in data:
        for w in set((text or "").lower().split()):
            for f in marks(w):
                each = n.setdefault(f, [0, 0, 0])
                each[0] += 1
                each[1] += kind.get(i) == 1
                each[2] += kind.get(i) == 0
    total = [sum(x[k] for x in n.values()) for k in range(3)]
    prior, odds = min(total[1], total[2]), {}
    for f, (d, t, c) in n.items():
        a = d * prior / total[0]
        o = math.log((t + a) / (total[1] + prior - t - a)) - math.log((c + a) / (total[2] + prior - c - a))
        if t + c >= 3 and abs(o / math.sqrt(1 / (t + a) + 1 / (c + a))) >= 4:
            odds[f] = o
    assert (model.parts > 1) == (part == 7) and len(odds) > 7
    assert {r["f"]: round(r["odds"], 9) for r in model.odds.collect()} == {f: round(o, 9) for f, o in odds.items()}

    def evidence(text):
        found, seen, scores = text.lower().split(), {}, []
        for w in found:
            s = max((odds[f] for f in marks(w) if f in odds), key=abs, default=0.0) + model.off
            if s > 0:
                seen[w] = seen.get(w, 0) + 1
                s /= seen[w]
            scores.append(s)

        def best(lo, hi):
            """Maximal segments: the best one, then those beside it."""
            cuts = [(sum(scores[i:j]), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            top = max(cuts, default=(0, 0, 0, 0))
            return [top[0], *best(lo, top[2]), *best(top[3], hi)] if top[0] > 1e-12 else []

        return sum(max(0.0, model.rate * s - max(0.0, math.log(model.scale * max(1, len(found))))) for s in best(0, len(scores)))

    want = sorted(1 / (1 + math.exp(-(model.line[0] + model.line[1] * evidence(t or "")))) for _, t, _ in data)
    got = toxicity.score_toxicity(docs, model).collect()
    assert np.allclose(sorted(r["score"] for r in got), want, atol=1e-9)
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(p < 0.5 for p in want)


ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from aksharaflow.llm import quality
docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad spam there ") * 5) for i in range(40)], "doc_id long, text string")
labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
model = quality.train(docs, labels, F.lit(True), quality.Settings(buckets=256, sample_bytes=1 << 20))
print("scores", quality.score_quality(docs, model).select("score").distinct().count())
"""


def test_quality_needs_no_package_on_executors(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    script = tmp_path / "alone.py"
    script.write_text(ALONE.format(repo=repo))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "scores 2" in done.stdout, done.stderr[-2000:]


def test_quality_sample_is_bounded_in_bytes(spark):
    rows = [(i, "word " * 2000) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels, F.lit(True), quality.Settings(buckets=64, sample_bytes=5000))
    assert not model.weights.any()  # no row fits into 5000 bytes, so nothing is learned
    assert quality.train(docs, labels, F.lit(True), quality.Settings(buckets=64, sample_bytes=50_000)).weights.any()

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from aksharaflow.llm import exact_dedup, line_dedup, neardup

DOCS = "doc_id long, text string, norm string, key string, n int"
ODD = [(1, None, "x", "y", 1), (2, "", "x", "y", 1), (3, " \n\t", "x", "y", 1), (4, "a b", "x", "y", 1), (5, "ab ", "x", "y", 1), (5, "ab ", "x", "y", 1), (None, "a  b", "x", "y", 1), (None, "é", "x", "y", 1), (9, "z " * 50_000, "x", "y", 1)]


def exact_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items()}


def test_exact_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = exact_dedup.mark_exact_duplicates(docs).collect()
    want = exact_brute(ODD)
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == len(want)
    assert {(r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == set(want.values())
    assert exact_dedup.mark_exact_duplicates(docs.where("false")).count() == 0


def test_exact_hot_group(spark):
    rows = [(i, "same text" + " " * (i % 7), "", "", 0) for i in range(3000)] + [(i, f"other {i // 2}", "", "", 0) for i in range(3000, 3400)]
    got = exact_dedup.mark_exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    want = exact_brute(rows)
    texts = {r[0]: re.sub(r"\s", "", r[1]) for r in rows}
    assert all((r["keep_id"], r["group_size"], r["text_sha256"]) == want[texts[r["doc_id"]]] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_hot_rows_with_one_id(spark):
    rows = [(1, "same text", "", "", 0)] * 2000 + [(i, f"other {i}", "", "", 0) for i in range(10, 300)]
    got = exact_dedup.mark_exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    same = [r for r in got if r["doc_id"] == 1]
    assert len(got) == len(rows) and len(same) == 2000 and sum(r["kept"] for r in same) == 1 and {r["group_size"] for r in same} == {2000}


def lines_brute(rows, least=20, most=3):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < most or max(held[key(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    pool = ["This line is repeated often, number %d" % k for k in range(8)] + ["  THIS line is Repeated often, number 1 ", "short", "", "Ünïcode line that is long enough É"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line of document {i} {rng.random()}" for _ in range(rng.randint(0, 6)))) for i in range(n)]


def test_lines_insert_delete_insert(spark):
    rows = corpus()
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    got = lambda index, part: {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in index.apply(frame(part)).collect()}
    first = line_dedup.LineIndex.empty(spark, shards=3).insert(frame(rows[:40]))
    assert got(first, rows[:40]) == lines_brute(rows[:40])
    both = first.insert(frame(rows[40:]))
    assert got(both, rows) == lines_brute(rows)
    less = both.delete(frame(rows[25:60]))
    assert got(less, rows[:25]) == lines_brute(rows[:25])
    assert {r["key"] for r in less.counts.collect()} == {r["key"] for r in line_dedup.LineIndex.empty(spark, shards=3).insert(frame(rows[:25])).counts.collect()}


def test_lines_inserted_twice_count_once(spark):
    rows = corpus(40, 5)
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    held = lambda index: sorted((bytes(r["key"]), r["refs"], r["keeper"]) for r in index.counts.collect())
    once = line_dedup.LineIndex.empty(spark, shards=3).insert(frame([*rows, (None, rows[0][1])]))
    again = once.insert(frame([*rows[10:30], (None, rows[0][1])]))
    assert held(once) == held(again) and again.postings.count() == once.postings.count()
    less, want = again.delete(frame(rows[20:])), line_dedup.LineIndex.empty(spark, shards=3).insert(frame([*rows[:20], (None, rows[0][1])]))
    assert held(less) == held(want)


def test_lines_of_repeated_ids_count_once(spark):
    line = "a line that is long enough"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    twice = frame([(1, line), (1, line), (2, line)])
    index = line_dedup.LineIndex.empty(spark).insert(twice)
    assert index.apply(twice).where("n_dropped > 0").count() == 0
    more = frame([(3, line + "\n" + line.upper()), (1, "x")])
    index = line_dedup.LineIndex.empty(spark).insert(twice.union(more))
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in index.apply(twice.union(more)).collect())
    assert got == [(1, "", 1, 1), (1, "", 1, 1), (1, "x", 1, 0), (2, "", 1, 1), (3, line + "\n" + line.upper(), 2, 0)]
    less = index.delete(frame([(3, None)]))
    assert less.apply(twice).where("n_dropped > 0").count() == 0


def test_lines_outgrow_their_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 20)
    rows = corpus(80, 9)
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = line_dedup.LineIndex.empty(spark, shards=2).insert(frame(rows[:10])).insert(frame(rows[10:]))
    assert index.shards > 2 and {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in index.apply(frame(rows)).collect()} == lines_brute(rows)


def test_lines_among_clashing_columns(spark):
    rows = [(i, "one line that all documents share\nown line %d" % i, "a", "b", "c", "d", 5) for i in range(5)] + [(9, "long " * 300_000, "a", "b", "c", "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, dropped string, dropped_of string, _id string, n_lines int")
    index = line_dedup.LineIndex.empty(spark).insert(docs)
    plain = index.apply(docs, counted=False)
    assert plain.columns == docs.columns and {r["n_lines"] for r in plain.collect()} == {5}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in index.apply(docs).collect()} == {**{i: (2, 1) for i in range(4)}, 4: (2, 0), 9: (1, 0)}


def test_lines_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = line_dedup.LineIndex.empty(spark).insert(docs).apply(docs)
    assert got.count() == len(ODD) and set(docs.columns) <= set(got.columns)
    assert [(r["text"], r["n_lines"], r["n_dropped"]) for r in got.where("doc_id in (1, 2)").collect()] == [("", 1, 0)] * 2
    none = docs.where("false")
    assert line_dedup.LineIndex.empty(spark).insert(none).apply(none).count() == 0


def test_cuckoo_filter():
    keys = np.arange(1, 5001, dtype=np.int64) * 7919
    f = line_dedup.CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    other = -keys
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert (line_dedup.CuckooFilter.loads(f.dumps()).table == f.table).all()
    assert not line_dedup.CuckooFilter(4).insert(keys)
    f = line_dedup.CuckooFilter.sized(6000)
    times = np.arange(2000) % 3 + 1
    assert f.insert(np.repeat(keys[:2000], times)) and (f.held(keys[:2000]) >= times).all() and (f.held(keys[:2000]) == times).mean() > 0.99
    f.delete(np.repeat(keys[:2000], times - 1))
    assert (f.held(keys[:2000]) >= 1).all() and (f.held(keys[:2000]) == 1).mean() > 0.99


def near_brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocab) for _ in range(rng.choice((6, 40, 200)))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(base[i % 12] if i % 3 else base[0])
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one two three"), (1006, "É x"), (1007, "é x")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, n long, comp long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, neardup.Settings(percent=85, leaf=8)).collect()}
    assert got == near_brute(rows, 85)


def near_copies(n, seed, vocab=5000):
    """A text of 150 words and n - 1 copies of it with up to two words changed: half of the pairs aren't links."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocab)}" for _ in range(150)]
    out = [base]
    for i in range(1, n):
        words = list(base)
        for _ in range(1 + i % 2):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        out.append(words)
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def test_near_copies_are_found_with_bounded_pairs(spark, monkeypatch):
    seen = []
    verify = neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda pairs, *rest: (seen.append(pairs.count()), verify(pairs, *rest))[1])
    most = {}
    for n in (500, 2000):
        rows = [(i, t) for i, t in enumerate(near_copies(n, 7))] + [(n + i, f"own text {i} " + " ".join(f"v{i}_{k}" for k in range(40))) for i in range(200)]
        seen.clear()
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), neardup.Settings(percent=85)).collect()}
        want = {i: 0 for i in range(n)} | {n + i: n + i for i in range(200)}
        right = sum(got[i] == want[i] for i in want) / len(want)
        assert right >= 0.99, right
        most[n] = sum(seen) / n
    assert most[500] <= 100 and most[2000] <= 100, most


def test_near_templates_that_share_most_words(spark):
    rng = random.Random(11)
    shared = " ".join(f"t{k}" for k in range(90))
    rows = [(i, shared + " " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(30))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " end") for i in range(0, 300, 3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Settings(percent=85)).collect()}
    want = near_brute(rows, 85)
    assert sum(got[i] == want[i] for i in want) / len(want) >= 0.99


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " z"), (9, b), (9, b), (4, c), (None, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(5, 5, True), (7, 5, False), (9, 5, False), (4, 4, True), (None, None, True)}


def test_near_odd_rows(spark):
    odd = [(*r, 1, 1, 1, 1) for r in ODD] + [(21, "long " * 200_000 + "word", "x", "y", 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(odd, DOCS + ", rid int, comp int, node int, set int")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(odd) and all(r["kept"] for r in got if r["doc_id"] in (None, 1, 2, 3, 21))
    docs = spark.createDataFrame(ODD, DOCS)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got if r["doc_id"] in (None, 1, 2, 3))
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert neardup.components(edges).select("comp").distinct().count() == 1


def test_shingles_come_from_small_batches(spark, monkeypatch):
    """An executor and its worker hold a batch of texts each: it is bounded by bytes, and the session's own setting comes back."""
    seen, key = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    real = neardup.staged
    monkeypatch.setattr(neardup, "staged", lambda df, name, *a, **k: (seen.append((name, spark.conf.get(key))), real(df, name, *a, **k))[1])
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert dict(seen)["shingle-sets"] == neardup.BATCH and dict(seen)["pairs"] == before == spark.conf.get(key)


def test_near_duplicates_of_members_that_trees_leave(spark, monkeypatch):
    """A chain of groups of near copies, where each group's link to the next hangs on one member: trees that compare nothing
    but representatives lose such links; the exact path finds all of them."""
    rng, s = random.Random(5), neardup.Settings(percent=80)
    docs, base = [], [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(60):
        docs.append((i, " ".join(base)))
        at = rng.randrange(190)
        base = base[:at] + [f"n{i}x{j}" for j in range(5)] + base[at + 5 :]
    docs += [(100 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) + " a common line of words that many documents share") for i in range(40)]
    sets = {d: set(neardup.shingles(t, s.words, neardup._Hashes()).tolist()) for d, t in docs}
    least = {d: d for d, _ in docs}
    while True:
        new = {d: min(least[e] for e in sets if e == d or 100 * len(sets[d] & sets[e]) >= s.percent * len(sets[d] | sets[e])) for d in sets}
        if new == least:
            break
        least = new
    seen = spark.createDataFrame(docs, "doc_id long, text string")
    half = spark.createDataFrame([(d, d % 7 == 0) for d in sets], "doc_id long, rest boolean")
    usable = neardup.shingle_sets(seen, s).withColumn("rid", F.col("doc_id"))
    labels = half.select(F.col("doc_id").alias("rid"), F.col("doc_id").alias("comp"), "rest")
    monkeypatch.setattr(neardup, "COMMON", 2)
    got = {tuple(r) for r in neardup._rest_pairs(usable, labels, s).collect()}
    linked = {(d, e) for d in sets for e in sets if d < e and 100 * len(sets[d] & sets[e]) >= s.percent * len(sets[d] | sets[e])}
    assert got >= {(d, e) for d, e in linked if d % 7 == 0 or e % 7 == 0} and len(got) < 400
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(seen, s).collect()} == least

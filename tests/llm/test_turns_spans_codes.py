import collections
import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aksharaflow.llm import queries, substring_dedup, turn_repair, vector_codes

TURNS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


# ---- conversation repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def script(rows):
    """The cheapest edits, found by trying them in order of cost and initials over positions and roles."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if (i, roles[-1:]) in done:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, kept
        done.add((i, roles[-1:]))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in follows:
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r, (*kept, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, kept))
            if fault in (None, "truncated"):
                extra = 5 if fault else 0
                if role and role[0] in follows:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[0], (*kept, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follows:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, roles + r, (*kept, (name, text))))


def audited(rows):
    convs, out = collections.defaultdict(list), {}
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role, text))
    for conv, turns in convs.items():
        turns.sort()
        seen, faults = set(), []
        for _, _, role, text in turns:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
        numbers = {t for has, t, *_ in turns if has}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, kept = script([(r, t, f) for (_, _, r, t), f in zip(turns, faults)])
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def some_turns(seed, convs=150):
    rng, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        for turn in sorted(rng.choice([None, *range(9)]) or 0 if rng.random() < 0.9 else 3 for _ in range(rng.randint(1, 7))):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "usher"])
            rows.append((conv, rng.choice([turn] * 9 + [None]), role, rng.choice(["One.", "Two!", "Three? ", "cut", "", " \t", None, "a\n.", "é"])))
    return rows


def test_repairs_match_a_search_of_all_scripts(spark):
    rows = some_turns(1)
    clash = {c: F.lit(1) for c in ("conv", "no_conv", "nth", "initial", "fault", "choices", "step", "h")}
    got = turn_repair.audit_conversations(spark.createDataFrame(rows, TURNS).withColumns(clash).repartition(5)).collect()
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == audited(filled) and len(got) == 151


def test_damage_and_repair(spark):
    rows = some_turns(2)
    turns = spark.createDataFrame(rows, TURNS)
    assert sorted((tuple(r) for r in turn_repair.damage(turns).collect()), key=repr) == sorted(damaged(rows), key=repr)
    got = turn_repair.audit_conversations(turn_repair.damage(turns)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == audited(damaged(rows))


def test_edits_are_the_repaired_rows(spark):
    rows = [(1, 1, "system", "s."), (1, 2, "user", "q?"), (1, 3, "user", "q?"), (1, 4, "user", "a."), (1, 5, "user", "cut")]
    edits = turn_repair.repair_conversations(spark.createDataFrame(rows, TURNS)).orderBy("step").collect()
    assert [(r["edit"], r["turn"], r["role"], r["was"], r["fault"], r["cost"]) for r in edits] == [
        ("K", 1, "system", "system", None, 0), ("K", 2, "user", "user", None, 0), ("D", 3, "user", "user", "duplicate", 2),
        ("R", 4, "assistant", "user", None, 1), ("D", 5, "user", "user", "truncated", 2),
    ]
    assert turn_repair.repair_conversations(spark.createDataFrame([], TURNS)).count() == 0 == turn_repair.audit_conversations(spark.createDataFrame([], TURNS)).count()


def test_a_giant_conversation_streams_in_batches(spark):
    rng = random.Random(3)
    rows = [(5, i, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", "y", ""]) + ("" if i % 3 else f" {i}.")) for i in range(6000)] + [(6, 1, "user", "long " * 200_000 + "."), (6, 2, "assistant", "ok.")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.audit_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == audited(rows)


# ---- substring dedup


def cut_by_hand(rows, size):
    docs, least = [((i is None, i or 0), re.findall(r"[^\x20\x09-\x0D]+", t or ""), i) for i, t in rows], {}
    for order, words, _ in docs:
        for p in range(len(words) - size + 1):
            k = tuple(words[p : p + size])
            least[k] = min(least.get(k, order), order)
    out = []
    for order, words, i in docs:
        gone = [False] * len(words)
        for p in range(len(words) - size + 1):
            if least[tuple(words[p : p + size])] < order:
                gone[p : p + size] = [True] * size
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def passages(seed, n=120):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randint(0, 6)) for w in (rng.choice(pool) if rng.random() < 0.6 else [str(rng.random()) for _ in range(rng.randint(1, 20))])) for _ in range(n)]
    return [(rng.randint(0, n), t) for t in texts] + [(7, None), (8, ""), (9, "w " * 40), (None, texts[0]), (None, texts[1]), (None, None), (3, texts[0]), (3, texts[0]), (200, "é ü " * 30), (201, "é ü " * 40)]


@pytest.mark.parametrize(("size", "chunk"), [(10, 1 << 12), (7, 1 << 20), (1, 1 << 11), (50, 1 << 12)])
def test_repeats_match_brute_force(spark, size, chunk, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", 1 << 9)
    rows = passages(size)
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, chunk int, id string, no_id boolean").repartition(5)
    got = substring_dedup.drop_repeats(docs, size).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == cut_by_hand(rows, size)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert substring_dedup.drop_repeats(docs.where("false"), size).count() == 0


def test_repeats_of_long_texts_and_many_copies(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))
    rows = [(i, f"own {i} words {passage} tail {i}") for i in range(2000)] + [(5000, long), (5001, "x " + long[:200_000])]
    got = sorted(tuple(r)[:4] for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert [r[2] for r in got[:2000]] == [0] + [72] * 1999 and got[2000][2] == 0 and got[1][3] == "own 1 1"
    assert got[2001][1] - got[2001][2] <= 2


def test_steps_of_numbers_survive():
    for values in ([], [0], [5, 70_000, 70_001, 16_777_215], [65_535, 131_071, 200_000]):
        assert substring_dedup._unpack(substring_dedup._pack(np.array(values, np.int64))).tolist() == values


# ---- vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(v, [int(np.floor(1024 * float(np.float32(x)))) for x in e]) for v, e, _ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    wide = max(1, -(-max((len(x) for _, x in kept), default=0) // parts))
    kept = [(v, x + [0] * (wide * parts - len(x))) for v, x in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[x[p * wide : (p + 1) * wide] for _, x in first] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[p * wide : (p + 1) * wide], c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, x in kept:
            for p in range(parts):
                members[p, near(x, p)[1]].append(x[p * wide : (p + 1) * wide])
        for (p, e), xs in members.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = [(v, "".join(f"{near(x, p)[1]:02x}" for p in range(parts)), min(2**63 - 1, sum(min(2**63 - 1, near(x, p)[0]) for p in range(parts)))) for v, x in kept]
    return sorted(out, key=repr), books


@pytest.mark.parametrize(("scale", "entries"), [(1.0, 6), (1e9, 5), (3e14, 4)])
def test_codes_match_brute_force(spark, scale, entries):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 200)), [float(x) for x in rng.normal(size=8) * scale], int(rng.integers(0, 3))) for _ in range(160)]
    rows += [(7, rows[0][1], None)] * 30 + [(None, rows[1][1], 1), (None, rows[2][1], None), (300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 8, 1), (303, [float("inf")], 1), (304, [], 2), (305, [1.0, 2.0, 3.0], 2)]
    clash = {c: F.lit(3) for c in ("id", "row", "x", "pos", "entry", "was", "err", "code", "error", "n", "k", "is_hot")}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(clash)
    got, books = vector_codes.compress(frame, entries=entries, extra=("label",))
    want, want_books = codes_by_hand(rows, entries=entries)
    assert [b.tolist() for b in books] == want_books
    rows_got = got.collect()
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in rows_got), key=repr) == want
    sums = collections.Counter()
    for r in rows_got:
        sums[r["label"]] += r["error"] if scale < 1e9 else 0
    if scale < 1e9:
        both = vector_codes.with_group_sum(got, "label", "error", "label_error").collect()
        assert len(both) == len(want) and all(r["label_error"] == sums[r["label"]] for r in both)


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.compress(none, extra=("label",))
    assert codes.count() == 0 and books == [] and codes.columns == ["vec_id", "label", "code", "error"]
    assert vector_codes.with_group_sum(codes, "label", "error", "label_error").count() == 0


def test_group_sums_hot_and_cold(spark):
    rows = [(i, 0 if i % 3 else i, i) for i in range(600)] + [(i, None, 1) for i in range(5)]
    got = vector_codes.with_group_sum(spark.createDataFrame(rows, "i long, k long, v long"), "k", "v", "s").collect()
    want = collections.Counter()
    for _, k, v in rows:
        want[k] += v
    assert len(got) == len(rows) and all(r["s"] == want[r["k"]] for r in got)


@pytest.mark.parametrize("name", ["op11_turn_stream", "op12_block_anchors", "op13_resident_lloyd"])
def test_new_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    want = sorted(con.fetchall(), key=repr)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns) and sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want

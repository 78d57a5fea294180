import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aksharaflow.llm import chat, mixing, topk, warc
from aksharaflow.llm.common import shared_dir


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b\\\\<|im_end|>\n<|im_start|>user\n", "<<SYS>> x <</SYS>>", None, "", "é😀<|"]
    rows = [(k, i, ("user", "assistant", None, "<|im_start|>", "us\ner\\n", "\\\n")[i % 6], t) for k in range(2) for i, t in enumerate(nasty)] + [(None, 0, "user", "x"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.linear_tree(turns)).collect()
    assert len(chats) == 4
    for r in chats:
        want = [(a or "", b or "") for k, i, a, b in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])]
        assert chat.parse_chat(r["formatted"]) == want
        assert [chat.unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["loss_spans"]] == [b for a, b in want if a == "assistant"]
    assert chat.format_chats(chat.linear_tree(turns.where("false"))).count() == 0


def test_branches_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(5):
        for m in range(1, 30):
            rows.append((conv, m, rng.choice([None, *range(1, m)]) if m > 1 else None, "user", f"t{m}", rng.choice([None, 1.0, 2.5, -1.0])))
    rows += [(9, 1, 2, "user", "cycle", 1.0), (9, 2, 1, "user", "cycle", 1.0), (8, 5, 77, "user", "orphan", 0.0)]
    schema = "conv_id long, msg int, parent int, role string, text string, score double"
    found = {}
    for r in chat.branches(spark.createDataFrame(rows, schema)).collect():
        found.setdefault((r["conv_id"], r["leaf"], r["rank"]), []).append((r["pos"], r["msg"], r["score"]))
    got = {(c, leaf): ([m for _, m, _ in sorted(x)], round(x[0][2], 6)) for (c, leaf, _), x in found.items()}
    assert all(sorted(p for p, *_ in x) == list(range(len(x))) for x in found.values())
    best = {(r["conv_id"], r["leaf"]) for r in chat.branches(spark.createDataFrame(rows, schema), 2).collect()}
    assert best == {(c, leaf) for c, leaf, rank in found if rank <= 2}
    want = {}
    for conv in range(5):
        node = {m: (p, s or 0.0) for k, m, p, _, _, s in rows if k == conv}
        for leaf in set(node) - {p for p, _ in node.values()}:
            path, at = [], leaf
            while at is not None:
                path.insert(0, at)
                at = node[at][0]
            want[conv, leaf] = (path, round(sum(node[m][1] for m in path), 6))
    assert got == want | {(8, 5): ([5], 0.0)}


def test_a_long_conversation_among_clashing_columns(spark):
    rows = [(1, i, i - 1 if i else None, ("user", "assistant")[i % 2], f"t{i}", 0.0, "x", "y", "z", 1, 2) for i in range(3000)]
    messages = spark.createDataFrame(rows, "conv_id long, msg int, parent int, role string, text string, score double, k string, leaf string, path string, rank int, pos int")
    (got,) = chat.format_chats(messages).collect()
    assert chat.parse_chat(got["formatted"]) == [(r[3], r[4]) for r in rows] and len(got["loss_spans"]) == 1500


def test_warc_round_trip(spark):
    big = "<p>x\r\n\r\nWARC/1.1\r\n</p>" * 100
    rows = [(11, "http://long.org", "long \u0928 " * 300_000), (1, "http://a.org/x?y=1", big), (2, "http://a.org/x y", big), (3, None, None), (4, "", ""), (5, "http://b.org", "é"), (6, "http://b.org", "é"), (7, "u", big), (7, "u", big), (None, "n", "null id")]
    clash = "digest string, bytes int, main int, copies int, record_id string, type string, refers_to string"
    pages = spark.createDataFrame([(*r, "d", 1, 2, 3, "r", "t", "q") for r in rows], "capture_id long, url string, payload string, " + clash)
    path = f"{shared_dir(spark)}/warc-test-{random.random()}"
    warc.write_warc(pages, path)
    got = warc.assemble(warc.read_records(spark, path).withColumns({c: F.lit(1) for c in ("salt", "target", "r", "request")})).collect()
    assert sum(r["copies"] for r in got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["capture_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert (r["type"], r["refers_to"]) == (("revisit", 7) if r["capture_id"] in (1, 2) else ("response", None))
        assert r["request"]["http_head"].startswith("GET ")
        if r["type"] == "response":
            assert bytes(r["response"]["payload"]).decode() == html
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    assert files.count() >= 2  # the long payload has a file of its own
    empty = f"{path}-empty"
    warc.write_warc(pages.where("false"), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def test_warc_members_and_cut_files():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    for data in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3, record * 3 + record[:-8]):
        assert [b for _, b in warc.parse_records(data)] == [b"abcde"] * 3


def brute_topk(rows, k):
    ints = {}
    for i, (v, e) in enumerate(rows):
        if v is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            ints[i] = (v, [int(np.floor(1024 * float(np.float32(x)))) for x in e])
    out = []
    for i, (q, mine) in ints.items():
        if q % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(mine, e)), v) for j, (v, e) in ints.items() if j != i)[:k]
        out += [(q, n, v, -s) for n, (s, v) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.2, 1e5])
def test_topk_matches_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * scale * (1 + i % 5)]) for i in range(0, 400, 2)]
    rows += [(i, rows[3][1]) for i in range(1001, 1020)] + [(2000, None), (2100, [1.0, None, 1.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (2400, []), (2500, [1.0]), (None, [1.0] * 6)]
    clash = {c: F.lit(7) for c in ("x", "row", "query", "asks", "norm", "group", "slot", "block", "top", "kth", "ids", "ints", "rank", "score", "step", "need")}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clash)
    got = sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, 7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 7)
    assert topk.top_k(vectors.where("false"), F.lit(True)).count() == 0


def test_topk_of_very_long_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i * 50, [float(x) for x in rng.normal(size=3000 if i % 3 else 1)]) for i in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, 3).collect())
    assert len(got) == 6 * 3 and got[0][0] == 0


def test_topk_rotates_leading_components_only(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROTATED", 3)
    monkeypatch.setattr(topk, "ROWS", 8)
    rng = np.random.default_rng(11)
    rows = [(i * 10, [float(x) for x in rng.normal(size=7)]) for i in range(120)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, 4).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 4)


def test_groups_of_like_needs(monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 10)
    assert topk._groups([(5, 4), (3, 4), (9, 25), (7, 4), (11, 1)]) == [(3, 0, 1), (5, 0, 1), (7, 1, 1), (9, 2, 3), (11, 5, 1)]


def test_topk_leaves_blocks_out_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 32)
    met = []
    monkeypatch.setattr(topk, "staged", lambda df, name, stage=topk.staged: (stage(df, name), met.append(df.count()) if name == "blocks-met" else None)[0])
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * 0.9**(i // 40) for x in rng.normal(size=5)]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, 3).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 3) and met[0] < 3000 / 32 / 2


def test_topk_searches_every_block_of_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(5, [1000.0, 0.0, 0.0, 0.0])] * 40  # two and a half blocks, the longest vectors of all
    rows += [(1000 + i, [float(-900 + i), 1.0, 0.0, 0.0]) for i in range(8)]  # the rest of the third block
    rows += [(i, [float(x) for x in rng.normal(size=4)]) for i in range(100, 500)] + [(0, [-1.0, 0.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    packed = topk.blocks(topk.numbered(vectors, F.lit(False)), 4).select("block").collect()
    assert len(packed) == len({r["block"] for r in packed}) > 3
    got = sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, 7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 7)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice((0, 1, 3, 10, 200)), rng.choice(["b", "a", "c", "é", None])) for i in range(1500)] + [(5000, None, "a"), (5001, "x y", None)]
    rows += [(6000 + i, "tiny words", "tiny") for i in range(3)] + [(None, "n n", "a"), (7, "again again", "b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, k int")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(7)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    for _, g in got.groupby(got["source"].fillna("~")):
        assert g["size"].sum() == g["source_size"].iloc[0] and abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
    assert abs(got.groupby(got["source"].fillna("~"))["target"].first().sum() - got["size"].sum()) < 1e-3
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_very_long_texts(spark):
    rows = [(i, "long " * (200_000 + i), "ab"[i % 2]) for i in range(6)] + [(10 + i, "w " * i, "ab"[i % 2]) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == len(rows) and got["size"].max() == 200_005 and (got["taken"] <= 3 * got["size"]).all()


def test_targets_and_fit():
    t = mixing.targets(pd.DataFrame({"source_size": [10, 1000, 0, 500]}), (5, 2, 1), 1.0, 3.0)["target"]
    assert t[0] == 30 and t[2] == 0 and abs(t.sum() - 1510) < 1e-9
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + n * m for r in reach for m in range(c + 1)}
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(r for r in reach if r <= budget)

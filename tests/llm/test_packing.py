import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from aksharaflow.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))


def check(rows, texts, plain, longest=4096):
    ids = {k: plain.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    seen = {k: 0 for k in texts}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == seen[r["doc_id"]]
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: len(v) for k, v in ids.items()}
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values(), default=0) <= longest and set(at) == set(range(len(at)))
    return at


def test_whole_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    at = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, plain)
    assert sum(at.values()) / (4096 * len(at)) > 0.9


def test_odd_texts_and_repeats(spark, plain):
    texts = ["", None, "a b\t c", "İstanbul Ω’s don't 12½ <|endoftext|> x", "é" * 9000, "é ﬁ Å ªº × naïve ß", "x\x1cy\x85z w", "नेपाल 日本", "I'M THEY'LL 's"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    check(packing.pack_documents(docs).collect(), dict(enumerate(texts)), plain)
    twice = spark.createDataFrame([(None, "a"), (7, "b c"), (7, "b c")], "doc_id long, text string")
    rows = packing.pack_documents(twice).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack_documents(twice.where("false")).count() == 0


def test_pieces_with_clashing_columns_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 2)
    rows = [(i, 0, 1 + i % 3, "a", "b", "c") for i in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, hi string, lo string, rank string")
    got = packing.pack(pieces, 16).toPandas()
    assert (got["rank"] == "c").all() and len(got) == 400
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 16
    assert set(got["sequence_id"]) == set(range(sum(n for n, _ in packing.pack_histogram([1, 2, 3], [134, 133, 133], 16))))


def test_sequences_hold_the_ids(spark, plain):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "jumps " * 30), (3, None)], "doc_id long, text string")
    rows = packing.sequences(packing.pack_documents(docs, longest=16, with_ids=True)).collect()
    for r in rows:
        used = sum(p["length"] for p in r["pieces"])
        assert len(r["ids"]) == (used if used & (used - 1) == 0 else 16)
        for p in r["pieces"]:
            text = {1: "the quick brown fox", 2: "jumps " * 30, 3: ""}[p["doc_id"]]
            ids = plain.encode(text, add_special_tokens=False).ids + [2]
            assert r["ids"][p["offset"] : p["offset"] + p["length"]] == ids[p["start"] : p["start"] + p["length"]]


def test_patterns_hold_the_histogram():
    lengths, counts = [1, 2, 3, 5, 8, 13], [50, 3, 40, 20, 7, 9]
    found = {}
    for packs, inside in packing.pack_histogram(lengths, counts, 13):
        assert sum(inside) <= 13
        for n in inside:
            found[n] = found.get(n, 0) + packs
    assert found == dict(zip(lengths, counts))

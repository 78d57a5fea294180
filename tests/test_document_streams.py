import random
import uuid

import pytest
from pyspark.sql import functions as F

from aksharaflow.functions.staging import shared_dir
from aksharaflow.operators import learning
from aksharaflow.streaming import documents, state

ROCKS = "spark.sql.streaming.stateStore.providerClass"
RESULT = "doc_id long, version long, full boolean, word_no long, word string"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(ROCKS, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(ROCKS)


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def test_full_results_replace_quick_ones(spark):
    path = folder(spark, "results")
    batches = [
        [(1, 1, False, 0, "quick"), (1, 1, False, 1, "more"), (2, 1, False, 0, "two")], [(1, 1, True, 0, "whole")], [(1, 2, False, 0, "newer quick"), (2, 2, False, 0, "two again")],
    ]
    for k, rows in enumerate(batches):
        for _ in range(2):  # a batch that is run again
            documents.publish(spark.createDataFrame(rows, RESULT), k, path)
    got = sorted((r["doc_id"], r["version"], r["full"], r["word"]) for r in documents.current(spark, path, RESULT).collect())
    assert got == [(1, 1, True, "whole"), (2, 2, False, "two again")]


def test_swaps_of_each_document(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    stored = {1: ("a", "x"), 2: ("cd", "yy"), 3: ("a", "a")}
    words = [(d, w.replace(*swap)) for d, swap in stored.items() for w in vocabulary]
    got = learning.document_swaps(spark.createDataFrame(words, "doc_id long, word string"), spark.createDataFrame([(w,) for w in vocabulary], "word string"), ["a", "b", "cd", "e"], least=3).collect()
    assert {(r["doc_id"], r["src"], r["dst"]) for r in got} == {(1, "x", "a"), (2, "yy", "cd")} or {(r["doc_id"], r["src"], r["dst"]) for r in got} >= {(1, "x", "a")}
    for r in got:
        given = [w for d, w in words if d == r["doc_id"] and w not in vocabulary]
        gain = lambda src, dst: sum(w.replace(src, dst) in vocabulary for w in given)
        if r["rank"] == 1:
            pieces = {w[i : i + k] for w in given for k in (1, 2) for i in range(len(w) - k + 1)}
            assert r["n"] == gain(r["src"], r["dst"]) == max(gain(s, t) for s in pieces for t in ("a", "b", "cd", "e"))


def test_a_document_is_learned_once_and_read_by_that(spark):
    root, vocabulary = folder(spark, "learned"), [f"{a}{b}{c}" for a in "bcd" for b in "aeo" for c in ("nk", "rt", "sp")]
    rng = random.Random(2)
    damaged = lambda w: w.replace("a", "q")
    lines = [(d, i, " ".join((damaged if d == 1 else str)(rng.choice(vocabulary)) for _ in range(12)) + ".", d == 1 and i == 1) for i in range(4) for d in (1, 2)]
    source = folder(spark, "lines")
    for i in range(4):
        spark.createDataFrame([x for x in lines if x[1] == i], documents.LearnOnce.LINES).coalesce(1).write.mode("append").parquet(source)
    once = documents.LearnOnce(root, spark.createDataFrame([(w,) for w in vocabulary], "word string"), ("a", "e"), least=2)
    for k in range(4):
        part = spark.createDataFrame([x for x in lines if x[1] == k], documents.LearnOnce.LINES)
        once(part, k)
        if k == 2:
            once(part, k)  # run again after a failure
    got = {(r["doc_id"], r["item"]): r["fixed"] for r in spark.read.schema("doc_id long, item long, text string, fixed string").parquet(*[f"{root}/fixed/batch={k}" for k in range(4)]).collect()}
    assert len(got) == 8
    for d, i, text, _ in lines:
        assert got[d, i] == (text.replace("q", "a") if d == 1 and i >= 1 else text)
    swaps = spark.read.schema(documents.LearnOnce.SWAPS).parquet(*[f"{root}/swaps/batch={k}" for k in range(4)]).collect()
    assert [(r["doc_id"], r["src"], r["dst"]) for r in swaps if r["rank"] > 0] == [(1, "q", "a")]
    # the same by a stream
    again = documents.LearnOnce(folder(spark, "learned"), once.lexicon, once.targets, least=2)
    stream = spark.readStream.schema(documents.LearnOnce.LINES).parquet(source)
    stream.writeStream.foreachBatch(again).option("checkpointLocation", folder(spark, "log")).trigger(availableNow=True).start().awaitTermination()
    fixed = spark.read.schema("doc_id long, item long, text string, fixed string").parquet(f"{again.root}/fixed").collect()
    assert all(r["fixed"] == (r["text"].replace("q", "a") if r["doc_id"] == 1 else r["text"]) for r in fixed) and len(fixed) == 8


def test_contexts_expire(spark, rocksdb):
    rng = random.Random(3)
    rows = [(u, k, rng.randint(0, 4000), rng.choice(["preeti", "pcs"]), rng.randint(0, 3)) for u in range(6) for k in range(40)]
    lines = spark.createDataFrame(rows, "user long, item long, s long, encoding string, converted long").withColumn("ts", F.timestamp_seconds(F.col("s"))).drop("s")
    want = {}
    for u in range(6):
        encoding, since = None, None
        for _, k, s, e, n in sorted((x for x in rows if x[0] == u), key=lambda x: (x[2], x[1])):
            want[u, k] = encoding if since is not None and s - since <= 300 else None
            encoding, since = (e, s) if n >= 2 else (encoding, since)
    assert {(r["user"], r["item"]): r["context"] for r in documents.context_batch(lines).collect()} == want
    path = folder(spark, "context-lines")
    parts = [lines.where(F.col("ts") < F.timestamp_seconds(F.lit(2000))), lines.where(F.col("ts") >= F.timestamp_seconds(F.lit(2000)))]
    got = {}
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    stream = documents.context_stream(spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path), "2 hours")
    got = {(r["user"], r["item"]): r["context"] for r in state.run_to_table(stream, "contexts").collect()}
    assert got == want

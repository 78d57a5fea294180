import corpus_pipeline
from aksharaflow.llm import line_dedup, neardup, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF).cache()
        assert after.columns == docs.columns, name
        if name == "line dedup":
            assert after.count() == now.count()
            assert line_dedup.LineIndex.empty(spark).insert(after).apply(after).where("n_dropped > 0").count() == 0
        if name == "near dedup":
            assert neardup.near_duplicates(after).where("not kept").count() == 0
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 4096).all() and set(packed["doc_id"]) == {r["doc_id"] for r in now.select("doc_id").collect()}


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c", None, "s", 5)], docs.schema))
    for start, ids in ((docs, set()), (odd, {1, 2})):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-2]:
            now = stage(spark, now, SF).cache()
        assert {r["doc_id"] for r in now.collect()} - {None} == ids
        for _, stage in corpus_pipeline.STAGES[-2:]:
            now = stage(spark, now, SF).cache()
        assert {r["doc_id"] for r in now.collect()} == ids & {2}  # texts without words fill no budget


def test_mixing_takes_each_row_of_an_id_by_itself(spark):
    rows = [(7, "a b c", "x"), (7, "d e f g", "x"), (7, "a b c", "x"), *[(20 + i, "h", "y") for i in range(10)], (9, "i", "z"), (None, "j k", "x"), (30, "l", "x")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, row_no int, times string")
    got = corpus_pipeline.mix_sources(spark, docs, SF)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    want = {r["source"]: r["target"] for r in corpus_pipeline.mixing.mix(docs).collect()}
    assert all(abs(words[k] - v) <= 1 for k, v in want.items()), (words, want)


def test_queries_are_registered():
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in queries.queries()} and {*queries.queries(), "pipeline"} <= set(__spark_entry__.queries())

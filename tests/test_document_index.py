"""Lookups in the document index shuffle texts and lines once, not words: their plans, and odd documents."""

import pytest

from aksharaflow.operators import docindex, lineplaces
from aksharaflow.plans import catalogue

DOCS = [(1, "Alpha beta gamma delta epsilon  zeta\nΑΣ Β alpha"), (2, None), (3, ""), (4, "one two\n\ntwo  one"), (None, "Alpha beta gamma")]
SHOWN = [(1, 0, "alpha beta gamma"), (1, 1, "ΑΣΒ"), (1, 2, None), (1, 3, "  "), (2, 0, "one"), (4, 0, "two"), (4, 1, "one two"), (None, 0, "alpha beta gamma"), (9, 0, "beta")]


def exchanges(df) -> int:
    """Shuffles of a query's plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


#: Shuffles of each query: its texts and lines, and what tells where page lines begin.
MOST = {"page_lines_joined": 2}


@pytest.mark.parametrize("name", ["page_lines_joined", "index_nearest", "index_anchors", "index_word_spans", "doubled_runs_dropped", "index_lookup"])
def test_words_are_not_shuffled(spark, name):
    assert exchanges(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")) <= MOST.get(name, 1)


def test_texts_are_as_good_as_an_index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    shown = spark.createDataFrame(SHOWN, "doc_id long, item int, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    starts = spark.createDataFrame([(1, 0), (4, 2)], "doc_id long, word_no int")
    calls = (docindex.lookup, docindex.anchored, docindex.by_words, lineplaces.without_doubled_runs, lineplaces.placed_by_neighbours, lambda i, s: lineplaces.joined_lines(i, starts, s))
    for call in calls:
        got = call(docs, shown)
        assert rows(got) == rows(call(docindex.build(docs), shown)) and got.schema["doc_id"].dataType.simpleString() == "bigint"
    assert {tuple(r) for r in docindex.lookup(docs, shown).collect()} == {(1, 0, 0, "Alpha beta gamma"), (4, 0, 3, "two"), (4, 1, 0, "one two")}  # a sigma that ends a word isn't one inside
    assert {(r["doc_id"], r["item"]): r["text"] for r in lineplaces.without_doubled_runs(docs, shown).collect()} == {(d, i): t for d, i, t in SHOWN}


def test_an_index_is_built_where_its_texts_are(spark):
    built = docindex.build(spark.createDataFrame(DOCS, "doc_id long, text string"))
    assert exchanges(built) == 0
    assert [tuple(r) for r in built.where("doc_id = 4").orderBy("word_no").collect()] == [(4, 0, "one", "one", 0), (4, 1, "two", "two", 3), (4, 2, "two", "two", 6), (4, 3, "one", "one", 9)]

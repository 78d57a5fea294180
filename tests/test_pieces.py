"""Pieces of lines exchanged for others, without shuffling them by their places."""

from pyspark.sql import functions as F

from aksharaflow.operators import keytext, pieces


def test_pieces_are_exchanged(spark):
    lines = [(1, 0, "a b  c"), (1, 1, None), (1, 2, ""), (None, 0, "b b"), (2, 7, "d"), (2, 7, "d")]
    frame = spark.createDataFrame(lines, "doc_id long, item int, text string")
    cut = lambda t: [(p, p if p != "c" else None) for p in t.replace(" ", "| |").split("|")]
    got = pieces.exchanged(frame, cut, lambda keys: keys.where("key IN ('a', 'b', 'c')").select("key", F.upper("key").alias("made")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(d, i, t and t.replace("a", "A").replace("b", "B")) for d, i, t in lines]))
    assert got.schema["item"].dataType.simpleString() == "int"


def test_key_lines_have_no_window_over_tokens(spark):
    made = {}
    lines = spark.createDataFrame([(1, 0, "vf; ( hgf"), (1, 1, "( \x00 )"), (1, 2, "(\x00")], "doc_id long, item int, text string")
    was, keytext.staged = keytext.staged, lambda df, name, **_: made.setdefault(name, df)
    try:
        out = keytext.convert_lines(lines, spark.createDataFrame([], "word string"))
    finally:
        keytext.staged = was
    assert "Window" not in made["key-lines"]._jdf.queryExecution().executedPlan().toString()
    assert {r["item"]: r["text"] for r in out.collect()}[0] == "खास ९ जना"


def test_files_of_one_name_are_told_before_windows_meet_them(spark):
    from aksharaflow.operators import evidence

    files = spark.createDataFrame([(f"/a/{k}.pdf", "(Report)" if k % 3 else "(Other)", None if k == 11 else k % 9) for k in range(30)], "path string, title string, changed long")
    windows = spark.createDataFrame([(k, "Report - Google Chrome" if k % 2 else "other") for k in range(20)], "window_id long, title string")
    out = evidence.files_of_windows(windows, files)
    assert {(r["window_id"], r["path"]) for r in out.collect()} == {(k, "/a/17.pdf" if k % 2 else "/a/15.pdf") for k in range(20)}
    assert out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].count("Window [row_number()") == 1  # below the join


def test_words_of_a_layer_are_not_shuffled(spark):
    from aksharaflow.operators import extracted

    lines = [(1, 0, "घरल] (क6ा3), «बा6» काा"), (1, 1, None), (1, 2, ""), (1, 3, "plain 6  text"), (None, 4, " बा6 ")]
    frame = spark.createDataFrame(lines, "doc_id long, item long, text string")
    lexicon = spark.createDataFrame([(w,) for w in ("का", "घर", "बाट", "कटाघ")], "word string")
    got = extracted.repair_lines(frame, lexicon)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = extracted.repair_lines(frame, lexicon, spark.createDataFrame([], "doc_id long, word string"))
    assert sorted(map(str, got.where("doc_id = 1").collect())) == sorted(map(str, want.where("doc_id = 1").collect()))
    assert {r["item"]: r["text"] for r in got.collect()}[0].endswith("का")


def test_rules_make_the_same_of_pieces_as_of_lines(spark):
    import random

    from aksharaflow.functions import devanagari as deva
    from aksharaflow.operators import extracted

    rng = random.Random(41)
    words = ["क", "का", "९क०", "९०ा०", "ः", "्", "़्क", "बर्ष२५", "प्रमा०ा", "सम्ःना", "घरल]", "म[त", "[क]", "{", "}", "(", ")", "]", "[", "––", "abc", "12", "काा", "ेेपाल", "�", "�ः", "​ँ", "क‍]", "क़", "ऩ", " ", "\x85", "१२स्३०", "", "र्र्", "अाे", ";-", "ऐन,"]
    gaps = [" ", " ", " ", "  ", "\t", "", " ", "\r\n"]
    lines = [(1, k, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 9)))) for k in range(6000)]
    frame = spark.createDataFrame([*lines, (2, 0, None), (None, 1, " ्क ")], "doc_id long, item int, text string").repartition(4)
    c = F.col("text")
    want = frame.select("doc_id", "item", F.when(extracted.has_mark(deva.nfc(c)), extracted.repair_extracted(c)).when(c.rlike("[ऀ-ॿ]"), deva.nfc(c)).otherwise(c).alias("want"))
    none = spark.createDataFrame([], "word string")
    got = {(r["doc_id"], r["item"]): r["text"] for r in extracted.repair_lines(frame, none).collect()}
    assert got == {(r["doc_id"], r["item"]): r["want"] for r in want.collect()}


def test_rules_are_applied_to_distinct_pieces(spark):
    from aksharaflow.operators import extracted

    made, lines = {}, [(1, k, f"घरल] काा {k % 2} ( बा ः  क ) काा") for k in range(40)]
    was, extracted.staged = extracted.staged, lambda df, name, **_: made.setdefault(name, df)
    try:
        out = extracted.repair_lines(spark.createDataFrame(lines, "doc_id long, item long, text string"), spark.createDataFrame([], "word string"))
    finally:
        extracted.staged = was
    assert {r["text"] for r in made["fixed-pieces"].collect()} == {"घरले", "का", "0", "1", "( बा :  क )"}
    assert {r["text"] for r in out.collect()} == {f"घरले का {k} ( बा :  क ) का" for k in range(2)}


def test_spelt_lines_of_the_gain_are_made_once(spark):
    from aksharaflow.plans import planted_queries as planted

    seen, was = [], planted.spelt_lines
    frame = spark.createDataFrame([(1, 0, ["का", "घर", "बे", "का", "काम"]), (2, 3, ["घर"])], "doc_id long, item long, words array<string>")
    planted.spelt_lines = lambda *_: frame.withColumn("words", F.udf(lambda w: w, "array<string>")("words"))
    try:
        out = planted.repair_gain(spark, "")
        seen.append("ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString() or "BatchEvalPython" in out._jdf.queryExecution().executedPlan().toString())
    finally:
        planted.spelt_lines = was
    assert seen == [False]
    assert sorted(map(tuple, out.collect())) == [(1, 5, 2, 0), (2, 1, 0, 0)]


def test_runs_between_exact_words_are_repaired_once(spark):
    import random

    from aksharaflow.operators import extracted

    rng = random.Random(43)
    words = ["काा", "ः", "्क", "घरल]", "[क", "ख]", "प्रमा०ा", "९क०", "abc––", "a––", " क", "��"]
    exact = {(d, w) for d in range(3) for w in rng.sample(words, 3)}
    lines = [(rng.randrange(4), k, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 7)))) for k in range(600)]
    runs = []
    for d, k, text in lines:
        at = len(runs)
        for piece in extracted._PIECE.findall(text):
            if (d, piece) in exact or len(runs) == at or runs[-1][2]:
                runs.append((k, len(runs), (d, piece) in exact, piece))
            else:
                runs[-1] = (*runs[-1][:3], runs[-1][3] + piece)
    frame = spark.createDataFrame([*lines, (1, 1000, None)], "doc_id long, item int, text string").repartition(3)
    known = spark.createDataFrame([*exact, (None, "काा")], "doc_id long, word string")
    pieces = spark.createDataFrame(runs, "item int, run int, exact boolean, piece string")
    for repair in (extracted.repair_extracted, lambda c: F.upper(extracted.repair_extracted(c))):
        want = {k: "" if text is not None else None for _, k, text in [*lines, (1, 1000, None)]}
        for r in pieces.withColumn("new", F.when(F.col("exact"), F.col("piece")).otherwise(repair(F.col("piece")))).orderBy("run").collect():
            want[r["item"]] += r["new"]
        out = extracted.repair_between(frame, known, repair)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["item"]: r["text"] for r in out.collect()} == want


def test_no_rule_has_a_match_in_a_plain_word():
    import random
    import re

    from aksharaflow.functions import devanagari as deva
    from aksharaflow.operators import extracted

    rng, plain = random.Random(44), 0
    signs = [chr(c) for c in range(0x900, 0x980)] + list("क्र्कअआए" * 8)
    rules = re.compile("|".join(f"(?:{p})" for p, _ in [*deva.NFC, *extracted.EXTRACTED]))
    for _ in range(60000):
        word = "".join(rng.choice(signs) for _ in range(rng.randint(1, 6)))
        if extracted._PLAIN.fullmatch(word):
            plain += 1
            assert not rules.search(word), word
    assert plain > 1000


def test_key_lines_are_made_once(spark):
    assert (both := keytext._keyed("vf; hgf 5"))[0] is both[1]
    assert keytext._keyed("vf; ( hgf )") == (["vf;", " ", "(", " ", "hgf", " ", ")"], ["vf;", " ", "( ", " ", "hgf", " ", ")"])
    lines = spark.createDataFrame([(1, 0, "vf; ( hgf")], "doc_id long, item int, text string").withColumn("text", F.udf(lambda t: t)("text"))
    made, was = {}, keytext.staged

    def staged(df, name, **_):
        made[name] = df._jdf.queryExecution().executedPlan().toString()
        return was(df, name)

    keytext.staged = staged
    try:
        out = keytext.convert_lines(lines, spark.createDataFrame([], "word string"))
    finally:
        keytext.staged = was
    assert "EvalPython" in made["plain-lines"] and "EvalPython" not in made["key-lines"]
    assert [r["text"] for r in out.collect()] == ["खास ९ जना"]

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from aksharaflow.operators import detector, docindex, glyphs, intervals, keytext, layout, learning, lexicon
from aksharaflow.plans import catalogue
from aksharaflow.streaming import state


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_lexicon(spark):
    lex = spark.createDataFrame([("walk",), ("make",), ("city",), ("sun",), ("day",), ("day",)], "word string")
    words = spark.createDataFrame([(w,) for w in ("walking", "making", "cities", "sunday", "xyz", "daay", "walk")], "word string")
    assert {r[0] for r in lexicon.known_by_stem(words, lex).collect()} == {"walking", "making", "cities", "walk"}
    assert pairs(lexicon.split_in_two(words, lex)) == [("sunday", "sun", "day")]
    assert pairs(lexicon.candidates(words, lexicon.without_repeats(F.col("word")), lex)) == [("daay", "day")]
    assert pairs(lexicon.unique_by(lex.withColumn("k", lexicon.skeleton(F.col("word"))), "k", "word"))[0] == ("cty", "city")


def test_affixes(spark):
    stems = spark.createDataFrame([("make", ["Q"]), ("walk", ["P"])], "word string, flags array<string>")
    rules = spark.createDataFrame([("S", "Q", "e", "ing", "[a-z]e"), ("S", "P", "", "s", "[a-z]")], "kind string, flag string, strip string, add string, cond string")
    assert pairs(lexicon.affix_forms(stems, rules)) == [("make", "making", "Q"), ("walk", "walks", "P")]
    words = spark.createDataFrame([("making",), ("walks",), ("makes",)], "word string")
    assert pairs(lexicon.known_by_affix(words, stems, rules)) == [("making", "make", "Q"), ("walks", "walk", "P")]


def test_detector_finds_the_planted_model(spark):
    legacy = spark.createDataFrame([("xqz", 50), ("qzx", 50)], "word string, n long")
    plain = spark.createDataFrame([("the", 50), ("and", 50)], "word string, n long")
    model = detector.train_bigrams(legacy, plain)
    words = spark.createDataFrame([("xqz",), ("the",), ("www.x.org",), ("12",)], "word string")
    scores = {r["word"]: r["score"] for r in detector.score_words(words, model, spark.createDataFrame([("the", True)], "word string, common boolean")).collect()}
    assert scores["xqz"] > 300 and scores["the"] < -1200 and scores["www.x.org"] == -2000 and scores["12"] == 0


def test_intervals_match_brute_force(spark):
    rows = [(u, a, a + (a * 7 + u) % 9) for u in range(3) for a in range(0, 60, 5)]
    got = pairs(intervals.merge_intervals(spark.createDataFrame(rows, "u int, a int, b int"), ["u"], "a", "b"))
    want = []
    for u in range(3):
        for _, a, b in sorted(r for r in rows if r[0] == u):
            if want and want[-1][0] == u and a <= want[-1][2]:
                want[-1] = (u, want[-1][1], max(b, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((u, a, b, 1))
    assert got == want


def test_layout(spark):
    across = spark.createDataFrame([(1, 10.0, 0.0, 100.0)], "page int, y double, x0 double, x1 double")
    down = spark.createDataFrame([(1, 50.0, 0.0, 20.0), (1, 200.0, 0.0, 20.0)], "page int, x double, y0 double, y1 double")
    assert pairs(layout.crossings(across, down, ["page"])) == [(1, 50.0, 10.0)]
    cells = spark.createDataFrame([(1, 0, 0, 1, 2, True, "a<b"), (1, 1, 0, 1, 1, False, None), (1, 1, 1, 1, 1, False, "c\td")], "t int, row int, col int, rs int, cs int, th boolean, text string")
    assert layout.table_html(cells, ["t"]).head()[1] == '<table><tr><th colspan="2">a&lt;b</th></tr><tr><td></td><td>c\td</td></tr></table>'
    assert layout.table_text(cells, ["t"]).head()[1] == "a<b\t\n\tc d"
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a int, b int")
    assert pairs(layout.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]


def test_points_in_cells_of_whole_tables(spark, tmp_path):
    rng = random.Random(1)
    customers = [(i, rng.randrange(25)) for i in range(0, 3100)]
    items = [(rng.randrange(4000), rng.randint(1, 7), float(rng.randint(1, 50)), rng.randint(90_000, 10_000_000) / 100) for _ in range(2500)]
    items += items[:20]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pages, want = 104, []
    for (order, line, quantity, price), n in Counter(items).items():
        x, y = quantity * 6, price % 300
        held = [c for c in range(order % pages, 3100, pages) if -1 <= x - customers[c][1] * 12 <= 13 and -1 <= y - c // pages % 10 * 30 <= 31]
        if held:
            want.append((order, line, x, y, n, len(held), min(held)))
    got = pairs(catalogue.QUERIES["point_in_cell_whole"](spark, str(tmp_path)))
    assert got == sorted(want) and {r[1] for r in got} == set(range(1, 8)) and max(r[6] for r in got) > 1500 and max(r[4] for r in got) == 2


def test_tables_of_all_orders(spark):
    sf_dir = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").count().collect()
    html = {r["l_orderkey"]: r["html"] for r in catalogue.QUERIES["table_html_orders"](spark, sf_dir).collect()}
    tsv = {r["l_orderkey"]: r["tsv"] for r in catalogue.QUERIES["table_tsv_orders"](spark, sf_dir).collect()}
    assert {r["l_orderkey"]: r["count"] for r in orders} == {k: h.count("<tr>") for k, h in html.items()} == {k: t.count("\n") + 1 for k, t in tsv.items()}
    assert len(html) > 25 and any('<td colspan="2">Line &amp; &lt;3&gt;</td>' in h for h in html.values())


def test_index(spark):
    docs = spark.createDataFrame([(1, "Abc “def”  ghi"), (2, None), (3, "")], "doc_id long, text string")
    index = docindex.build(docs)
    assert pairs(index.select("word_no", "shown_key", "b_start")) == [(0, "abc", 0), (1, '"def"', 3), (2, "ghi", 8)]
    shown = spark.createDataFrame([(1, 0, '"def" g'), (1, 1, "zzz"), (2, 0, "a")], "doc_id long, item int, text string")
    assert pairs(docindex.lookup(index, shown)) == [(1, 0, 3, "“def” ghi")]


def test_index_is_built_anew_for_another_version(spark, monkeypatch):
    path = f"{state.shared_dir(spark)}/index-version"
    index = docindex.build(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    docindex.save(index, path)
    assert pairs(docindex.load(spark, path)) == pairs(index)
    monkeypatch.setattr(docindex, "VERSION", 2)
    assert docindex.load(spark, path) is None


def test_learning(spark):
    lex = spark.createDataFrame([(w,) for w in ("that", "this", "then", "thin", "with", "both", "cat")], "word string")
    words = spark.createDataFrame([(w,) for w in ("qat", "qis", "qen", "qin", "wiq", "boq", "cat")], "word string")
    assert [tuple(r)[1:3] for r in learning.learn_swaps(words, lex, ["th", "on"]).collect()] == [("q", "th")]
    lines = spark.createDataFrame([(1, ["th", "at", "cat", "xx"])], "line int, pieces array<string>")
    assert learning.group_pieces(lines, lex, ["line"]).head()[1] == "that cat xx"


def test_stream_equals_batch(spark):
    rows = spark.createDataFrame([(d, i, 25, 5 if d == 1 else 20, 3 * (d == 2), d == 3 and i == 2) for d in range(4) for i in range(5)], "doc long, line long, n_words long, n_known long, n_gain long, fault boolean")
    damaged = {(r["doc"], r["line"]) for r in state.damage_batch(rows).where("damaged").collect()}
    assert damaged == {*((1, i) for i in range(2, 5)), *((2, i) for i in range(1, 5)), *((3, i) for i in range(2, 5))}
    path = f"{state.shared_dir(spark)}/in"
    rows.write.mode("overwrite").parquet(path)
    stream = state.grouped_state_stream(spark.readStream.schema(rows.schema).parquet(path))
    assert pairs(state.run_to_table(stream, "t")) == pairs(state.damage_batch(rows))


def test_breaker(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, 1, 99.0), (2, t + dt.timedelta(seconds=30), 1, 99.0), (3, t + dt.timedelta(seconds=61), 1, 1.0)], "event_id long, ts timestamp_ntz, user_id long, value double")
    assert [r["skipped"] for r in state.breaker(rows, 50, 60).orderBy("event_id").collect()] == [False, True, False]


def test_segmentation_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["ab", "abc", "cde", "bcd", "eab", "a", "dea", "cdeab"]
    lines = [(i, [rng.choice(["a", "b", "c", "d", "e", "ab", "cd"]) for _ in range(rng.randint(0, 7))]) for i in range(60)]

    def score(pieces):
        """The best total over all ways to cut a line in groups of up to four pieces."""
        best = 0.0 if not pieces else None
        for k in range(1, min(4, len(pieces)) + 1):
            word = "".join(pieces[:k])
            gain = len(word) ** 1.4 - (k - 1) if word in words else 0.0 if k == 1 else None
            if gain is not None:
                best = max(x for x in (best, gain + score(pieces[k:])) if x is not None)
        return best

    got = learning.group_pieces(spark.createDataFrame(lines, "line int, pieces array<string>"), spark.createDataFrame([(w,) for w in words], "word string"), ["line"])
    texts = {r["line"]: r["text"] for r in got.collect()}
    for i, pieces in lines:
        at, total = 0, 0.0
        for group in texts[i].split(" ") if texts[i] else []:
            n = next(k for k in range(1, 5) if "".join(pieces[at : at + k]) == group)
            total += len(group) ** 1.4 - (n - 1) if group in words else 0.0
            at += n
        assert at == len(pieces) and abs(total - score(pieces)) < 1e-9, (pieces, texts[i])


def test_pieces_are_not_gathered_from_places(spark):
    lines = spark.createDataFrame([(1, k, ["th", "at", "c", "at", f"x{k}"]) for k in range(30)] + [(None, 0, ["th", "at"]), (2, 0, [])], "doc_id long, line int, pieces array<string>")
    out = learning.group_pieces(lines, spark.createDataFrame([("that",), ("cat",)], "word string"), ["doc_id", "line"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "LeftOuter" not in plan
    assert {(r["doc_id"], r["line"]): r["text"] for r in out.collect()} == {**{(1, k): f"that cat x{k}" for k in range(30)}, (None, 0): "that", (2, 0): ""}


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert dict(pairs(layout.components(spark.createDataFrame(edges, "a long, b long")))) == {x: root(x) for x in up}


def test_breaker_matches_brute_force(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=rng.randrange(2000)), rng.randrange(3), rng.random() * 100) for i in range(300)]
    until, want = {}, {}
    for i, t, u, v in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        want[i] = t < until.get(u, t0)
        if not want[i] and v >= 80:
            until[u] = t + dt.timedelta(seconds=60)
    got = state.breaker(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double"), 80.0, 60)
    assert {r["event_id"]: r["skipped"] for r in got.collect()} == want


def test_swap_learning_matches_brute_force(spark):
    lex = ["then", "them", "other", "this", "path", "onset", "upon", "cat"]
    words = [w.replace("th", "q").replace("on", "xy") for w in lex]
    gains = Counter()
    for w in set(words) - set(lex):
        for src in {w[i : i + k] for k in (1, 2) for i in range(len(w) - k + 1)}:
            for dst in ("th", "on"):
                gains[src, dst] += w.replace(src, dst) in lex
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = {(r["src"], r["dst"]): r["n"] for r in learning.swap_gains(frame(words).withColumn("given", F.col("word")), frame(lex), ["th", "on"], 2).collect()}
    assert got == {k: n for k, n in gains.items() if n}
    assert [tuple(r)[1:3] for r in learning.learn_swaps(frame(words), frame(lex), ["th", "on"], least=2, longest=2).collect()] == [("q", "th"), ("xy", "on")]


def test_whole_lexicon_test_and_swaps(spark):
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    lex = frame(["walk", "sun", "day", "cat"])
    got = dict(pairs(lexicon.known_with_endings(frame(["walk", "walkers", "sundays", "xyz", "catsing"]), lex, ["ing", "er", "s"])))
    assert got == {"walk": "word", "walkers": "ending", "sundays": "compound", "catsing": "ending"}
    assert pairs(lexicon.swap_fixes(frame(["cot", "wolk", "sxm", "cat"]), lex, [("o", "a"), ("x", "u"), ("m", "n")])) == [("cot", "cat"), ("sxm", "sun"), ("wolk", "walk")]
    shown = spark.createDataFrame([("cot", "cat", 2), ("wolk", "walk", 1), ("ab", "abc", 5)], "shown string, real string, n long")
    assert pairs(lexicon.confusions(shown)) == [("o", "a", 3)]


def test_index_lookups_of_damaged_lines(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta alpha beta"
    index = docindex.build(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    shown = spark.createDataFrame([(1, 0, "beta gamma delta epsilxn zeta eta"), (1, 1, "gamma delta epsilon qqqqqqqqqqqqqqqqqqqq"), (1, 2, "nothing of it is there")], "doc_id long, item int, text string")
    assert pairs(docindex.anchored(index, shown)) == [(1, 0, 5, "beta gamma delta epsilon zeta eta")]
    assert pairs(docindex.by_words(index, shown.where("item = 0"))) == [(1, 0, 0, 3, "beta gamma delta"), (1, 0, 4, 2, "zeta eta")]
    lines = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "beta x"), (1, 2, "alpha"), (1, 3, "alpha again"), (1, 4, "none")], "doc_id long, item int, text string")


def test_lookup_matches_brute_force(spark):
    rng = random.Random(6)
    texts = {d: " ".join(rng.choice(["a", "bb", "ccc", "long" * 40, "dd"]) for _ in range(120)) for d in range(3)}
    asked = [(d, i, " ".join(t.split()[i : i + 5])[rng.randrange(2) :]) for d, t in texts.items() for i in range(0, 100, 7)]
    want = []
    for d, i, s in asked:
        words = texts[d].split()
        starts = [sum(map(len, words[:k])) for k in range(len(words))]
        key = s.replace(" ", "")
        at = "".join(words).find(key)
        want.append((d, i, at, " ".join(w for w, b in zip(words, starts) if b < at + len(key) and b + len(w) > at)))
    index = docindex.build(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert pairs(docindex.lookup(index, spark.createDataFrame(asked, "doc_id long, item int, text string"))) == sorted(want)


def test_glyphs(spark):
    rows = [(1, i, 6.0 * i, 0.0, 5.5, 10.0, "f", c) for i, c in enumerate("ab cd")] + [(1, 10, 0.3, 0.2, 5.5, 10.0, "f", "a"), (1, 11, 0.3, 0.2, 5.5, 10.0, "g", "x"), (1, 12, 0.0, -14.0, 5.5, 10.0, "f", "e")]
    drawn = spark.createDataFrame(rows, "page int, seq long, x double, y double, width double, size double, font string, text string")
    once = glyphs.without_overprint(drawn, ["page"])
    assert once.count() == len(rows) - 1
    assert [(r["line"], r["text"]) for r in glyphs.words(once, ["page"]).orderBy("word").collect()] == [(1, "ab"), (1, "cd"), (1, "x"), (2, "e")]


def test_key_words_that_a_lexicon_proves(spark):
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    assert pairs(keytext.convert_proved(frame(["x¿", "v6[f", "s]"]), frame(["हरू", "खट्टा"]))) == [("s]", "के"), ("v6[f", "खट्टा"), ("x¿", "हरू")]
    assert pairs(keytext.repair_proved(frame(["नयाा", "लााग", "घर"]), frame(["नयाँ"]))) == [("घर", "घर"), ("नयाा", "नयाँ"), ("लााग", "लाग")]
    assert [r[0] for r in frame(["1!a"]).select(keytext.as_preeti_keys(F.col("word"), "fontasy")).collect()] == ["!1a"]


def test_tried_words_are_sifted_before_they_meet_the_lexicon(spark):
    rows = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    words, others = [f"w{i}" for i in range(3000)], [f"x{i}" for i in range(3000)]
    left = {r["word"] for r in lexicon.possible(rows(words + others), lexicon.hash_bits(rows(words))).collect()}
    assert left >= set(words) and len(left) < 3100
    assert lexicon.possible(rows(words), lexicon.hash_bits(rows([]))).count() == 0
    plan = learning.swap_gains(rows(words).withColumn("given", F.col("word")), rows(others), ["x"], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "mask" in plan


def test_swap_fixes_looks_up_the_last_forms_without_staging_them(spark, monkeypatch):
    names, real = [], lexicon.staged
    monkeypatch.setattr(lexicon, "staged", lambda df, name, *more: (names.append(name), real(df, name, *more))[1])
    rows = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    fixed = lexicon.swap_fixes(rows(["oox", "oxx"]), rows(["aax", "axx"]), [("o", "a")], depth=2)
    assert sorted(tuple(r) for r in fixed.collect()) == [("oox", "aax"), ("oxx", "axx")]
    assert names.count("swap-forms") == 1

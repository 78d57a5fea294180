"""New operators against plain code on random input."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aksharaflow.functions import devanagari as deva
from aksharaflow.operators import alignment, docindex, glyph_readings, grid, lineplaces, offsets, swaps, tagtree


# ---- alignment


def edit_cost(a, b):
    cost = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(cost[j - 1] + (x != y), cost[j] + 1, new[-1] + 1))
        cost = new
    return cost[-1]


def plain_align(a, b):
    """The same alignment by a table of costs and a walk back: keep or exchange first, then remove."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[head:][::-1], b[head:][::-1])) if x != y), min(len(a), len(b)) - head)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    cost = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (x[i - 1] != y[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = len(x), len(y), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                out.append((i, i + 1, j, j + 1))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, i + 1, j, j))
        else:
            j -= 1
            out.append((i, i, j, j + 1))
    merged = []
    for p in [(p[0] + head, p[1] + head, p[2] + head, p[3] + head) for p in reversed(out)]:
        if merged and merged[-1][1] == p[0] and merged[-1][3] == p[2]:
            merged[-1] = (merged[-1][0], p[1], merged[-1][2], p[3])
        else:
            merged.append(p)
    return merged


def test_align_matches_a_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        parts = alignment.align(a, b)
        assert parts == plain_align(a, b)
        same = [(a[i], b[j]) for (_, i1, _, j1), (i2, _, j2, _) in zip([(0, 0, 0, 0), *parts], [*parts, (len(a), len(a), len(b), len(b))]) for i, j in zip(range(i1, i2), range(j1, j2))]
        assert all(x == y for x, y in same) and edit_cost(a, b) == sum(max(i2 - i1, j2 - j1) for i1, i2, j1, j2 in parts)


def test_long_lines_are_aligned_in_little_memory():
    import tracemalloc

    real = [f"w{i % 997}" for i in range(20_000)]
    swapped = [w if i % 5_000 else "?" for i, w in enumerate(real)]
    moved = [w for i, w in enumerate(real) if i != 50]
    moved.insert(60, real[50])  # words of the places that differ are in both
    for shown, want in (swapped, [(i, i + 1, i, i + 1) for i in range(0, 20_000, 5_000)]), (moved + ["x"], None):
        tracemalloc.start()
        parts = alignment.align(shown, real)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64_000_000  # a table of all cells has 400 million
        assert want is None or parts == want
    rng = random.Random(2)
    for _ in range(500):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() < 0.9]
        b.insert(rng.randint(0, len(b)), rng.choice("abz"))
        assert alignment.align(a, b) == plain_align(a, b) and alignment.align(b, a) == plain_align(b, a)


def test_confusions_by_alignment(spark):
    rng = random.Random(2)
    vocabulary = ["parliament", "government", "school", "mountain", "thunder", "river", "house", "stone"]
    lines = []
    for _ in range(150):
        real = [rng.choice(vocabulary) for _ in range(rng.randint(1, 8))]
        shown = [w.replace("ment", "mem").replace("ou", "u") if rng.random() < 0.5 else w for w in real]
        lines.append((" ".join(shown) + ".", " ".join(real) + "."))
    frame = spark.createDataFrame([*lines, (None, "a"), ("", ""), ("x y", None)], "shown string, real string")
    lexicon = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    got = {(r["src"], r["dst"]): r["n"] for r in alignment.learn_confusions(frame, lexicon).collect()}
    want = collections.Counter()
    for shown, real in lines:
        a, b = shown.rstrip(".").split(), real.rstrip(".").split()
        for i1, i2, j1, j2 in plain_align(a, b):
            for x, y in zip(a[i1:i2], b[j1:j2]) if i2 - i1 == j2 - j1 else ():
                parts = plain_align(x, y)
                kept = len(x) - sum(p[1] - p[0] for p in parts)
                if x not in vocabulary and 2 * kept >= 0.6 * (len(x) + len(y)):
                    for p in parts:
                        if p[1] - p[0] <= 3 and p[3] - p[2] <= 3:
                            want[x[p[0] : p[1]], y[p[2] : p[3]]] += 1
    assert got == {k: n for k, n in want.items() if n >= 2 and k[0]} and got
    assert alignment.learn_confusions(frame.where("false"), lexicon).count() == 0


# ---- glyph readings


def test_glyph_readings_are_learned(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6))) for _ in range(120)]
    fonts = {"one": "abc", "two": "ceg"}
    words, tried = [], []
    for font, hidden in fonts.items():
        words += [(font, [x.upper() if x in hidden else x for x in w], rng.randint(1, 9)) for w in vocabulary]
        tried += [(font, x.upper(), rank, c) for i, x in enumerate(hidden) for rank, c in enumerate([hidden[(i + 1) % 3], *"hgfedcba"])]
    args = [spark.createDataFrame(words, "font string, glyphs array<string>, n long"), spark.createDataFrame(tried, "font string, glyph string, rank int, reading string"), spark.createDataFrame([(w,) for w in vocabulary], "word string")]
    got = {(r["font"], r["glyph"]): (r["reading"], r["hits"] == r["total"]) for r in glyph_readings.learn_readings(*args, beam=4).collect()}
    assert got == {(font, x.upper()): (x, True) for font, hidden in fonts.items() for x in hidden}
    start = {(r["font"], r["glyph"]): r["reading"] for r in glyph_readings.learn_readings(*args, rounds=0).collect()}
    assert start["one", "A"] == "b"  # no round: what the font says
    assert glyph_readings.learn_readings(args[0].where("false"), args[1], args[2]).count() == 0


def test_rounds_hold_only_words_that_judge_a_glyph(spark, monkeypatch):
    texts = ["ab%03d" % k for k in range(300)] + ["b%03d" % k for k in range(300)]
    words = spark.createDataFrame([("f", ["A" if c == "a" else c for c in w], 600 - k) for k, w in enumerate(texts)], "font string, glyphs array<string>, n long")
    candidates = spark.createDataFrame([("f", "A", k, c) for k, c in enumerate("xay")], "font string, glyph string, rank int, reading string")
    lexicon = spark.createDataFrame([(w,) for w in texts], "word string")
    was, sizes = glyph_readings.staged, {}

    def staged(df, name):
        out = was(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(glyph_readings, "staged", staged)
    out = glyph_readings.learn_readings(words, candidates, lexicon).collect()
    assert [tuple(r) for r in out] == [("f", "A", "a", sum(range(401, 601)), sum(range(401, 601)))]
    assert max(sizes["glyph-texts"]) == glyph_readings.TOP and max(sizes["glyph-trials"]) == 3 * glyph_readings.TOP


# ---- tags


def walked(elements, content, roles):
    """What a walk down the tree says of each content."""
    first = {}
    for d, i, parent, seq, tag, page in elements:
        key = (seq, parent is not None, parent or 0, tag or "", page is not None, page or 0)
        if (d, i) not in first or key < first[d, i][0]:
            first[d, i] = key, (parent, seq, tag or "", page)
    means = {}
    for d, tag, to in roles:
        if tag not in tagtree.STANDARD:
            means[d, tag] = min(to, means.get((d, tag), to))
    out = {}
    for doc in {k[0] for k in first}:
        kids = collections.defaultdict(list)
        for (d, i), (_, (parent, seq, tag, page)) in first.items():
            if d == doc:
                kids[parent].append((seq, i, tag, page, True))
        for d, parent, seq, page, mcid in content:
            if d == doc:
                kids[parent].append((seq, None, None, page, mcid))
        blocks, tables = [0], []

        def walk(parent, page, block, level, tbl, tr, td, depth):
            for _, i, tag, own, mcid in sorted(kids[parent], key=lambda k: (k[0], k[1] is None)):
                at = page if own is None else own
                if i is None:
                    if at is not None and mcid is not None:
                        out[doc, at, mcid] = (block, level, *(td or (None, None, None)))
                    continue
                for _ in range(6):
                    if tag not in tagtree.STANDARD:
                        tag = means.get((doc, tag), tag)
                b, lv, t, row, cell = block, level, tbl, tr, td
                if tag == "Table":
                    tables.append([])
                    t, row = len(tables) - 1, None
                elif tag == "TR" and t is not None:
                    tables[t].append(0)
                    row = len(tables[t]) - 1
                elif tag in ("TD", "TH") and t is not None:
                    r = row
                    if r is None:
                        tables[t].append(0)
                        r = len(tables[t]) - 1
                    cell = (t, r, tables[t][r])
                    tables[t][r] += 1
                lv = tagtree.HEADINGS.get(tag, lv)
                if tag in tagtree.HEADINGS or tag in tagtree.BLOCKS:
                    blocks[0] += 1
                    b = blocks[0]
                walk(i, at, b, lv, t, row, cell, depth + 1)

        walk(None, None, 0, 0, None, None, None, 0)
    return out


def test_tag_trees_match_a_walk(spark):
    rng = random.Random(4)
    elements, content, roles = [], [], []
    for doc in range(25):
        roles += [(doc, "Zeile", "Reihe"), (doc, "Reihe", "TR"), (doc, "Kreis", "Ring"), (doc, "Ring", "Kreis"), (doc, "TD", "P")]
        nested = rng.random() < 0.5
        for i in range(1, 60):
            parent = None if i == 1 else i - 1 if nested and i < 35 else rng.randint(1, i - 1)
            tag = rng.choice(["Document", "Sect", "H1", "H3", "P", "Table", "TR", "TR", "TD", "TD", "TH", "Zeile", "Kreis", None, "Span"])
            elements.append((doc, i, parent, i, tag, rng.choice([None, None, 1, 2])))
            content.append((doc, i, 100 + i, rng.choice([None, None, None, 3]), rng.choice([i, i, 5, None])))
        elements += [(doc, 70, 71, 1, "P", 1), (doc, 71, 70, 1, "P", 1), (doc, 72, 72, 1, "P", 1), (doc, 73, 999, 1, "P", 1)]
        content += [(doc, 70, 1, 1, 900), (doc, 72, 1, 1, 901), (doc, 73, 1, 1, 902)]
    # a walk can't tell content of one page and number apart by order alone, so each keeps its own
    content = [(d, p, s, page, None if m is None else m * 1000 + p) for d, p, s, page, m in content]
    got = tagtree.marked_content(
        spark.createDataFrame(elements, "doc_id long, id long, parent long, seq long, tag string, page long"), spark.createDataFrame(content, "doc_id long, parent long, seq long, page long, mcid long"),
        spark.createDataFrame(roles, "doc_id long, tag string, means string"),
    ).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == walked(elements, content, roles) and len(got) > 500


def test_tag_trees_are_dealt_once_and_end_at_a_depth(spark):
    deepest = tagtree.DEEPEST
    elements = spark.createDataFrame([(1, i, i - 1 if i else None, 1, "P" if i else "Document", 7) for i in range(deepest + 3)], "doc_id long, id long, parent long, seq long, tag string, page long")
    content = elements.select("doc_id", F.col("id").alias("parent"), F.lit(1).alias("seq"), F.lit(None).cast("long").alias("page"), F.col("id").alias("mcid"))
    got = tagtree.marked_content(elements, content, spark.createDataFrame([], "doc_id long, tag string, means string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["mcid"]: r["block"] for r in got.collect()} == {i: i for i in range(deepest + 1)}


def test_cells_with_row_spans(spark):
    rng = random.Random(5)
    cells = [(t, row, seq, rng.randint(0, 3), rng.randint(0, 3)) for t in range(20) for row in range(6) for seq in range(rng.randint(0, 5))]
    got = sorted(tuple(r) for r in tagtree.placed_with_spans(spark.createDataFrame(cells, "tbl long, row int, seq int, rs int, cs int").repartition(3)).collect())
    want, taken, at = [], set(), None
    for t, row, seq, rs, cs in sorted(cells):
        at, taken = t, taken if t == at else set()
        col = next(c for c in range(99) if (row, c) not in taken)
        taken |= {(row + i, col + j) for i in range(max(1, rs)) for j in range(max(1, cs))}
        want.append((t, row, seq, rs, cs, col))
    assert got == want


# ---- grids


def cells_by_hand(points):
    at = {(h, v): (x, y) for h, v, x, y in points}
    out = set()
    for (h, v), (x, y) in at.items():
        under = sorted((-y2, h2) for (h2, v2), (_, y2) in at.items() if v2 == v and y2 <= y - 2)
        for y2, h2 in under:
            right = sorted((x2, v2) for (h3, v2), (x2, _) in at.items() if h3 == h and x2 >= x + 2 and (h2, v2) in at)
            if right:
                out.add((x, -y2, right[0][0], y, h, v, h2, right[0][1]))
                break
    return out


def grid_points(rng, n=9):
    """A grid of lines of which some crossings are missing, as spans leave them out, and rulings nearly at one place."""
    xs, ys = [30.0 * k for k in range(n)] + [31.0], [20.0 * k for k in range(n)] + [121.5]
    return [(h, 100 + v, x, y) for h, y in enumerate(ys) for v, x in enumerate(xs) if rng.random() < 0.8]


def broadcasts(spark, act):
    """How many executed plans of an action send a table to all tasks by way of the driver."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    act()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    return sum("BroadcastExchange" in runs.apply(i).physicalPlanDescription() for i in range(seen, runs.size()))


def test_grid_joins_are_dealt_by_keys(spark):
    rng = random.Random(31)
    points = [(p, *x) for p in range(3) for x in grid_points(rng)]
    frame = spark.createDataFrame(points, "page long, h long, v long, x double, y double")
    assert broadcasts(spark, lambda: grid.smallest_cells(frame, ["page"]).write.format("noop").mode("overwrite").save()) == 0


def test_grids_and_tables_are_dealt_by_keys(spark):
    rng = random.Random(32)
    points = [(p, *x) for p in range(3) for x in grid_points(rng)]
    cells = grid.smallest_cells(spark.createDataFrame(points, "page long, h long, v long, x double, y double"), ["page"])
    words = spark.createDataFrame([(p, x + 5.0, x + 5.0, x + 4.0, x + 6.0) for p in range(3) for x in range(0, 90, 7)], "page long, x double, y double, x0 double, x1 double")
    act = lambda: grid.whole_tables(grid.grids(cells, ["page"]), words, ["page"]).write.format("noop").mode("overwrite").save()
    assert broadcasts(spark, act) == 0


def test_grid_cells_match_brute_force(spark):
    rng = random.Random(6)
    pages = [grid_points(rng) for _ in range(4)]
    points = spark.createDataFrame([(p, *x) for p, page in enumerate(pages) for x in page], "page long, h long, v long, x double, y double")
    got = collections.defaultdict(set)
    for r in grid.smallest_cells(points, ["page"]).collect():
        got[r["page"]].add(tuple(r[c] for c in ("x0", "y0", "x1", "y1", "h", "v", "h2", "v2")))
    assert dict(got) == {p: cells_by_hand(page) for p, page in enumerate(pages)}
    assert grid.smallest_cells(points.where("false"), ["page"]).count() == 0


def test_crossings_of_a_page_are_dealt_once(spark):
    rng = random.Random(33)
    points = [(p, f"p{p % 2}", *x) for p in range(6) for x in grid_points(rng)] + [(None, "p0", 1, 2, 0.0, 0.0), (0, "p0", 1, None, 0.0, 0.0)]
    frame = spark.createDataFrame(points, "page long, part string, h long, v long, x double, y double")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    cells = grid.smallest_cells(frame.unionByName(frame), ["page", "part"])
    assert store.executionsCount() == before  # nothing is run, and so nothing staged, in rounds
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {(p, f"p{p % 2}", *c) for p in range(6) for c in cells_by_hand([x[2:] for x in points if x[0] == p and x[3] is not None])}
    got = [tuple(r[c] for c in ("page", "part", "x0", "y0", "x1", "y1", "h", "v", "h2", "v2")) for r in cells.collect()]
    assert len(got) == len(want) and set(got) == want


def test_words_meet_cells_by_page(spark):
    rng = random.Random(34)
    x0, y0 = (np.array([rng.randrange(20) for _ in range(30)]) for _ in range(2))
    boxes = [x0, y0, x0 + 1 + x0 % 5, y0 + 1 + y0 % 4]
    x, y = (np.array([rng.randrange(56) / 2 for _ in range(400)]) for _ in range(2))
    assert grid._covered(boxes, x, y).tolist() == [bool(((boxes[0] <= a) & (a <= boxes[2]) & (boxes[1] <= b) & (b <= boxes[3])).any()) for a, b in zip(x, y, strict=True)]
    points = [(p, h, 100 + v, 50.0 * v, 30.0 * h) for p in range(3) for h in range(3) for v in range(4)]
    cells = grid.grids(grid.smallest_cells(spark.createDataFrame(points, "page long, h long, v long, x double, y double"), ["page"]), ["page"])
    words = spark.createDataFrame([(1, 10.0 * k, 40.0, 10.0 * k - 2, 10.0 * k + 2) for k in range(1, 15)] + [(2, None, 40.0, 1.0, 2.0), (None, 20.0, 40.0, 1.0, 2.0)], "page long, x double, y double, x0 double, x1 double")
    tables = grid.whole_tables(cells, words, ["page"])
    assert "Join" not in tables._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in tables.collect()] == [(1, 1, 14, 0, 0)]


def test_whole_tables(spark):
    points = [(1, h, 100 + v, 50.0 * v, 30.0 * h) for h in range(4) for v in range(4) if (h, v) != (1, 1)] + [(2, h, 100 + v, 50.0 * v, 30.0 * h) for h in range(2) for v in range(3)] + [(3, 0, 100, 0.0, 0.0)]
    found = grid.grids(grid.smallest_cells(spark.createDataFrame(points, "page long, h long, v long, x double, y double"), ["page"]), ["page"])
    cells = {(r["page"], r["row"], r["col"], r["rs"], r["cs"]) for r in found.collect()}
    # around the crossing that is missing, cells reach to the next ones: below it, to its left, and from its left downward
    one = {(0, 0, 1, 1), (0, 1, 1, 1), (0, 2, 1, 1), (1, 0, 1, 2), (1, 1, 2, 1), (1, 2, 1, 1), (2, 0, 1, 2), (2, 2, 1, 1)}
    assert cells == {(1, *c) for c in one} | {(2, 0, 0, 1, 1), (2, 0, 1, 1, 1)}
    rng = random.Random(7)
    words = [(p, x, y, x - 5, x + 5) for p in (1, 2) for x, y in ((rng.uniform(-40, 200), rng.uniform(-10, 100)) for _ in range(60))]
    frame = spark.createDataFrame(words, "page long, x double, y double, x0 double, x1 double")
    boxes = collections.defaultdict(list)
    for r in found.collect():
        boxes[r["page"], r["grid"]].append((r["x0"], r["y0"], r["x1"], r["y1"]))
    want = {}
    for (page, g), cs in boxes.items():
        gx0, gy0, gx1, gy1 = min(c[0] for c in cs), min(c[1] for c in cs), max(c[2] for c in cs), max(c[3] for c in cs)
        inside = loose = beside = 0
        for p, x, y, a, b in words:
            if p != page or not gy0 + 1 <= y <= gy1 - 1:
                continue
            if gx0 - 1 <= x <= gx1 + 1:
                held = any(c[0] - 1 <= x <= c[2] + 1 and c[1] - 1 <= y <= c[3] + 1 for c in cs)
                inside, loose = inside + held, loose + (not held)
            else:
                beside += (gx0 - b if x < gx0 else a - gx1) < 12
        if inside and (beside + loose) * 10 <= inside:
            want[page, g] = (inside, loose, beside)
    got = {(r["page"], r["grid"]): (r["inside"], r["loose"], r["beside"]) for r in grid.whole_tables(found, frame, ["page"]).collect()}
    assert got == want
    kept = frame.where("x BETWEEN 2 AND 148 AND y BETWEEN 2 AND 88")
    assert grid.whole_tables(found, kept, ["page"]).count() >= 1


# ---- offsets


def test_maps_give_the_real_text_of_any_range(spark):
    rng = random.Random(8)
    keys = ["k|:tfj", "sfo{", "ul/Psf]", "k7fpF5", "lgodfjnL", "cGt/f{li6«o", "¥of]", "dfkm{t", "v6[f", "x¿", "plain", "12"]
    for k in keys:
        real = deva.rewrite_text("".join({**offsets.key_table("preeti")}.get(c, c) for c in k), deva.WORD_RULES + deva.NFC)
        parts = offsets.key_map(k)
        assert "".join(t for t, _, _ in parts) == real and {i for _, a, b in parts for i in range(a, b)} == set(range(len(k)))
    lines = [(d, i, rng.choice(["", " "]) + "  ".join(rng.choice(keys) for _ in range(rng.randint(0, 4)))) for d in range(3) for i in range(6)]
    frame = spark.createDataFrame(lines, "doc_id long, item int, text string")
    ranges = [(d, i, a, n) for d, i, text in lines for a in range(len(text) + 2) for n in (1, 3, 50)]
    maps = offsets.line_maps(frame)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in offsets.range_texts(maps, spark.createDataFrame(ranges, "doc_id long, item int, offset int, length int")).collect()}
    around = {tuple(r)[:3]: tuple(r)[3:] for r in offsets.word_around(maps, spark.createDataFrame([r[:3] for r in ranges if r[3] == 1], "doc_id long, item int, offset int")).collect()}
    for d, i, text in lines:
        pieces = [(m.start(), m.group(), [(m.group(), 0, len(m.group()))] if m.group().isspace() else offsets.key_map(m.group())) for m in re.finditer(r"\S+|\s+", text)]
        for a in range(len(text) + 2):
            for n in (1, 3, 50):
                real, lo, hi = "", None, None
                for at, shown, parts in pieces:
                    if shown.isspace():
                        x, y = max(a, at), min(a + n, at + len(shown))
                        hit = [(text[x:y], x, y)] if x < y else []
                    else:
                        hit = [(t, at + p, at + q) for t, p, q in parts if at + p < a + n and at + q > a]
                    real += "".join(t for t, _, _ in hit)
                    lo, hi = min([x for _, x, _ in hit] + ([] if lo is None else [lo]), default=None), max([y for _, _, y in hit] + ([] if hi is None else [hi]), default=None)
                assert got.get((d, i, a, n)) == ((real, lo, hi) if lo is not None else None)
            word = next(((at, at + len(s), s, "".join(t for t, _, _ in parts)) for at, s, parts in pieces if at <= a < at + len(s) and not s.isspace()), None)
            assert around.get((d, i, a)) == word


# ---- readings under swaps


def plain_readings(word, table, width):
    beam, i = [(0.0, "")], 0
    while i < len(word):
        size = next((k for k in range(swaps.LONGEST, 1, -1) if i + k <= len(word) and word[i : i + k] in table), 1)
        piece = word[i : i + size]
        grown = {(-(w + more), text + new) for w, text in beam for new, more in [*table.get(piece, []), (piece, 0.0)]}
        beam, i = [(-cost, text) for cost, text in sorted(grown)[:width]], i + size
    return [text for _, text in beam] if word else []


@pytest.mark.parametrize("width", [48, 3])
def test_readings_under_swaps(spark, width):
    import math

    rng = random.Random(9)
    learned = [("q", "th", 40), ("q", "ch", 9), ("x", "en", 30), ("z", "a", 50), ("z", "i", 45), ("xz", "sta", 3), ("zz", "", 7), ("", "no", 1)]
    words = ["".join(rng.choice("qxzab") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    lexicon = ["".join(rng.choice(["th", "ch", "en", "a", "i", "b"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    frame = spark.createDataFrame([(1, w) for w in words] + [(2, "qa")], "doc_id long, word string")
    rows = spark.createDataFrame([(1, *x) for x in learned], "doc_id long, src string, dst string, n long")
    table = collections.defaultdict(list)
    for src, dst, n in learned:
        if src:
            table[src].append((dst, math.log1p(n)))
    got = collections.defaultdict(list)
    for r in swaps.all_readings(frame, rows, width).orderBy("rank").collect():
        got[r["doc_id"], r["word"]].append(r["reading"])
    assert got.pop((2, "qa")) == ["qa"]
    assert dict(got) == {(1, w): plain_readings(w, table, width) for w in words if w}
    only = {r["word"]: r["fixed"] for r in swaps.only_readings(frame.where("doc_id = 1"), rows, spark.createDataFrame([(w,) for w in lexicon], "word string"), width).collect()}
    made = {w: {x for x in plain_readings(w, table, width) if x != w and x in set(lexicon)} for w in words}
    assert only == {w: next(iter(m)) for w, m in made.items() if len(m) == 1}


def test_swaps_that_drawing_suggests(spark):
    words = ["रामपरु", "घटना", "कक्का", "क्ष", "वटा", "a", ""]
    got = collections.defaultdict(set)
    for r in swaps.drawn_swaps(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        got[r["word"]].add((r["src"], r["dst"]))
    letter = lambda c: "क" <= c <= "ह" or "क़" <= c <= "य़"
    for w in words:
        want = set()
        for k in range(len(w) - 1):
            if letter(w[k]) and letter(w[k + 1]):
                if w[k + 2 : k + 3] in ("ु", "ू", "ृ"):
                    want.add((w[k : k + 3], w[k] + w[k + 2] + w[k + 1]))
                if k == 0 or w[k - 1] != "्":
                    want |= {(w[k : k + 2], "ि" + w[k + 1])} | ({(w[k : k + 2], w[k] + deva.REPH_MARK)} if w[k] == w[k + 1] else set())
        assert got.get(w, set()) == want


def test_drawn_swaps_converts_distinct_runs(spark, tmp_path):
    from aksharaflow.plans.learning_queries import drawn_swaps

    spark.createDataFrame([(i, "s/ky sfd s/ky") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = drawn_swaps(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(text" not in plan  # conversion isn't fused with what reads the texts


# ---- places of lines


def dropped_by_hand(lines, docs, longest):
    key = lambda w: w.lower().translate(str.maketrans("‘’“”–—", "''\"\"--"))
    whole = {d: "".join(key(w) for w in text.split()) for d, text in docs}
    out = []
    for d, item, text in lines:
        toks = text.split()
        ks = [key(w) for w in toks]
        found = []
        for i in range(len(ks)):
            for n in range(1, min(longest, len(ks) - 1 - i) + 1):
                once, j = "".join(ks[i : i + n]), i + n
                stop = next((s for s in range(j + 1, len(ks) + 1) if "".join(ks[j:s]) == once), None)
                if len(once) >= (4 if n == 1 else 3) and stop and once in whole[d] and once * 2 not in whole[d]:
                    found.append((i, -stop, j, stop))
        gone = set()
        for _, _, j, stop in sorted(found):
            if not gone & set(range(j, stop)):
                gone |= set(range(j, stop))
        out.append((d, item, " ".join(w for k, w in enumerate(toks) if k not in gone) if gone else text))
    return sorted(out)


def test_doubled_runs_match_brute_force(spark):
    rng = random.Random(10)
    docs = [(d, " ".join(rng.choice(["Alpha", "beta", "gamma", "de", "lta", "delta", "ox"]) for _ in range(25))) for d in range(6)]
    lines = []
    for d, text in docs:
        toks = text.split()
        for item in range(12):
            i, n = rng.randint(0, 20), rng.randint(1, 4)
            lines.append((d, item, " ".join([*toks[i : i + n], *toks[i : i + n] * rng.randint(0, 2), *toks[i + n : i + n + 3]])))
    lines += [(0, 50, ""), (0, 51, "delta de lta"), (0, 52, "gamma")]
    index = docindex.build(spark.createDataFrame(docs, "doc_id long, text string"))
    frame = spark.createDataFrame(lines, "doc_id long, item int, text string")
    got = sorted(tuple(r) for r in lineplaces.without_doubled_runs(index, frame, 5).collect())
    assert got == dropped_by_hand(lines, docs, 5) and any(a != b for a, b in zip(got, sorted(lines)))


def test_longest_chains(spark):
    rng = random.Random(11)
    texts, words = [], []
    for d in range(40):
        tokens, ws = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        texts.append((d, " ".join(tokens)))
        words += [(d, k, w) for k, w in enumerate(ws)]
    got = collections.defaultdict(list)
    for r in lineplaces.placed_in_order(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(words, "doc_id long, word_no long, word string")).collect():
        got[r["doc_id"]].append((r["word_no"], r["token_no"]))
    for d, text in texts:
        tokens, ws = text.split(), [w for k, _, w in words if k == d]
        best = [[0] * (len(tokens) + 1) for _ in range(len(ws) + 1)]
        for i, w in enumerate(ws):
            for j, t in enumerate(tokens):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (w == t))
        chain = sorted(got[d])
        assert len(chain) == best[-1][-1] and all(ws[a] == tokens[b] for a, b in chain) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))


def test_places_by_neighbours(spark):
    rng = random.Random(12)
    docs, lines = [], []
    for d in range(8):
        parts = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 5))] for _ in range(14)]
        docs.append((d, " ".join(w for p in parts for w in p)))
        lines += [(d, k, " ".join(p)) for k, p in enumerate(parts) if rng.random() < 0.8]
    lines += [(0, 99, "nowhere at all"), (0, 98, "")]
    got = {(r["doc_id"], r["item"]): (r["word_no"], r["votes"]) for r in lineplaces.placed_by_neighbours(docindex.build(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(lines, "doc_id long, item int, text string")).collect()}
    want = {}
    for d, text in docs:
        ks, mine, past = text.split(), sorted((i, t.split()) for k, i, t in lines if k == d and t), -1
        for n, (item, ws) in enumerate(mine):
            places = [p for p in range(len(ks)) if ks[p : p + min(3, len(ws))] == ws[:3]]
            votes = {p: (n > 0 and p > 0 and ks[p - 1] == mine[n - 1][1][-1]) + (n + 1 < len(mine) and ks[p + len(ws) : p + len(ws) + 1] == mine[n + 1][1][:1]) for p in places}
            best = [p for p in places if votes[p] == max(votes.values())]
            if best:
                p = next((p for p in best if p >= past), best[0])
                want[d, item] = (p, votes[p])
                past = max(past, p) if len(best) == 1 else past
    assert got == want


# ---- overprint


def test_overprint_by_plain_patterns(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice(["ab", "a-", "xyz", "- ", "शीर्षक", "é", "q"]) for _ in range(rng.randint(1, 6))) * rng.randint(1, 5) + rng.choice(["", "fff", " tail"]) for _ in range(300)] + ["eineineinge" * 4, "--- " * 9, "x" * 2001, "abcabcabcdd"]
    letters = lambda p: sum(c.isalpha() or "ऀ" <= c <= "ॿ" and not "०" <= c <= "९" for c in p)

    def shortest(t, i):
        """The shortest piece at i with two letters, three characters or more, that stands three times in a row."""
        return next(((n, k) for n in range(3, (len(t) - i) // 3 + 1) if letters(t[i : i + n]) >= 2 for k in [next(k for k in range(1, len(t)) if t[i + k * n : i + (k + 1) * n] != t[i : i + n])] if k >= 3), None)

    def once(t):
        if not 9 <= len(t) <= 2000:
            return t
        n = next((n for n in range(3, len(t) // 3 + 1) if len(t) % n == 0 and letters(t[:n]) >= 2 and t[:n] * (len(t) // n) == t), None)
        out = t[:n] if n else None
        if out is None:
            out, i = "", 0
            while i < len(t):
                hit = shortest(t, i)
                out, i = (out + t[i : i + hit[0]], i + hit[0] * hit[1]) if hit else (out + t[i], i + 1)
        return re.sub(deva.OVERPRINT_SIGN, r"\1", out) if out != t else t

    got = [r["o"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", deva.collapse_overprint(F.col("t")).alias("o")).orderBy("k").collect()]
    assert got == [once(t) for t in texts]


# ---- lines of key text


def test_key_lines(spark):
    from aksharaflow.operators import keytext

    pairs = [
        ("vf; ( hgf", "खास ९ जना"), ("(s) v", "(क) ख"), ("()", "९०"), ("())", "९००"), ("())))", "९००००"), ("()()", "९०९०"), ("(!)", "(१)"), ("(@)*#)", "(२०८३)"), ("!):))", "१०:००"), ("%:#)", "५:३०"), ("!:))", "१:००"),
        ("• 12  5", "• 12  छ"), ("( x", "( ह"), ("s &amp; v", "क ७ ख"), ("baM sM", "दब: कः"), ("  ", "  "), ("", ""), (None, None), ("नेपाल s", "नेपाल क"), ("‘sf", "‘का"),
    ]
    lines = spark.createDataFrame([(1, k, a) for k, (a, _) in enumerate(pairs)], "doc_id long, item int, text string")
    lexicon = spark.createDataFrame([("दब",), ("कः",), ("क",)], "word string")
    got = {r["item"]: r["text"] for r in keytext.convert_lines(lines, lexicon).collect()}
    assert [got[k] for k in range(len(pairs))] == [b for _, b in pairs]


# ---- extracted lines


def test_exact_words_are_never_touched(spark):
    from aksharaflow.operators import extracted

    lines = [(1, 0, "बोलेका] काा घर"), (1, 1, "काा"), (1, 2, None), (1, 3, "plain 6 text"), (2, 0, "काा  बा6 गनर्"), (2, 1, "ल] काा")]
    frame = spark.createDataFrame(lines, "doc_id long, item long, text string")
    exact = spark.createDataFrame([(1, "काा"), (2, "ल]"), (2, "ल]")], "doc_id long, word string")
    lexicon = spark.createDataFrame([(w,) for w in ("का", "घर", "बाट", "गर्न", "बोलेको")], "word string")
    got = {(r["doc_id"], r["item"]): r["text"] for r in extracted.repair_lines(frame, lexicon, exact).collect()}
    assert got == {(1, 0): "बोलेको काा घर", (1, 1): "काा", (1, 2): None, (1, 3): "plain 6 text", (2, 0): "का  बाट गर्न", (2, 1): "ल] का"}
    marks = [r["m"] for r in spark.createDataFrame([("काा",), ("नेपाल",), ("घरल]",), ("ि",), ("a�",), ("घ�",), (None,)], "t string").select(extracted.has_mark(F.col("t")).alias("m")).collect()]
    assert marks == [True, False, True, True, False, True, False]


# ---- damaged lines in the index


def test_lines_located_by_anchors_and_spans(spark):
    rng = random.Random(14)
    docs = {d: [rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(60)] for d in range(4)}
    lines = []
    for d, ws in docs.items():
        for item in range(14):
            i, n = rng.randint(0, 50), rng.randint(1, 9)
            part = list(ws[i : i + n])
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = rng.choice(["zz", "a", "q"])
            lines.append((d, item, " ".join(part)))
    index = docindex.build(spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs.items()], "doc_id long, text string"))
    frame = spark.createDataFrame(lines, "doc_id long, item int, text string")
    anchored, spans = {}, set()
    for d, item, text in lines:
        ws, ks = docs[d], text.split()
        once = {r: p for p, r in enumerate(zip(ws, ws[1:], ws[2:])) if sum(x == r for x in zip(ws, ws[1:], ws[2:])) == 1}
        votes = collections.Counter(once[r] - p for p, r in enumerate(zip(ks, ks[1:], ks[2:])) if r in once)
        if votes:
            first = min(votes, key=lambda x: (-votes[x], x))
            there = ws[max(0, first) : first + len(ks)]
            a, b = "".join(there), "".join(ks)
            if 100 * sum(min(a.count(x), b.count(x)) for x in set(b)) >= 90 * max(len(a), len(b)):
                anchored[d, item] = (len("".join(ws[: max(0, first)])), " ".join(there))
        readings = collections.defaultdict(set)
        for n in range(1, 5):
            for p in range(len(ws) - n + 1):
                readings["".join(ws[p : p + n])].add(" ".join(ws[p : p + n]))
        at = 0
        while at < len(ks):
            n = next((n for n in range(min(4, len(ks) - at), 0, -1) if len(readings.get("".join(ks[at : at + n]), ())) == 1), None)
            if n:
                spans.add((d, item, at, n, *readings["".join(ks[at : at + n])]))
            at += n or 1
    assert {(r["doc_id"], r["item"]): (r["place"], r["words"]) for r in docindex.anchored(index, frame).collect()} == anchored and anchored
    assert {tuple(r) for r in docindex.by_words(index, frame).collect()} == spans and spans

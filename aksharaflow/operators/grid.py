"""Tables drawn with lines: smallest cells from crossings, grids of cells, whole tables, and paragraphs that their lines prove."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Points within which lines and corners are the same.
TOLERANCE = 2.0
#: Points beside a table within which a word belongs to its rows; words farther away are another column of the page.
BESIDE = 12.0
#: How tables of a page's parts meet: shuffled, never as a whole in the driver, however small their files are.
MEET = "merge"
#: Rows that a task hands back at once, at most.
ROWS = 10_000


def numbered_crossings(across: DataFrame, down: DataFrame, by: list[str], bucket: float = 64.0) -> DataFrame:
    """by, h, v, x, y: which ruling across (h, y, x0, x1) meets which ruling down (v, x, y0, y1); by buckets of x."""
    cell = lambda c: F.floor(c / bucket)
    a = across.withColumn("_b", F.explode(F.sequence(cell(F.col("x0") - TOLERANCE), cell(F.col("x1") + TOLERANCE))))
    d = down.withColumn("_b", cell(F.col("x")))
    meet = F.col("x").between(F.col("x0") - TOLERANCE, F.col("x1") + TOLERANCE) & F.col("y").between(F.col("y0") - TOLERANCE, F.col("y1") + TOLERANCE)
    return a.join(d.hint(MEET), [*by, "_b"]).where(meet).select(*by, "h", "v", "x", "y")


def _by_page(rows: DataFrame, by: list[str], each: Callable[[pa.Table], pa.Table | None], ddl: str, last: Sequence[str] = ()) -> DataFrame:
    """The rows that each(page) makes of the rows of a page (by), which are dealt by page once and sorted (by `last` within a page); a
    stream over them holds one page at a time. Rows whose page isn't known are left out."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def made() -> Iterator[pa.RecordBatch]:
            out = each(pa.Table.from_batches(parts).combine_chunks()) if parts else None
            if out is not None and out.num_rows:
                yield from out.select(schema.names).cast(schema).to_batches(max_chunksize=ROWS)

        for batch in batches:
            if not batch.num_rows:
                continue
            pages = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
            ends = np.flatnonzero(np.logical_or.reduce([p[1:] != p[:-1] for p in pages])) + 1
            for a, b in itertools.pairwise([0, *ends.tolist(), batch.num_rows]):
                page = tuple(p[a] for p in pages)
                if page != at:
                    yield from made()
                    at, parts = page, []
                parts.append(batch.slice(a, b - a))
        yield from made()

    return rows.dropna(subset=by).repartition(*by).sortWithinPartitions(*by, *last).mapInArrow(run, ddl)


def _kinds(rows: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def _numbers(page: pa.Table, *columns: str) -> list[np.ndarray]:
    return [page.column(c).cast("double").to_numpy() for c in columns]


def _numbered(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Columns with numbers from 0 for their values, equal ones for equal values."""
    numbers = np.unique(np.concatenate([c.to_numpy(zero_copy_only=False) for c in columns]), return_inverse=True)[1]
    return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1])


def smallest_cells(points: DataFrame, by: list[str]) -> DataFrame:
    """by, x0, y0, x1, y1, h, v, h2, v2: the rectangles of crossings (by, h, v, x, y; y grows upward): for each crossing the nearest
    ruling below with which its own ruling across shares a further ruling down to the right, and of these the nearest. Rulings
    less than the tolerance away are no other rulings.

    Crossings are dealt by page once. On a page, each ruling across is the set of rulings down that it meets, as bits from the left, so
    that what two share to the right of a third is one operation."""
    ddl = f"{_kinds(points, *by)}, {_kinds(points, 'x').replace('`x`', 'x0')}, {_kinds(points, 'y').replace('`y`', 'y0')}, x1 double, {_kinds(points, 'y').replace('`y`', 'y1')}, {_kinds(points, 'h', 'v')}, {_kinds(points, 'h').replace('`h`', 'h2')}, {_kinds(points, 'v').replace('`v`', 'v2')}"

    def cells(page: pa.Table) -> pa.Table | None:
        (h,), (v,) = _numbered(page.column("h")), _numbered(page.column("v"))
        keep = np.unique(h * (v.max() + 1) + v, return_index=True)[1]
        page, h, v = page.take(keep), h[keep], v[keep]
        x, y = _numbers(page, "x", "y")
        # rulings down by number from the left, and the number of the first that is far enough to the right
        vx = np.full(v.max() + 1, np.inf)
        np.minimum.at(vx, v, x)
        order = np.argsort(vx, kind="stable")
        r = np.argsort(order)[v]
        right = np.searchsorted(vx[order], vx[order] + TOLERANCE).tolist()
        some = np.zeros(len(order), dtype="int64")
        some[r] = np.arange(len(r))
        met = np.zeros((h.max() + 1, len(order)), dtype=bool)
        met[h, r] = True
        lines = [int.from_bytes(row.tobytes(), "little") for row in np.packbits(met, axis=1, bitorder="little")]
        down = np.lexsort((h, -y, r))
        found = []
        for column in np.split(down, np.flatnonzero(np.diff(r[down])) + 1):
            first = right[r[column[0]]]
            if first == len(order):
                continue
            beyond = [lines[k] >> first for k in h[column].tolist()]
            lower = np.searchsorted(-y[column], -y[column] + TOLERANCE).tolist()
            for i, mine in enumerate(beyond):
                if mine:
                    for j in range(lower[i], len(beyond)):
                        if shared := mine & beyond[j]:
                            found.append((column[i], column[j], first + (shared & -shared).bit_length() - 1))
                            break
        if not found:
            return None
        at, below, to = np.array(found, dtype="int64").T
        one = page.take(at)
        under = page.take(below)
        columns = {c: one.column(c) for c in by} | {"x0": one.column("x"), "y0": under.column("y"), "x1": pa.array(vx[order][to]), "y1": one.column("y"), "h": one.column("h"), "v": one.column("v")}
        return pa.table(columns | {"h2": under.column("h"), "v2": page.column("v").take(some[to])})

    return _by_page(points.select(*by, "h", "v", "x", "y").dropna(), by, cells, ddl)


def _snapped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in order, and their numbers from 0, of those that lie apart by more than the tolerance from the one before."""
    values = np.unique(values)
    return values, np.cumsum(np.diff(values, prepend=values[:1]) > TOLERANCE)


def _components(corners: np.ndarray) -> np.ndarray:
    """A number for each row of corners (numbers, from 0), equal for those that are connected over equal ones."""
    of = list(range(corners.max() + 1))

    def root(k: int) -> int:
        while of[k] != k:
            of[k] = k = of[of[k]]
        return k

    for first, *others in corners.tolist():
        a = root(first)
        for k in others:
            of[root(k)] = a
    return np.array([root(k) for k in corners[:, 0].tolist()])


def grids(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, grid, row, col, rs, cs, x0, y0, x1, y1: cells that share corners are one grid, with rows from the top and columns from the
    left; spans are how many of the grid's rows and columns a cell covers. Grids of one cell, or of one column, are none.
    Grids of a page have numbers from 1, by their first cells from the top and then the left."""
    ends = ("x0", "y0", "x1", "y1")

    def found(page: pa.Table) -> pa.Table | None:
        x0, y0, x1, y1 = _numbers(page, *ends)
        (h, h2), (v, v2) = _numbered(page.column("h"), page.column("h2")), _numbered(page.column("v"), page.column("v2"))
        order = np.lexsort((v2, h2, v, h, x0, -y1))
        page, (x0, y0, x1, y1, h, v, h2, v2) = page.take(order), (c[order] for c in (x0, y0, x1, y1, h, v, h2, v2))
        n = max(v.max(), v2.max()) + 1
        corners = np.unique(np.stack([h * n + v, h2 * n + v2, h2 * n + v, h * n + v2], axis=1), return_inverse=True)[1].reshape(-1, 4)
        _, first, of = np.unique(_components(corners), return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(first))[of] + 1
        kept = []
        for k in np.split(np.argsort(number, kind="stable"), np.flatnonzero(np.diff(np.sort(number))) + 1):
            (xs, i), (ys, j) = _snapped(np.concatenate([x0[k], x1[k]])), _snapped(np.concatenate([-y0[k], -y1[k]]))
            col, col2, row, row2 = i[np.searchsorted(xs, x0[k])], i[np.searchsorted(xs, x1[k])], j[np.searchsorted(ys, -y1[k])], j[np.searchsorted(ys, -y0[k])]
            real = (col2 > col) & (row2 > row)
            if real.sum() >= 2 and col2[real].max() >= 2:
                kept.append(np.stack([k, row, col, row2 - row, col2 - col])[:, real])
        if not kept:
            return None
        k, *places = np.concatenate(kept, axis=1)
        page = page.take(k)
        return pa.table({c: page.column(c) for c in by} | {"grid": number[k]} | dict(zip(("row", "col", "rs", "cs"), places, strict=True)) | {c: page.column(c) for c in ends})

    ddl = f"{_kinds(cells, *by)}, grid long, row int, col int, rs int, cs int, {_kinds(cells, *ends)}"
    return _by_page(cells.select(*by, *ends, "h", "v", "h2", "v2"), by, found, ddl)


def _places(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values stand among sorted edges: odd numbers on one, even ones between two."""
    return np.searchsorted(edges, values, "left") + np.searchsorted(edges, values, "right")


def _covered(boxes: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points any of the boxes (x0, y0, x1, y1, ends included) holds: a sweep upward over the places of points among the ends of
    boxes, with the number of open boxes along x."""
    x0, y0, x1, y1 = boxes
    xs, ys = np.unique(np.concatenate([x0, x1])), np.unique(np.concatenate([y0, y1]))
    at, rise = _places(xs, x), _places(ys, y)
    left, behind = _places(xs, x0), _places(xs, x1) + 1
    opens, closes = _places(ys, y0), _places(ys, y1) + 1
    when, side = np.concatenate([opens, closes, opens, closes]), np.concatenate([left, left, behind, behind])
    sign = np.repeat([1, -1, -1, 1], len(x0))
    order = np.argsort(when, kind="stable")
    when, side, sign = when[order], side[order], sign[order]
    steps, held, done = np.zeros(2 * len(xs) + 2, dtype="int64"), np.zeros(len(x), dtype=bool), 0
    up = np.argsort(rise, kind="stable")
    for points in np.split(up, np.flatnonzero(np.diff(rise[up])) + 1):
        upto = np.searchsorted(when, rise[points[0]], "right")
        np.add.at(steps, side[done:upto], sign[done:upto])
        done = upto
        held[points] = np.cumsum(steps)[at[points]] > 0
    return held


def whole_tables(cells: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """by, grid, inside, loose, beside of grids (of cells) that are tables: with words (by, x, y: their middles, x0, x1) inside cells,
    and at most a tenth as many inside the grid but in no cell, or right beside it on its rows. Cells and words are dealt by page."""
    number = lambda c: F.col(c).cast("double").alias(c)
    none = F.lit(None).cast("double")
    rows = cells.select(*by, "grid", *map(number, ("x0", "y0", "x1", "y1")), none.alias("x"), none.alias("y"))
    rows = rows.unionByName(words.where("x IS NOT NULL AND y IS NOT NULL").select(*by, F.lit(None).cast(cells.schema["grid"].dataType).alias("grid"), number("x0"), none.alias("y0"), number("x1"), none.alias("y1"), number("x"), number("y")))

    def counted(page: pa.Table) -> pa.Table | None:
        size = page.num_rows - page.column("grid").null_count  # words stand first
        x, y, wx0, wx1 = (c[: page.num_rows - size] for c in _numbers(page, "x", "y", "x0", "x1"))
        up = np.argsort(y, kind="stable")
        x, y, wx0, wx1 = x[up], y[up], wx0[up], wx1[up]
        own = page.slice(page.num_rows - size)
        boxes = np.stack(_numbers(own, "x0", "y0", "x1", "y1")) if size else np.zeros((4, 0))
        (grid,) = _numbered(own.column("grid")) if size else (np.zeros(0, dtype="int64"),)
        out = []
        for k in np.split(np.arange(size), np.flatnonzero(np.diff(grid)) + 1) if size and len(x) else []:
            x0, y0, x1, y1 = boxes[:, k]
            gx0, gy0, gx1, gy1 = x0.min(), y0.min(), x1.max(), y1.max()
            rows_of = slice(np.searchsorted(y, gy0 + 1, "left"), np.searchsorted(y, gy1 - 1, "right"))
            wx, wy, a, b = x[rows_of], y[rows_of], wx0[rows_of], wx1[rows_of]
            within = (wx >= gx0 - 1) & (wx <= gx1 + 1)
            held = _covered([x0 - 1, y0 - 1, x1 + 1, y1 + 1], wx[within], wy[within]).sum()
            beside = (~within & (np.where(wx < gx0, gx0 - b, a - gx1) < BESIDE)).sum()
            out.append((k[0], held, within.sum() - held, beside))
        if not out:
            return None
        at, *sums = np.array(out, dtype="int64").T
        own = own.take(at)
        return pa.table({c: own.column(c) for c in [*by, "grid"]} | dict(zip(("inside", "loose", "beside"), sums, strict=True)))

    ddl = f"{_kinds(cells, *by, 'grid')}, inside long, loose long, beside long"
    return _by_page(rows, by, counted, ddl, ["grid"]).where("inside > 0 AND (beside + loose) * 10 <= inside")


def paragraph_alignment(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, align, indent, first: of paragraphs whose lines (by, line, a, b: their ends; left, right: the text area's) prove it: justify,
    left, center or right, with the indents of the paragraph and of its first line in points. Others have no row.

    A paragraph is one group of counts, minima and maxima; its first and last lines are told apart by windows."""
    w, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("line")
    rows = lines.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(order), "L": F.min("a").over(w), "R": F.max("b").over(w)})
    first, last, width = F.col("k") == 1, F.col("k") == F.col("n"), F.col("right") - F.col("left")
    near = lambda x, y: F.abs(x - y) <= TOLERANCE
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    unless = lambda skip, c: F.when(~skip, c)
    a, b, left, right = (F.col(c) for c in ("a", "b", "left", "right"))
    big = F.greatest(F.lit(30.0), 0.08 * width)
    g = rows.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("L").alias("L"), F.max("R").alias("R"), F.max("left").alias("left"), F.max("right").alias("right"), F.max(F.when(first, a)).alias("a1"), F.max(F.when(last, b)).alias("bn"),
        every(unless(last, near(b, F.col("R")))).alias("right_even"), every(unless(first, near(a, F.col("L")))).alias("left_even"), (F.max(unless(last, b)) - F.min(unless(last, b))).alias("ragged"),
        every(near((a + b) / 2, (left + right) / 2) & (a - left >= big) & (right - b >= big)).alias("middle"), (F.max(b - a) - F.min(b - a)).alias("varied"),
        every(near(b, right) & (a - left >= 0.4 * width)).alias("at_right"),
    ).where("right > left")
    wide = (F.col("R") - F.col("L")) / (F.col("right") - F.col("left"))
    align = (
        F.when((F.col("n") >= 3) & (wide >= 0.6) & F.col("right_even") & F.col("left_even") & (F.col("bn") < F.col("R") - 10), "justify")
        .when((F.col("n") >= 3) & F.col("left_even") & near(F.col("a1"), F.col("L")) & (F.col("ragged") > 15) & (wide >= 0.5), "left")
        .when(F.col("middle") & ((F.col("n") == 1) | (F.col("varied") > 10)), "center").when(F.col("at_right"), "right")
    )
    told = g.withColumn("align", align).where("align IS NOT NULL")
    flows = F.col("align").isin("justify", "left")
    points = lambda d, on: F.round(F.when(flows & on & (d >= 6), d).otherwise(0.0), 1)
    return told.select(*by, "align", points(F.col("L") - F.col("left"), F.lit(True)).alias("indent"), points(F.col("a1") - F.col("L"), F.lit(True)).alias("first"))

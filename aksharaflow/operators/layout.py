"""Page layout: rulings to cells, words to cells, tables as text and HTML, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import staged


def crossings(across: DataFrame, down: DataFrame, by: list[str], tolerance: float = 2.0, bucket: float = 64.0) -> DataFrame:
    """by, x, y: where rulings across (y, x0, x1) meet rulings down (x, y0, y1) of the same page.

    The theta-join becomes an equi-join: a ruling across is put into each bucket of x that it passes, a ruling down into
    its own, so that a page with many rulings doesn't pair them all."""
    cell = lambda c: F.floor(c / bucket)
    a = across.withColumn("_b", F.explode(F.sequence(cell(F.col("x0") - tolerance), cell(F.col("x1") + tolerance))))
    d = down.withColumn("_b", cell(F.col("x")))
    meet = F.col("x").between(F.col("x0") - tolerance, F.col("x1") + tolerance) & F.col("y").between(F.col("y0") - tolerance, F.col("y1") + tolerance)
    return a.join(d, [*by, "_b"]).where(meet).select(*by, "x", "y").distinct()


def points_in_cells(points: DataFrame, cells: DataFrame, by: list[str], slack: float = 1.0, bucket: float = 16.0) -> DataFrame:
    """points (x, y) joined with the cells (x0, x1, y0, y1) of their page that hold them, with slack; by buckets of x."""
    cell = lambda c: F.floor(c / bucket)
    c = cells.withColumn("_b", F.explode(F.sequence(cell(F.col("x0") - slack), cell(F.col("x1") + slack))))
    inside = F.col("x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("y").between(F.col("y0") - slack, F.col("y1") + slack)
    return points.withColumn("_b", cell(F.col("x"))).join(c, [*by, "_b"]).where(inside).drop("_b")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def table_html(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, html: cells (row, col, rs, cs, th, text) as a table, rows and cells in order."""
    tag = F.when(F.col("th"), "th").otherwise("td")
    span = F.concat(F.when(F.col("rs") > 1, F.concat(F.lit(' rowspan="'), F.col("rs").cast("string"), F.lit('"'))).otherwise(""), F.when(F.col("cs") > 1, F.concat(F.lit(' colspan="'), F.col("cs").cast("string"), F.lit('"'))).otherwise(""))
    one = F.concat(F.lit("<"), tag, span, F.lit(">"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    in_order = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
    rows = cells.withColumn("_h", one).groupBy(*by, "row").agg(F.concat(F.lit("<tr>"), in_order("col", "_h"), F.lit("</tr>")).alias("_h"))
    return rows.groupBy(*by).agg(F.concat(F.lit("<table>"), in_order("row", "_h"), F.lit("</table>")).alias("html"))


def table_text(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, tsv: tab-separated rows; a place that a spanned cell covers is empty."""
    size = cells.groupBy(*by).agg(F.max(F.col("row") + F.col("rs") - 1).alias("nr"), F.max(F.col("col") + F.col("cs") - 1).alias("nc"))
    grid = size.select(*by, F.explode(F.sequence(F.lit(0), "nr")).alias("row"), "nc").select(*by, "row", F.explode(F.sequence(F.lit(0), "nc")).alias("col"))
    full = grid.join(cells.select(*by, "row", "col", "text"), [*by, "row", "col"], "left").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n]", " "))
    in_order = lambda key, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), sep)
    rows = full.groupBy(*by, "row").agg(in_order("col", "text", "\t").alias("_t"))
    return rows.groupBy(*by).agg(in_order("row", "_t", "\n").alias("tsv"))


def placed(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells (row, seq, cs and any others, given in reading order without columns) with col: the first column that the cells
    before it in its row, with their spans, leave free. Spans of rows are taken to be 1; a row is one group."""
    w = Window.partitionBy(*by, "row").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum("cs").over(w), F.lit(0)).cast("int"))


def covering(places: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """places (row, col) with the cell (at_row, at_col, text) that covers them, spans counted. A cell gives a row for each
    place it covers, so that the join is one of equal places."""
    each = cells.select(*by, F.col("row").alias("at_row"), F.col("col").alias("at_col"), "text", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rs") - 1)).alias("row"), "cs")
    each = each.select(*by, "at_row", "at_col", "text", "row", F.explode(F.sequence(F.col("at_col"), F.col("at_col") + F.col("cs") - 1)).alias("col"))
    return places.join(each, [*by, "row", "col"])


def headers(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells (row, col, th, text) with above and left: the texts of the nearest header above in the column and to the left in
    the row."""
    head = F.when(F.col("th"), F.col("text"))
    up = Window.partitionBy(*by, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*by, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns({"above": F.last(head, ignorenulls=True).over(up), "left": F.last(head, ignorenulls=True).over(back)})


def real_tables(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, rows, columns of tables that are ones: at least two columns, and a row after the first with two filled cells."""
    filled = cells.withColumn("_f", (F.coalesce(F.btrim("text"), F.lit("")) != "").cast("int"))
    rows = filled.groupBy(*by, "row").agg(F.sum("_f").alias("filled"), F.max(F.col("col") + F.col("cs")).alias("columns"))
    each = rows.groupBy(*by).agg(F.min("row").alias("first"), F.max("columns").alias("columns"), F.count("*").alias("rows"), F.max(F.when(F.col("filled") >= 2, F.col("row"))).alias("last"))
    return each.where((F.col("columns") >= 2) & (F.col("last") > F.col("first"))).select(*by, "rows", "columns")


def underlined(words: DataFrame, rulings: DataFrame, by: list[str], below: float = 3.0, bucket: float = 16.0) -> DataFrame:
    """words (x0, x1, y) under which a ruling (ry, rx0, rx1) runs at most `below` beneath the baseline and along most of the
    word. Words and rulings meet in buckets of y."""
    cell = lambda c: F.floor(c / bucket)
    r = rulings.withColumn("_b", F.explode(F.sequence(cell(F.col("ry")), cell(F.col("ry") + below))))
    along = F.least("x1", "rx1") - F.greatest("x0", "rx0")
    return words.withColumn("_b", cell(F.col("y"))).join(r, [*by, "_b"]).where((F.col("y") - F.col("ry")).between(0, below) & (2 * along > F.col("x1") - F.col("x0"))).select(*[F.col(c) for c in words.columns]).distinct()


def clipboard_html(fragment: Column) -> Column:
    """A fragment with the header of byte offsets that the HTML clipboard format asks for."""
    head = "Version:0.9\r\nStartHTML:%010d\r\nEndHTML:%010d\r\nStartFragment:%010d\r\nEndFragment:%010d\r\n"
    before, after = "<html><body>\r\n<!--StartFragment-->", "<!--EndFragment-->\r\n</body></html>"
    n = len(head % (0, 0, 0, 0))
    start = F.lit(n + len(before)).cast("int")
    end = start + F.octet_length(fragment)
    return F.concat(F.format_string(head.replace("\r\n", "\r\n"), F.lit(n), end + len(after), start, end), F.lit(before), fragment, F.lit(after))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of edges (a, b) is connected to.

    Labels spread over edges and jump to the label of their label; each round is staged, so that its lineage is short."""
    ways = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = staged(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = ways.join(now.select(F.col("node").alias("b"), "component").hint("merge"), "b").select(F.col("a").alias("node"), "component")
        new = near.unionByName(now).groupBy("node").agg(F.min("component").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = new.join(jump.hint("merge"), "component").select("node", F.col("next").alias("component"))
        new = staged(new.join(now.select("node", F.col("component").alias("was")).hint("merge"), "node"), "labels")
        now = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return now

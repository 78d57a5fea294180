"""Queries over page structure: tag trees, grids of rulings, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, tagtree
from .order_queries import _RULINGS
from .registry import query, table


def tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tagged document for each customer: a section for each order, with a heading, a table of the order's lines, two cells each,
    and a paragraph behind it. Sections know their page, rows have a tag of their own; content is one piece an element."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("ln")).distinct().join(orders, "k")
    at, none = F.col("k") * 100 + 100, F.lit(None).cast("long")

    def elements_of(rows: DataFrame, *each: tuple) -> DataFrame:
        """Elements (id, parent, seq, tag, page) for each row, which is read once."""
        kinds = {"id": "long", "parent": "long", "seq": "long", "tag": "string", "page": "long"}
        one = lambda e: F.struct(*[(F.lit(v) if n == "tag" else v).cast(t).alias(n) for (n, t), v in zip(kinds.items(), e, strict=True)])
        return rows.select("doc_id", F.explode(F.array(*map(one, each))).alias("e")).select("doc_id", "e.*")

    row = at + 10 + F.col("ln") * 10
    elements = elements_of(orders.select("doc_id").distinct(), (F.lit(0), none, F.lit(0), "Document", none))
    elements = elements.unionByName(elements_of(orders, (at, F.lit(0), F.col("k"), "Sect", F.col("k") % 50), (at + 1, at, F.lit(0), "Heading", none), (at + 2, at, F.lit(1), "Table", none), (at + 3, at, F.lit(2), "P", none)))
    elements = elements.unionByName(elements_of(lines, (row, at + 2, F.col("ln"), "Line", none), (row + 1, row, F.lit(0), "TH", none), (row + 2, row, F.lit(1), "TD", none)))
    leaves = elements.where(F.col("tag").isin("Heading", "P", "TH", "TD"))
    content = leaves.select("doc_id", F.col("id").alias("parent"), F.lit(0).cast("long").alias("seq"), none.alias("page"), F.col("id").alias("mcid"))
    names = spark.createDataFrame([("Heading", "Head"), ("Head", "H2"), ("Line", "TR")], "tag string, means string")
    return elements, content, orders.select("doc_id").distinct().join(F.broadcast(names))  # a fixed list


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS t FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ln) - 1 AS r FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS ln FROM lineitem)),
e AS (SELECT doc_id, k, k * 100 + 101 AS mcid, 0 AS s, 0 AS ln, 0 AS c, 2 AS level, NULL AS tbl, NULL AS row, NULL AS cell FROM o UNION ALL SELECT doc_id, k, k * 100 + 103, 2, 0, 0, 0, NULL, NULL, NULL FROM o
  UNION ALL SELECT doc_id, k, k * 100 + 111 + ln * 10 + c, 1, ln, c, 0, t, r, c FROM o JOIN l USING (k), (VALUES (0), (1)) v (c))
SELECT doc_id, k % 50 AS page, mcid, row_number() OVER (PARTITION BY doc_id ORDER BY k, s, ln, c) AS block, level, tbl, row, cell FROM e""")
def tag_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each piece of content of every customer's tagged document belongs to."""
    return tagtree.marked_content(*tagged(spark, sf_dir))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1 AS row, l_quantity FROM lineitem)
SELECT l_orderkey, min(row) AS word_no, CASE WHEN l_quantity > 40 THEN 'head' ELSE 'table' END AS kind, l_linenumber AS block FROM e GROUP BY l_orderkey, kind, l_linenumber""")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each heading and table, over line items as the words of a document for each order."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")) - 1
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block"), row.alias("word_no"), "l_quantity")
    found = tagtree.first_words(words, F.when(F.col("l_quantity") > 40, "head").otherwise("table"))
    return found.withColumnRenamed("doc_id", "l_orderkey")


@query()
def cell_columns_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table for each order put into the first free columns, where cells span rows and columns."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")) - 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", row.alias("row"), "l_quantity", "l_suppkey")
    cells = lines.select("l_orderkey", "row", F.explode(F.array(*map(F.lit, range(3)))).alias("seq"), (1 + (F.col("l_suppkey") + F.col("seq")) % 3).alias("rs"), F.when(F.col("l_quantity") > 25, F.col("seq") % 2 + 1).otherwise(1).alias("cs"))
    return tagtree.placed_with_spans(cells, "l_orderkey")


def crossing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of lines drawn on pages, made of orders, 800 keys a page; each order is a ruling."""
    o = table(spark, sf_dir, "orders")
    a = (F.floor("o_totalprice") % 300).cast("double")
    rows = o.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 800).alias("page"), ((F.col("o_orderkey") % 40).cast("double") * 10).alias("pos"), a.alias("a"), (a + 100).alias("b"), (F.floor(F.col("o_orderkey") / 40) % 2).alias("up"))
    across = rows.where("up = 0").select("page", F.col("id").alias("h"), F.col("pos").alias("y"), F.col("a").alias("x0"), F.col("b").alias("x1"))
    return grid.numbered_crossings(across, rows.where("up = 1").select("page", F.col("id").alias("v"), F.col("pos").alias("x"), F.col("a").alias("y0"), F.col("b").alias("y1")), ["page"])


_CROSSED = f"""r AS ({_RULINGS.replace('SELECT ', 'SELECT o_orderkey AS id, ', 1)}), p AS MATERIALIZED (SELECT h.page, h.id AS h, v.id AS v, v.pos AS x, h.pos AS y FROM r h JOIN r v ON h.page = v.page AND h.up = 0 AND v.up = 1
  AND v.pos BETWEEN h.a - 2 AND h.b + 2 AND h.pos BETWEEN v.a - 2 AND v.b + 2)"""


@query(f"""WITH {_CROSSED}, c AS (SELECT p.page, p.h, p.v, p.x AS x0, b.y AS y0, r.x AS x1, p.y AS y1, b.h AS h2, r.v AS v2, row_number() OVER (PARTITION BY p.page, p.h, p.v ORDER BY b.y DESC, b.h, r.x, r.v) AS k
  FROM p JOIN p b ON b.page = p.page AND b.v = p.v AND b.y <= p.y - 2 JOIN p r ON r.page = p.page AND r.h = p.h AND r.x >= p.x + 2 JOIN p c ON c.page = p.page AND c.h = b.h AND c.v = r.v)
SELECT page, x0, y0, x1, y1, h, v, h2, v2 FROM c WHERE k = 1""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest cells that lines drawn on pages enclose."""
    return grid.smallest_cells(crossing_points(spark, sf_dir), ["page"])


@query()
def grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids of these cells that hold the words around them; words are the line items of the same orders."""
    cells = grid.grids(grid.smallest_cells(crossing_points(spark, sf_dir), ["page"]), ["page"])
    x, y = F.col("l_quantity") * 8, F.col("l_extendedprice") % 400
    words = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 800).alias("page"), x.alias("x"), y.alias("y"), (x - 6).alias("x0"), (x + 6).alias("x1"))
    return grid.whole_tables(cells, words, ["page"])


_PARAGRAPHS = """SELECT l_orderkey, line, 50.0 AS left_, 400.0 AS right_, CASE l_orderkey % 6 WHEN 0 THEN CASE WHEN line = 1 THEN 68.0 ELSE 50.0 END WHEN 1 THEN 62.0 WHEN 2 THEN 225.0 - q WHEN 3 THEN 300.0 - q WHEN 4 THEN 50.0 ELSE 50.0 + q END AS a,
  CASE l_orderkey % 6 WHEN 0 THEN CASE WHEN line = n THEN 300.0 ELSE 400.0 END WHEN 1 THEN 330.0 + q WHEN 2 THEN 225.0 + q WHEN 3 THEN 400.0 WHEN 4 THEN 395.0 + line % 2 ELSE 350.0 - q END AS b
  FROM (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS line, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) t"""


@query(f"""WITH l AS ({_PARAGRAPHS}), g AS (SELECT l_orderkey, list({{'a': a, 'b': b}} ORDER BY line) AS ls, min(a) AS lo, max(b) AS hi, count(*) AS n FROM l GROUP BY l_orderkey),
t AS (SELECT *, ls[1].a AS a1, ls[n].b AS bn, list_transform(ls[2:], lambda x: x.a) AS rest, list_transform(ls[1:n - 1], lambda x: x.b) AS upto, list_transform(ls, lambda x: x.b - x.a) AS wide FROM g),
k AS (SELECT *, CASE
  WHEN n >= 3 AND hi - lo >= 210 AND len(list_filter(upto, lambda x: abs(x - hi) > 2)) = 0 AND len(list_filter(rest, lambda x: abs(x - lo) > 2)) = 0 AND bn < hi - 10 THEN 'justify'
  WHEN n >= 3 AND len(list_filter(rest, lambda x: abs(x - lo) > 2)) = 0 AND abs(a1 - lo) <= 2 AND list_max(upto) - list_min(upto) > 15 AND hi - lo >= 175 THEN 'left'
  WHEN len(list_filter(ls, lambda x: abs((x.a + x.b) / 2 - 225) > 2 OR x.a < 80 OR x.b > 370)) = 0 AND (n = 1 OR list_max(wide) - list_min(wide) > 10) THEN 'center'
  WHEN len(list_filter(ls, lambda x: abs(x.b - 400) > 2 OR x.a < 190)) = 0 THEN 'right' END AS align FROM t)
SELECT l_orderkey, align, round(CASE WHEN align IN ('justify', 'left') AND lo - 50 >= 6 THEN lo - 50 ELSE 0 END, 1) AS indent, round(CASE WHEN align IN ('justify', 'left') AND a1 - lo >= 6 THEN a1 - lo ELSE 0 END, 1) AS first FROM k WHERE align IS NOT NULL""")
def paragraph_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs whose lines prove an alignment, over line items as lines of a paragraph for each order."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("paragraph_lineitem")
    lines = spark.sql(_PARAGRAPHS.replace("FROM lineitem", "FROM paragraph_lineitem"))
    lines = lines.select("l_orderkey", "line", *(F.col(c).cast("double").alias(n) for c, n in (("a", "a"), ("b", "b"), ("left_", "left"), ("right_", "right"))))
    return grid.paragraph_alignment(lines, ["l_orderkey"])

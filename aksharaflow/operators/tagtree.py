"""The tag tree of a document: what each piece of marked content belongs to, read from the root down."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values of the tag standard: headings and their levels, other tags that begin a block, and the rest.
HEADINGS = {"H": 2, "H1": 1, "H2": 2, "H3": 3, "H4": 4, "H5": 5, "H6": 6, "Title": 1}
BLOCKS = ("P", "LI", "Lbl", "LBody", "Caption", "BlockQuote", "Note", "TOCI", "Code", "Figure", "Formula", "TH", "TD")
STRUCTURE = (
    "Document", "Part", "Art", "Sect", "Div", "Table", "TR", "THead", "TBody", "TFoot", "L", "TOC", "Index", "Form", "Span", "Link", "Quote", "Reference", "BibEntry", "Annot",
    "Ruby", "Warichu", "NonStruct", "Private",
)
STANDARD = (*HEADINGS, *BLOCKS, *STRUCTURE)
_STANDARD_TAGS, _BLOCK_TAGS, _CELL_TAGS = frozenset(STANDARD), frozenset((*HEADINGS, *BLOCKS)), frozenset(("TD", "TH"))
#: Rows of a result that a task holds before it hands them on.
HANDED_ON = 20_000
#: Steps from the root down to an element, at most.
DEEPEST = 127
#: Steps of roles that a tag is followed, at most.
ROLE_STEPS = 6
#: Sorts before every number: a null.
_NULL = -(1 << 63) - 1


def _standard(tag: str, means: dict[str, str]) -> str:
    """The standard tag that roles lead to, or the last one met."""
    for _ in range(ROLE_STEPS):
        tag = means.get(tag, tag)
    return tag


def _known(elements: dict[int, tuple]) -> dict[int, tuple | None]:
    """id: (path, tag, page, block, level, tbl, tr, td) of elements (id: seq, parent, tag, page) that hang on a root (parent _NULL),
    None for others. What follows tag is handed down unless a nearer element has its own; a table hides the row around it. path:
    the seqs from the root on, by which elements sort in document order. Elements that lead into a cycle, to a parent that isn't
    there, or more than DEEPEST steps from their root hang on none."""
    known: dict[int, tuple | None] = {}
    for i in elements:
        up: list[int] = []
        while i in elements and i not in known:
            known[i] = None  # what leads back to itself meets this
            up.append(i)
            i = elements[i][1]
        at = ((), "", _NULL, _NULL, _NULL, _NULL, _NULL, _NULL) if i == _NULL else known.get(i)
        while up and at is not None:
            i = up.pop()
            seq, _, tag, own = elements[i]
            path, _, page, block, level, tbl, tr, td = at
            if len(path) > DEEPEST:
                break
            page = page if own == _NULL else own
            level = HEADINGS.get(tag, level)
            if tag in _BLOCK_TAGS:
                block = i
            if tag == "Table":
                tbl, tr = i, _NULL
            elif tag == "TR":
                tr = i
            elif tag in _CELL_TAGS:
                td = i
            at = known[i] = ((*path, seq), tag, page, block, level, tbl, tr, td)
    return known


def _cells(tree: list[tuple[tuple, int, tuple]]) -> dict[int, tuple[int, int, int]]:
    """id: (tbl, row, cell), row and cell numbered from 0 in document order, of the cells of a tree in that order. A cell counts for
    the nearest table above it. A row sorts by where it begins: its own element, or the cell's if it has none."""
    rows, cells, trs = {}, [], {i: path for path, i, e in tree if e[1] == "TR"}
    for path, i, (_, tag, _, _, _, tbl, tr, _) in tree:
        if tbl != _NULL and (tag == "TR" or tag in _CELL_TAGS):
            at = path if tag == "TR" else trs.get(tr, path)
            rows.setdefault(tbl, set()).add(at)
            if tag != "TR":
                cells.append((i, tbl, at))
    number = {(tbl, at): n for tbl, ats in rows.items() for n, at in enumerate(sorted(ats))}
    seen, out = Counter(), {}
    for i, tbl, at in cells:
        row = number[tbl, at]
        out[i] = tbl, row, seen[tbl, row]
        seen[tbl, row] += 1
    return out


def _document(elements: dict[int, tuple], content: list[tuple]) -> Iterator[tuple]:
    """page, mcid, block, level, tbl, row, cell of the content (parent, seq, page, mcid) of one document."""
    known = _known(elements)
    tree = sorted((e[0], i, e) for i, e in known.items() if e is not None)
    blocks = {i: n for n, i in enumerate((i for _, i, e in tree if e[1] in _BLOCK_TAGS), 1)}
    tables = {i: n for n, i in enumerate(i for _, i, e in tree if e[1] == "Table")}
    cells, last = _cells(tree), {}
    for parent, seq, page, mcid in content:
        e = known.get(parent)
        if e is not None and mcid is not None:
            page = e[2] if page is None else page
            if page != _NULL:
                key, at = (page, mcid), ((*e[0], _NULL if seq is None else seq), e[3], e[4], e[7])
                if key not in last or last[key] < at:
                    last[key] = at
    for (page, mcid), (_, block, level, td) in last.items():
        tbl, row, cell = cells.get(td, (None, None, None))
        yield page, mcid, blocks.get(block, 0), max(level, 0), tables.get(tbl), row, cell


def marked_content(elements: DataFrame, content: DataFrame, roles: DataFrame) -> DataFrame:
    """doc_id, page, mcid, block, level, tbl, row, cell: what each marked content (doc_id, parent, seq, page, mcid) belongs to.

    elements: (doc_id, id, parent, seq, tag, page); roles: (doc_id, tag, means). Blocks and tables are numbered in document order,
    rows in their table and cells in their row; block and level are 0 outside of any, tbl, row and cell null outside of a cell.
    Content without a page takes that of the nearest element around it, and is left out if none has one. A cell outside of
    a row is a row of its own. Of elements with one id the first counts, of content named twice the last. Null or unknown
    tags are elements without a meaning. Equal places in a document are told apart by id.

    Rows are dealt out by document, once, and a stream over them holds the tree of one document at a time."""
    kind, longs = lambda n: F.lit(n).alias("kind"), "id parent seq page".split()
    whole = lambda rows, **more: rows.select("doc_id", *[more.get(c, F.lit(None)).cast("long").alias(c) for c in longs], *[more.get(c, F.lit(None)).cast("string").alias(c) for c in ("tag", "means")], kind(more["n"]))
    col = F.col
    rows = whole(roles, tag=col("tag"), means=col("means"), n=0)
    rows = rows.unionByName(whole(elements.where("id IS NOT NULL"), id=col("id"), parent=col("parent"), seq=col("seq"), page=col("page"), tag=col("tag"), n=1))
    rows = rows.unionByName(whole(content, id=col("mcid"), parent=col("parent"), seq=col("seq"), page=col("page"), n=2))
    doc_type = elements.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {doc_type}, page long, mcid long, block int, level int, tbl int, row int, cell int"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    null = lambda x: _NULL if x is None else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        at, means, tags, held, parts = None, {}, {}, {}, []
        for batch in batches:
            for doc, id_, parent, seq, page, tag, to, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if doc != at:
                    out += [(at, *x) for x in _document(held, parts)]
                    at, means, tags, held, parts = doc, {}, {}, {}, []
                    if len(out) >= HANDED_ON:
                        yield made()
                        out = []
                if n == 0:
                    if tag is not None and to is not None and tag not in _STANDARD_TAGS:
                        means[tag] = min(to, means.get(tag, to))
                elif n == 1:
                    tag = tag or ""
                    if tag not in tags:
                        tags[tag] = _standard(tag, means)
                    e = (null(seq), null(parent), tags[tag], null(page))
                    if id_ not in held or e < held[id_]:
                        held[id_] = e
                else:
                    parts.append((parent, seq, page, id_))
        out += [(at, *x) for x in _document(held, parts)]
        if out:
            yield made()

    return rows.where("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "kind").mapInArrow(run, ddl)


def placed_with_spans(cells: DataFrame, table_col: str = "tbl") -> DataFrame:
    """cells (a long column table_col, row, seq, rs, cs) in reading order with col: the first column of its row that neither the cells
    before it nor spans from rows above take; a cell that spans more columns may reach over taken ones. Spans under 1 count as 1.

    Tables are dealt out and their cells sorted; a stream over them carries, for each column, the row up to which it is taken,
    so that a table of any number of rows takes the memory of its columns."""
    kinds = "tbl long, row int, seq int, rs int, cs int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = None, {}
        for batch in batches:
            cols = []
            for tbl, row, rs, cs in zip(batch["tbl"], batch["row"], batch["rs"], batch["cs"], strict=True):
                if tbl != at:
                    at, taken = tbl, {}
                col, rs, cs = 0, max(1, rs), max(1, cs)
                while taken.get(col, -1) >= row:
                    col += 1
                taken.update({c: max(row + rs - 1, taken.get(c, -1)) for c in range(col, col + cs)})
                cols.append(col)
            yield batch.assign(col=pd.Series(cols, dtype="int32"))

    rows = cells.select(F.col(table_col).cast("long").alias("tbl"), F.col("row").cast("int"), F.col("seq").cast("int"), F.col("rs").cast("int"), F.col("cs").cast("int"))
    out = rows.repartition("tbl").sortWithinPartitions("tbl", "row", "seq").mapInPandas(run, f"{kinds}, col int")
    return out.withColumnRenamed("tbl", table_col)


def first_words(words: DataFrame, kind: Column) -> DataFrame:
    """doc_id, kind, block, word_no: the first word of each block of words (doc_id, block, word_no) in document order, for blocks of a
    kind (a column over words, null for words that don't count)."""
    return words.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("doc_id", "kind", "block").agg(F.min("word_no").alias("word_no"))

"""Warnings of workbooks: what was not read, is missing, dangling or hidden, in one ranked list a book."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.functions.headers import period_like, period_shape, with_atoms
from gridloom.operators.facts import completeness
from gridloom.operators.lookups import ranked_lines, span_text
from gridloom.operators.ordered import capped_ids
from gridloom.params import WARNING_SAMPLES, WARNINGS
from gridloom.sources.workbook import order_warnings

if TYPE_CHECKING:
    from gridloom.plans.book import Books


def _line(rows: DataFrame, order: Column, *parts: str | Column) -> DataFrame:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return rows.select("book_id", order.cast("long").alias("ord"), text.alias("line"))


def counted(cells: DataFrame, what: str) -> DataFrame:
    """One line for each book of cells(book_id, node, ordinal): how many, and the first of them."""
    n = capped_ids(cells, ["book_id"], "node", "ordinal", WARNING_SAMPLES)
    return _line(n, F.lit(0), F.col("n"), what, " (e.g. ", F.array_join("ids", ", "), ")")


def unread_headers(cells: DataFrame) -> DataFrame:
    """Texts that look like periods and are none, once for each sheet, where they stand first."""
    texts = cells.where(F.col("formula_raw").isNull() & period_shape(F.col("cached_value")))
    first = texts.groupBy("book_id", "sheet", "cached_value").agg(F.min_by("addr", "ordinal").alias("addr"), F.min("ordinal").alias("ordinal"))
    first = with_atoms(first, "cached_value").where("atom is null")
    return _line(first, F.col("ordinal"), "Unparsed period header ", F.col("sheet"), "!", F.col("addr"), ": «", F.trim("cached_value"), "»")


def hidden(workbooks: DataFrame, cells: DataFrame) -> DataFrame:
    """Hidden sheets, and hidden rows and columns that hold something, as spans."""
    sheets = workbooks.select("book_id", F.posexplode("sheets").alias("no", "s")).select("book_id", "no", F.col("s.name").alias("sheet"), F.col("s.hidden").alias("hidden"))
    out = _line(sheets.where("hidden"), F.col("no") * 3, "Hidden sheet ", F.col("sheet"), " is included")
    for k, (flag, at, name) in enumerate((("hidden_row", "row", "rows"), ("hidden_col", "col", "columns")), 1):
        held = cells.where(F.col(flag)).select("book_id", "sheet", at).distinct().groupBy("book_id", "sheet")
        spans = held.agg(span_text(F.collect_set(at)).alias("spans")).join(sheets.select("book_id", "sheet", "no"), ["book_id", "sheet"])
        if at == "col":
            ends = F.transform(F.split("spans", ","), lambda s: F.array_join(F.transform(F.split(s, ":"), lambda c: C.column_letters(c.cast("long"))), ":"))
            spans = spans.withColumn("spans", F.array_join(ends, ","))
        out = out.unionByName(_line(spans, F.col("no") * 3 + k, f"Hidden {name} ", F.col("sheet"), "!", F.col("spans"), " are included"))
    return out


def lost_axes(layout: DataFrame) -> DataFrame:
    """Parameter blocks with two or more captions that look like periods."""
    blocks = layout.where("axis_id is null").groupBy("book_id", "sheet", "block_id").agg(F.first("captions").alias("captions"), F.min("row").alias("row"))
    heads = blocks.select("book_id", "sheet", "block_id", "row", F.explode("captions").alias("col", "text")).where(period_like(F.col("text")))
    some = heads.groupBy("book_id", "sheet", "block_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("h")).where(F.size("h") >= 2)
    return _line(some, F.col("row"), "No time axis on ", F.col("sheet"), ": headers ", F.array_join(F.transform("h", lambda x: F.concat(F.lit("«"), x["text"], F.lit("»"))), ", "), " look like periods but form no axis")


def warnings(books: Books, cap: int = WARNINGS) -> DataFrame:
    """(book_id, no, line, total): the first cap warnings of each book.

    In this order: cells out of order, formulas that were not parsed, rows with values of which none is published, headers that look like
    periods, formulas without a value, dangling and unresolved targets, hidden parts, blocks that may have lost an axis.
    """
    cells = books.cells.where("presence = 'populated'")
    node = F.concat("sheet", F.lit("!"), "addr").alias("node")
    bad = order_warnings(books.cells)
    place = books.cells.groupBy("book_id", "sheet").agg(F.min("ordinal").alias("ordinal"))
    order = _line(bad.join(place, ["book_id", "sheet"]), F.col("ordinal"), F.col("n"), " cell(s) out of order or repeated on sheet ", F.col("sheet"), " (e.g. ", F.array_join("samples", ", "), ")")
    unparsed = books.parsed.where("unparsed").select("book_id", "sheet", "addr").join(cells.select("book_id", "sheet", "addr", "ordinal"), ["book_id", "sheet", "addr"])
    shares = completeness(books.series.select("book_id", "row_key"), books.layout.where("kind <> 'abstract'"), ["book_id"], "row_key").where("published < rows")
    missing = cells.where("formula_raw is not null and coalesce(cached_value, '') = ''")
    dangling = books.cell_edges.where("dangling").groupBy("book_id").agg(F.count_distinct("target").alias("n"))
    unresolved = books.cell_edges.where("unresolved").groupBy("book_id").agg(F.count("*").alias("n"))
    graph = _line(dangling, F.lit(0), "Graph: ", F.col("n"), " dangling targets").unionByName(_line(unresolved, F.lit(1), "Graph: ", F.col("n"), " unresolved formula targets"))
    sources = [
        order, counted(unparsed.select("book_id", node, "ordinal"), " unparsed formula(s)"), _line(shares, F.lit(0), "Content completeness ", F.col("published"), "/", F.col("rows"), " layout rows"), unread_headers(cells),
        counted(missing.select("book_id", node, "ordinal"), " formula cell(s) missing cached values"), graph, hidden(books.workbooks, cells), lost_axes(books.layout),
    ]
    return ranked_lines(sources, ["book_id"], ["ord"], cap)

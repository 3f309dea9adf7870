"""Workbooks made from the star schema, and the slices over them: catalog, summary, observations.

A nation is a sheet, a market segment with an order priority a line item, a calendar quarter a column, and the
sum of order totals (in cents) the cached value. A totals row and a closing row hold formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.operators.ordered import noise_floor
from gridloom.params import NOISE, OBSERVATIONS, OBSERVATIONS_MOST

BOOK = "orders"
FIRST_YEAR = 1992


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value cells: book_id, sheet, row, col, addr, row_key, period_id, label, unit, cached_value (text), cents."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    col = (F.year("o_orderdate") - FIRST_YEAR) * 4 + F.quarter("o_orderdate") + 1
    # partial sums by customer's nation and segment before the window; the rows left are sheets x lines x quarters
    flat = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", "c_mktsegment", "o_orderpriority", period.alias("period_id"), col.cast("long").alias("col")).agg(F.sum("cents").alias("cents"))
    flat = flat.join(n, flat.c_nationkey == n.n_nationkey)
    line = F.dense_rank().over(Window.partitionBy("n_name").orderBy("c_mktsegment", "o_orderpriority")) + 1
    out = flat.select(F.lit(BOOK).alias("book_id"), F.col("n_name").alias("sheet"), line.cast("long").alias("row"), "col", "period_id", F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("label"), F.when(F.col("n_nationkey") % 2 == 1, "k").otherwise("unit").alias("unit"), F.col("cents").cast("string").alias("cached_value"), "cents")
    return out.withColumns({"addr": C.address(F.col("col"), F.col("row")), "row_key": F.concat_ws("|", "sheet", F.col("row").cast("string"), F.concat("sheet", F.lit("!r1")))})


def formulas(cells: DataFrame) -> DataFrame:
    """The totals row below each sheet and, under it, a closing row that carries the column before: cells with formula_raw."""
    spans = cells.groupBy("book_id", "sheet").agg(F.max("row").alias("last"))
    tops = cells.select("book_id", "sheet", "col", "period_id").distinct().join(spans, ["book_id", "sheet"])
    letters = C.column_letters(F.col("col"))
    total = tops.select("book_id", "sheet", (F.col("last") + 1).alias("row"), "col", "period_id", F.concat(F.lit("=SUM("), letters, F.lit("2:"), letters, F.col("last").cast("string"), F.lit(")")).alias("formula_raw"))
    row = (F.col("last") + 2).cast("string")
    closing = tops.where("col > 2").select("book_id", "sheet", (F.col("last") + 2).alias("row"), "col", "period_id", F.concat(F.lit("="), C.column_letters(F.col("col") - 1), row, F.lit("+"), letters, (F.col("last") + 1).cast("string")).alias("formula_raw"))
    return total.union(closing).withColumn("addr", C.address(F.col("col"), F.col("row")))


def series(cells: DataFrame) -> DataFrame:
    """Value cells with status, scale factor and the value in base units after the noise floor of their row."""
    out = cells.withColumns({"status": C.value_status(F.col("cached_value"), F.lit(True)), "scale_factor": C.scale_factor(F.col("unit"))})
    out = out.withColumn("number", C.normalized_number(F.col("cached_value"), F.col("scale_factor")))
    out = out.withColumn("number", noise_floor("number", ["book_id", "row_key"], NOISE))
    return out.withColumn("normalized", C.number_text(F.col("number")))


def observations(rows: DataFrame, row_keys: list[str] | None = None, q: str | None = None, period_ids: list[str] | None = None, limit: int = OBSERVATIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Row by period facts of rows chosen by key or label, in document order, at most limit of each book; truncated tells of more."""
    if not row_keys and not (q or "").strip():
        raise ValueError("selector_required")
    limit = max(1, min(OBSERVATIONS_MOST, limit))
    if row_keys:
        rows = rows.where(F.col("row_key").isin(row_keys))
    if q:
        rows = rows.where(C.label_contains(F.col("label"), q))
    if period_ids:
        rows = rows.where(F.col("period_id").isin(period_ids))
    w = Window.partitionBy("book_id").orderBy(*document_order(rows), "row", "col")
    top = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit + 1)
    top = top.withColumn("truncated", F.max("__rn").over(Window.partitionBy("book_id")) > limit)
    return top.where(F.col("__rn") <= limit).select(*keep, "sheet", "row_key", "label", "period_id", "cached_value", "status", "normalized", "truncated")


def document_order(rows: DataFrame) -> list[str]:
    """The order of sheets: their place in the workbook where it is known."""
    return ["sheet_no"] if "sheet_no" in rows.columns else ["sheet"]


def catalog(rows: DataFrame, q: str | None = None, sheet: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each book's rows without numbers, with the total before paging."""
    order = document_order(rows)
    lines = rows.select("book_id", "sheet", *[c for c in order if c != "sheet"], "row", "row_key", "label", "unit").distinct()
    if q:
        lines = lines.where(C.label_contains(F.col("label"), q))
    if sheet:
        lines = lines.where(F.col("sheet") == sheet)
    w = Window.partitionBy("book_id")
    lines = lines.withColumns({"total": F.count("*").over(w), "__rn": F.row_number().over(w.orderBy(*order, "row", "row_key"))})
    return lines.where(F.col("__rn").between(offset + 1, offset + limit)).select("sheet", "row", "row_key", "label", "unit", "total")


def summary(rows: DataFrame) -> DataFrame:
    """Counters of a book."""
    return rows.groupBy("book_id").agg(F.countDistinct("sheet").alias("sheets"), F.countDistinct("row_key").alias("lines"), F.countDistinct("period_id").alias("periods"), F.count("*").alias("cells"), F.count_if(F.col("status") == "cached").alias("cached"))

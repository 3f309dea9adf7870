"""Queries of period axes over the star schema: a nation or a customer is a sheet, its orders' periods are header cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.headers import with_atoms
from gridloom.operators import axes as A
from gridloom.plans.grid import table
from gridloom.queries import query
from gridloom.session import checkpointed, spread


def quarters(spark, d: str) -> DataFrame:
    """The quarters of each nation's orders, numbered in order: sheet, y, q, at (from 2)."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("sheet"))
    flat = o.join(c, "o_custkey").groupBy("n_nationkey", "y", "q").agg(F.count("*").alias("n")).join(n, "n_nationkey")
    return flat.select("sheet", "y", "q", "n", (F.row_number().over(Window.partitionBy("sheet").orderBy("y", "q")) + 1).cast("long").alias("at"))


def cells(rows: DataFrame) -> DataFrame:
    """rows(sheet, row, col, shown) as cells of one book, with numbers and atoms."""
    out = rows.select(F.lit("orders").alias("book_id"), "sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "shown", F.when(F.col("shown").rlike("^[0-9]+$"), F.col("shown").cast("double")).alias("number"), F.lit(None).cast("string").alias("formula_raw"))
    return checkpointed(with_atoms(out, "shown"))


QUARTERS = "WITH g AS (SELECT DISTINCT n_name AS sheet, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet ORDER BY y, q) + 1 AS BIGINT) AS pos FROM g) "


@query(QUARTERS + "SELECT sheet, 2::BIGINT AS header_row, pos AS col, y || 'Q' || q AS period_id, trim(CASE WHEN pos = min(pos) OVER (PARTITION BY sheet, y) THEN y::VARCHAR ELSE '' END || ' Q' || q) AS text FROM q")
def stacked_headers(spark, d):
    """Two header rows of each nation, a year over its first quarter and quarters below: one key for each column."""
    q = checkpointed(quarters(spark, d))
    first = q.groupBy("sheet", "y").agg(F.min("at").alias("col"))
    rows = first.select("sheet", F.lit(1).alias("row"), "col", F.col("y").cast("string").alias("shown"))
    rows = rows.unionByName(q.select("sheet", F.lit(2).alias("row"), F.col("at").alias("col"), F.concat(F.lit("Q"), "q").alias("shown")))
    label = q.groupBy("sheet").agg(F.lit("Orders").alias("shown")).select("sheet", F.lit(3).alias("row"), F.lit(1).cast("long").alias("col"), "shown")
    rows = rows.unionByName(q.select("sheet", F.lit(3).alias("row"), F.col("at").alias("col"), F.col("n").cast("string").alias("shown"))).unionByName(label)
    at = cells(rows)
    heads = checkpointed(A.header_rows(at))
    out = A.composed(at, A.header_bands(heads), heads)
    return out.select("sheet", "header_row", "col", F.col("key").alias("period_id"), "text")


SIDES = "y AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 2 AS side, year(o_orderdate) AS y FROM orders), h AS (SELECT k, y, row_number() OVER (PARTITION BY k ORDER BY side, y) + side * (k % 2) AS col, row_number() OVER (PARTITION BY k ORDER BY side, y) AS rn FROM y), "


def sides(spark, d: str) -> DataFrame:
    """The years of each customer's even orders and, right of them, those of odd ones: k, col, key, variant; an odd customer has an empty column between."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 2).alias("side"), F.year("o_orderdate").alias("y")).distinct()
    rn = F.row_number().over(Window.partitionBy("k").orderBy("side", "y"))
    return o.select("k", (rn + F.col("side") * (F.col("k") % 2)).cast("long").alias("col"), F.col("y").cast("string").alias("key"), F.lit(None).cast("string").alias("variant"))


@query(
    "WITH RECURSIVE " + SIDES + """n AS (SELECT *, lag(col) OVER w AS pc, lag(y) OVER w AS py, lead(col) OVER w AS nc, lead(y) OVER w AS ny FROM h WINDOW w AS (PARTITION BY k ORDER BY rn)),
scan(k, rn, col, y, run, opening, steady, len) AS (SELECT k, rn, col, y, col, y, true, 1 FROM n WHERE rn = 1 UNION ALL
  SELECT k, rn, col, y, CASE WHEN cut THEN col ELSE run END, CASE WHEN cut THEN y ELSE opening END, cut OR (steady AND y = py + 1), CASE WHEN cut THEN 1 ELSE len + 1 END
  FROM (SELECT n.k, n.rn, n.col, n.y, n.py, s.run, s.opening, s.steady, s.len, n.col - n.pc > 1 OR (s.len >= 2 AND s.steady AND n.y = s.opening AND n.nc = n.col + 1 AND n.ny = n.y + 1) AS cut FROM scan s JOIN n ON n.k = s.k AND n.rn = s.rn + 1))
SELECT k AS o_custkey, CAST(col AS BIGINT) AS col, CAST(y AS VARCHAR) AS period_id, CAST(run AS BIGINT) AS run FROM scan QUALIFY count(*) OVER (PARTITION BY k, run) >= 2"""
)
def header_runs(spark, d):
    """The runs of every customer's years: they end at empty columns and where a second copy of a steady run starts."""
    out = A.split_runs(checkpointed(sides(spark, d)), ["k"])
    return out.select(F.col("k").alias("o_custkey"), "col", F.col("key").alias("period_id"), "run")


@query(
    "WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y, o_orderpriority AS p FROM orders), s AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, y) AS n, min(p) OVER (PARTITION BY o_custkey) < max(p) OVER (PARTITION BY o_custkey) AS differ, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY y, p) AS BIGINT) AS col FROM y) SELECT o_custkey, col, y || CASE WHEN n > 1 AND differ THEN '@' || lower(p) ELSE '' END AS period_id FROM s"
)
def period_markers(spark, d):
    """The years of every customer's orders by priority; a priority is written onto a year where it tells columns apart."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("key"), F.col("o_orderpriority").alias("variant")).distinct()
    o = o.withColumns({"col": F.row_number().over(Window.partitionBy("o_custkey").orderBy("key", "variant")).cast("long"), "banner": F.lit(None).cast("string")})
    return A.marked(checkpointed(o), ["o_custkey"]).select("o_custkey", "col", F.col("key").alias("period_id"))


@query(
    "WITH c AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) + 1 AS BIGINT) AS col, CAST(l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS v FROM lineitem), r AS (SELECT l_orderkey, v - col AS apart, min(col) AS first_col, max(col) AS last_col, min(v) AS first_value, count(*) AS n, col - rn AS i FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, v - col ORDER BY col) AS rn FROM c) GROUP BY l_orderkey, v - col, col - rn) SELECT l_orderkey, first_col, last_col, first_value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first_col) AS best FROM r) WHERE best = 1 AND first_value IN (0, 1)"
)
def counting_rows(spark, d):
    """The longest run of integers that count up in each order's row of line numbers, where it starts at 0 or 1."""
    place = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) + 1).cast("long")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = spread(lines, "l_orderkey", rows=lines.count()).select(F.lit("b").alias("book_id"), F.lit("s").alias("sheet"), F.col("l_orderkey").alias("row"), place.alias("col"), (F.col("l_linenumber") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)).cast("double").alias("number"))
    rows = rows.withColumns({"shown": F.col("number").cast("string"), "atom": F.lit(None).cast("string")})
    return A.counting_runs(rows).select(F.col("row").alias("l_orderkey"), "first_col", "last_col", "first_value")


@query(
    "WITH y AS (SELECT n_name AS sheet, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate < DATE '1998-01-01' GROUP BY ALL), s AS (SELECT *, y - lag(y) OVER (PARTITION BY sheet ORDER BY y) AS step, CAST(row_number() OVER (PARTITION BY sheet ORDER BY y) + 1 AS BIGINT) AS row FROM y) SELECT sheet, row, CAST(y AS VARCHAR) AS period_id FROM s QUALIFY count(*) OVER (PARTITION BY sheet) >= 3 AND count(DISTINCT step) OVER (PARTITION BY sheet) = 1"
)
def vertical_periods(spark, d):
    """Years down a column beside each nation's number of orders."""
    o = table(spark, d, "orders").where("o_orderdate < '1998-01-01'").select("o_custkey", F.year("o_orderdate").alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("sheet"))
    flat = o.join(c, "o_custkey").groupBy("n_nationkey", "y").agg(F.count("*").alias("n")).join(n, "n_nationkey").select("sheet", "y", "n", (F.row_number().over(Window.partitionBy("sheet").orderBy("y")) + 1).alias("row"))
    flat = checkpointed(flat)
    rows = flat.select("sheet", "row", F.lit(1).alias("col"), F.col("y").cast("string").alias("shown")).unionByName(flat.select("sheet", "row", F.lit(2).alias("col"), F.col("n").cast("string").alias("shown")))
    rows = rows.unionByName(flat.select("sheet", F.lit(1).alias("row"), F.lit(2).alias("col"), F.lit("Orders").alias("shown")).distinct())
    at = cells(rows)
    return A.vertical(at, at.select(*A.KEYS, "row").limit(0)).select("sheet", F.col("col").alias("row"), F.col("key").alias("period_id"))


@query(
    "WITH r AS (SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS BIGINT) AS row, CASE c_custkey % 4 WHEN 0 THEN [2, 3] WHEN 1 THEN [6, 7] WHEN 2 THEN [3, 4, 7] ELSE [3, 6, 8] END AS held FROM customer), a(axis_id, start, cols) AS (VALUES ('left', 1, [2, 3, 4]), ('right', 1, [6, 7, 8]), ('again', 9, [2, 3, 4])), m AS (SELECT *, len(list_intersect(held, cols)) AS covered, len(list_filter(held, lambda x: NOT list_contains(cols, x))) AS outside FROM r JOIN a ON row > start AND NOT (axis_id = 'left' AND row >= 9)) SELECT c_nationkey, row, axis_id FROM m QUALIFY row_number() OVER (PARTITION BY c_nationkey, row ORDER BY CASE WHEN covered = 0 THEN -1 WHEN outside = 0 THEN 1 ELSE 0 END DESC, CASE WHEN covered = 0 THEN -outside ELSE covered - outside END DESC, start DESC) = 1"
)
def axis_bodies(spark, d):
    """Customers as rows of their nation's sheet, under two tables side by side and a third that replaces the left one."""
    place = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1).cast("long")
    pick = lambda *c: F.array(*[F.lit(x).cast("long") for x in c])
    held = F.when(F.col("c_custkey") % 4 == 0, pick(2, 3)).when(F.col("c_custkey") % 4 == 1, pick(6, 7)).when(F.col("c_custkey") % 4 == 2, pick(3, 4, 7)).otherwise(pick(3, 6, 8))
    rows = table(spark, d, "customer").select(F.lit("b").alias("book_id"), F.col("c_nationkey").cast("string").alias("sheet"), place.alias("row"), held.alias("held"))
    rows = rows.withColumns({"col": F.explode("held"), "number": F.lit(1.0), "shown": F.lit("1"), "formula_raw": F.lit(None).cast("string")})
    axis = lambda name, row, *c: F.struct(F.lit(name).alias("axis_id"), F.lit(row).cast("long").alias("start_row"), F.lit(row).cast("long").alias("header_row"), pick(*c).alias("cols"))
    axes = rows.select("book_id", "sheet").distinct().select("book_id", "sheet", F.inline(F.array(axis("left", 1, 2, 3, 4), axis("right", 1, 6, 7, 8), axis("again", 9, 2, 3, 4))))
    return A.body_rows(rows, axes).select(F.col("sheet").cast("long").alias("c_nationkey"), "row", "axis_id")

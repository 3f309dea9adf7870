"""Queries of timelines, switches and warnings over the star schema: customers are axes or rows, their nations books or sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.functions.headers import period_like, period_shape
from gridloom.operators import formula as G
from gridloom.operators import roles as R
from gridloom.operators import switches as S
from gridloom.operators import timelines as T
from gridloom.operators.lookups import ranked_lines
from gridloom.params import WARNINGS
from gridloom.plans.grid import table
from gridloom.queries import query

#: Customers as axes in SQL: a signature (years of their orders, first to last), what they say of dates and flags, a marker.
AXES = """a AS (SELECT c_nationkey AS book, c_custkey AS id, min(year(o_orderdate)) || '-' || max(year(o_orderdate)) AS sig, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 2 AS VARCHAR) END AS dates,
  CASE WHEN c_custkey % 5 < 2 THEN CAST(c_custkey % 5 AS VARCHAR) END AS flags, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS marker FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY book, sig ORDER BY id) AS rn FROM a)"""


def fold(dates: str, same: str) -> str:
    """SQL that deals the axes of m one after another: each to the first kept one that it fits, as a list of structs in kept."""
    fits = f"(k.d IS NULL OR {dates} IS NULL OR k.d = {dates}) AND (k.f IS NULL OR m.flags IS NULL OR k.f = m.flags)"
    find = f"coalesce(list_filter(kept, lambda k: {fits} AND k.m IS NOT NULL AND m.marker IS NULL AND {'false' if same == 'true' else 'true'})[1].id, list_filter(kept, lambda k: {fits} AND {same})[1].id)"
    own = f"{{'id': m.id, 'd': {dates}, 'f': m.flags, 'm': m.marker}}"
    return f"""scan(book, sig, rn, id, first, kept) AS (SELECT book, sig, rn, id, id, [{own}] FROM m WHERE rn = 1 UNION ALL
  SELECT book, sig, rn, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(kept, own) ELSE list_transform(kept, lambda k: CASE WHEN k.id = hit THEN {{'id': k.id, 'd': coalesce(k.d, own.d), 'f': coalesce(k.f, own.f), 'm': k.m}} ELSE k END) END
  FROM (SELECT m.book, m.sig, m.rn, m.id, s.kept, {own} AS own, {find} AS hit FROM scan s JOIN m ON m.book = s.book AND m.sig = s.sig AND m.rn = s.rn + 1))"""


def axes(spark, d: str) -> DataFrame:
    """Customers with orders as axes of their nation."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    k = F.col("c_custkey")
    c = table(spark, d, "customer").join(o, "c_custkey").withColumns({"signature": F.concat_ws("-", "a", "b"), "marker": F.when(k % 4 == 0, F.col("c_mktsegment"))})
    return c.select(
        F.col("c_nationkey"), F.format_string("%012d", k).alias("axis_id"), k.alias("place"), F.lit(0).alias("sheet_no"), "signature", F.col("signature").alias("columns"), F.concat_ws("/", "signature", "marker").alias("exact"), F.col("marker").isNotNull().alias("marked"),
        F.when(k % 3 == 0, (k % 2).cast("string")).alias("dates"), F.when(k % 5 < 2, (k % 5).cast("string")).alias("flags"), F.when(k % 5 < 2, 1).otherwise(0).alias("n_flags"),
    )


@query("WITH RECURSIVE " + AXES + ", " + fold("m.dates", "true") + " SELECT s.book AS c_nationkey, s.id AS c_custkey, first_value(s.id) OVER (PARTITION BY s.book, s.sig, s.first ORDER BY a.dates IS NULL, a.flags IS NULL, s.id) AS timeline FROM scan s JOIN a ON a.id = s.id")
def workbook_timelines(spark, d):
    """Customers of a nation whose orders span the same years are one timeline where dates and flags fit, by the best of them."""
    out = T.linked_timelines(axes(spark, d), ["c_nationkey"])
    return out.select("c_nationkey", F.col("axis_id").cast("bigint").alias("c_custkey"), F.col("timeline_id").cast("bigint").alias("timeline"))


@query("WITH RECURSIVE " + AXES + ", " + fold("CAST(NULL AS VARCHAR)", "k.m IS NOT DISTINCT FROM m.marker") + " SELECT book AS c_nationkey, id AS c_custkey, first FROM scan")
def shared_axes(spark, d):
    """A later customer with the same years is the first one of its nation, unless flags differ; without a marker it is the marked one."""
    out = T.shared_axes(axes(spark, d), ["c_nationkey"])
    return out.select("c_nationkey", F.col("axis_id").cast("bigint").alias("c_custkey"), F.col("first").cast("bigint").alias("first"))


@query(
    "WITH r AS (SELECT c_nationkey AS sheet, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row FROM customer), reads AS (SELECT DISTINCT sheet, k % 50 + 1 AS at, row FROM r WHERE k % 4 <> 0), n AS (SELECT t.sheet, t.row, count(*) AS readers, t.k % 11 = 0 AS chosen FROM r t JOIN reads ON reads.sheet = t.sheet AND reads.at = t.row AND reads.row <> t.row WHERE t.k % 3 <> 0 GROUP BY ALL HAVING count(*) >= 2) SELECT sheet AS c_nationkey, CAST(row AS BIGINT) AS row, CASE WHEN chosen THEN 'Scenario: chosen' ELSE 'Value' END AS label, readers FROM n QUALIFY chosen OR NOT max(chosen) OVER (PARTITION BY sheet)"
)
def switch_rows(spark, d):
    """Constants of a nation's customers that formulas of two or more others pass to CHOOSE, INDEX or OFFSET, found in the parsed formulas."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_nationkey", k, F.row_number().over(Window.partitionBy("c_nationkey").orderBy(k)).cast("long").alias("row"))
    at, row = (k % 50 + 1).cast("string"), F.col("row").cast("string")
    reads = F.when(k % 4 == 0, F.concat(F.lit("=SUM($B$"), at, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("=1+CHOOSE($B$"), at, F.lit(",SUM(D1:D9),Other!B7)"))).when(k % 4 == 2, F.concat(F.lit("=INDEX(D1:F9,1,B"), at, F.lit(")"))).otherwise(F.concat(F.lit("=IF(A1>0,OFFSET($B$1,0,$B"), at, F.lit("),0)")))
    cell = lambda col, text, number, formula: F.struct(F.lit(col).cast("long").alias("col"), text.alias("text"), number.alias("number"), formula.alias("formula_raw"))
    none, label = F.lit(None).cast("string"), F.when(k % 11 == 0, "Scenario: chosen").otherwise("Value")
    held = F.array(cell(1, label, F.lit(None).cast("double"), none), cell(2, F.lit("1"), F.lit(1.0), F.when(k % 3 == 0, "=1")), cell(3, F.lit("2"), F.lit(2.0), reads))
    cells = rows.select(F.lit("b").alias("book_id"), F.col("c_nationkey").cast("string").alias("sheet"), "row", F.inline(held)).withColumn("addr", C.address(F.col("col"), F.col("row")))
    out = S.switch_cells(S.switch_reads(G.parse_cells(cells)), cells)
    return out.select(F.col("sheet").cast("int").alias("c_nationkey"), "row", "label", "readers")


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS shape, o_orderkey % 7 <> 6 AND o_orderkey % 7 <> 5 AS likely FROM orders")
def period_shapes(spark, d):
    """Texts made of each order's date and key, some in the shape of a period: several dates, quarters with more words, months before years."""
    k, y = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    texts = [F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" - "), F.date_format("o_orderdate", "dd.MM.yyyy")), F.concat(F.lit("Plan for  Q"), F.quarter("o_orderdate").cast("string"), F.lit(" only")), F.concat(F.lit("13/"), y), F.concat(F.lit("квартал отчёта "), y), F.concat(F.lit("sum 9M "), y), F.concat(F.lit("Order "), k.cast("string"), F.lit(" of the clerk named in this long text")), F.lit("Revenue")]
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(k % 7 == i, t).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", period_shape(text).alias("shape"), period_like(text).alias("likely"))


@query(
    "WITH l AS (SELECT s_nationkey AS book, 0 AS p, s_suppkey AS o, 'supplier ' || s_suppkey AS line FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey, 'customer ' || c_custkey FROM customer), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY p, o) AS INTEGER) AS no, count(*) OVER (PARTITION BY book) AS total FROM l) SELECT book AS n_nationkey, no, line, total FROM r WHERE no <= 50"
)
def warnings_by_book(spark, d):
    """The first fifty lines of each nation, suppliers before customers, and how many there are."""
    line = lambda name, nation, key: table(spark, d, name).select(F.col(f"{nation}_nationkey").alias("n_nationkey"), F.col(key).alias("ord"), F.concat_ws(" ", F.lit(name), F.col(key).cast("string")).alias("line"))
    return ranked_lines([line("supplier", "s", "s_suppkey"), line("customer", "c", "c_custkey")], ["n_nationkey"], ["ord"], WARNINGS)


@query(
    "WITH c AS (SELECT c_nationkey, count(*) AS n, count_if(c_acctbal > 5000) AS v, count_if(c_custkey % 3 <> 0 AND length('remark about ' || c_name) > 24) AS t FROM customer GROUP BY ALL) SELECT c_nationkey, unnest([{'col': 1::BIGINT, 'caption': 'Item', 'role': 'label'}, {'col': 2, 'caption': 'Balance', 'role': CASE WHEN v >= 3 THEN 'value' ELSE 'unknown' END}, {'col': 3, 'caption': 'Unit', 'role': 'unit'}, {'col': 4, 'caption': 'Status', 'role': CASE WHEN t >= 2 AND t >= 0.6 * n THEN 'note' ELSE 'unknown' END}, {'col': 5, 'caption': 'FY 2024/25', 'role': 'unknown'}, {'col': 6, 'caption': '№', 'role': 'index'}], recursive := true) FROM c"
)
def column_roles(spark, d):
    """What the columns of each nation's table of customers are for: names, balances (words below 5000), a unit, remarks, numbers under a year, places."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    k, none = F.col("c_custkey"), F.lit(None).cast("double")
    cell = lambda col, text, number=none: F.struct(F.lit(col).cast("long").alias("col"), text.cast("string").alias("text"), number.cast("double").alias("number"))
    rich = F.col("c_acctbal") > 5000
    body = [cell(1, F.col("c_name")), cell(2, F.when(rich, F.col("c_acctbal").cast("string")).otherwise("n/a"), F.when(rich, F.col("c_acctbal"))), cell(3, F.lit("%")), cell(4, F.when(k % 3 == 0, "ok").otherwise(F.concat(F.lit("remark about "), "c_name"))), cell(5, k, k), cell(6, k, k)]
    heads = [cell(i, F.lit(t)) for i, t in enumerate(("Item", "Balance", "Unit", "Status", "FY 2024/25", "№"), 1)]
    cells = rows.select("c_nationkey", k.alias("row"), F.inline(F.array(*body))).unionByName(rows.select("c_nationkey").distinct().select("c_nationkey", F.lit(0).cast("long").alias("row"), F.inline(F.array(*heads))))
    return R.column_roles(cells, ["c_nationkey"])

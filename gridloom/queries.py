"""The engine's queries over the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.functions import periods as P
from gridloom.operators import formula as G
from gridloom.operators import ordered as O
from gridloom.operators import ranges as R
from gridloom.plans import graph, grid
from gridloom.plans.grid import table
from gridloom.session import ship, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str = ""):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return keep


GRID = """WITH flat AS (
  SELECT n_name AS sheet, n_nationkey, c_mktsegment || ' ' || o_orderpriority AS label, c_mktsegment, o_orderpriority,
    year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
grid AS (SELECT sheet, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY c_mktsegment, o_orderpriority) + 1 AS BIGINT) AS "row",
  CAST((y - 1992) * 4 + q + 1 AS BIGINT) AS col, CAST(y AS VARCHAR) || 'Q' || CAST(q AS VARCHAR) AS period_id, label,
  CASE WHEN n_nationkey % 2 = 1 THEN 'k' ELSE 'unit' END AS unit, CAST(c AS BIGINT) AS cents FROM flat),
keyed AS (SELECT *, sheet || '|' || CAST("row" AS VARCHAR) || '|' || sheet || '!r1' AS row_key,
  cents * (CASE WHEN unit = 'k' THEN 1000 ELSE 1 END) AS base FROM grid),
floored AS (SELECT *, CASE WHEN abs(base) < max(abs(base)) OVER (PARTITION BY row_key) * 1e-6 THEN 0 ELSE base END AS norm FROM keyed)
"""
LETTERS = "(CASE WHEN {n} > 702 THEN chr(CAST(64 + ((({n} - 1) // 26) - 1) // 26 AS INTEGER)) ELSE '' END || CASE WHEN {n} > 26 THEN chr(CAST(65 + ((({n} - 1) // 26) - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)))"


def letters_sql(n: str) -> str:
    return LETTERS.format(n=n)


@query(GRID + "SELECT sheet, row_key, label, period_id, CAST(cents AS VARCHAR) AS cached_value, 'cached' AS status, CAST(norm AS VARCHAR) AS normalized FROM floored")
def observations_all(spark, d):
    """Every row by period fact in base units (the flagship query)."""
    return grid.series(grid.grid(spark, d)).select("sheet", "row_key", "label", "period_id", "cached_value", "status", "normalized")


@query(GRID + "SELECT sheet, row_key, label, period_id, CAST(cents AS VARCHAR) AS cached_value, 'cached' AS status, CAST(norm AS VARCHAR) AS normalized, (SELECT count(*) FROM floored WHERE lower(label) LIKE '%building%') > 24 AS truncated FROM floored WHERE lower(label) LIKE '%building%' ORDER BY sheet, \"row\", col LIMIT 24")
def observations_by_label(spark, d):
    return grid.observations(grid.series(grid.grid(spark, d)), q=" BUILDING ")


@query(GRID + "SELECT sheet, row_key, label, period_id, CAST(cents AS VARCHAR) AS cached_value, 'cached' AS status, CAST(norm AS VARCHAR) AS normalized, (SELECT count(*) FROM floored WHERE lower(label) LIKE '%urgent%' AND period_id IN ('1996Q1', '1997Q2')) > 48 AS truncated FROM floored WHERE lower(label) LIKE '%urgent%' AND period_id IN ('1996Q1', '1997Q2') ORDER BY sheet, \"row\", col LIMIT 48")
def observations_by_period(spark, d):
    return grid.observations(grid.series(grid.grid(spark, d)), q="urgent", period_ids=["1996Q1", "1997Q2"], limit=48)


@query(GRID + "SELECT sheet, \"row\", row_key, label, unit, count(*) OVER () AS total FROM (SELECT DISTINCT sheet, \"row\", row_key, label, unit FROM keyed) ORDER BY sheet, \"row\" LIMIT 20 OFFSET 30")
def catalog_page(spark, d):
    return grid.catalog(grid.grid(spark, d), limit=20, offset=30)


@query(GRID + "SELECT 'orders' AS book_id, count(DISTINCT sheet) AS sheets, count(DISTINCT row_key) AS lines, count(DISTINCT period_id) AS periods, count(*) AS cells, count(*) AS cached FROM keyed")
def summary_counters(spark, d):
    return grid.summary(grid.series(grid.grid(spark, d)))


@query(GRID + "SELECT row_key, CAST(arg_min(cents, col) AS VARCHAR) AS \"first\", CAST(arg_max(cents, col) AS VARCHAR) AS \"last\", CAST(min(cents) AS BIGINT) AS \"min\", CAST(max(cents) AS BIGINT) AS \"max\", min(cents) = max(cents) AS constant, count(*) AS n FROM keyed GROUP BY row_key")
def numeric_summary(spark, d):
    return O.numeric_summary(grid.grid(spark, d), ["row_key"], "col", "cents", "cached_value")


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN ' 1 ' || p_size WHEN 2 THEN p_size || ',5' WHEN 3 THEN p_size || 'd' WHEN 4 THEN 'inf' WHEN 5 THEN '-' || p_size || '.25' WHEN 6 THEN '1e400' ELSE '0' END AS s FROM part),
n AS (SELECT p_partkey, s, CASE WHEN regexp_full_match(replace(replace(s, ' ', ''), ',', '.'), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN try_cast(replace(replace(s, ' ', ''), ',', '.') AS DOUBLE) END AS x FROM t)
SELECT p_partkey, s AS text, x AS number, CASE WHEN trim(s) = '' THEN 'empty' WHEN x = 0 THEN 'zero_explicit' ELSE 'cached' END AS status FROM n""")
def parse_number_cases(spark, d):
    """Numbers of hand-made spellings: thousands spaces, decimal commas, type suffixes, infinities, overflow."""
    k = F.col("p_partkey") % 8
    size = F.col("p_size").cast("string")
    text = F.when(k == 0, size).when(k == 1, F.concat(F.lit(" 1 "), size)).when(k == 2, F.concat(size, F.lit(",5"))).when(k == 3, F.concat(size, F.lit("d"))).when(k == 4, "inf").when(k == 5, F.concat(F.lit("-"), size, F.lit(".25"))).when(k == 6, "1e400").otherwise("0")
    rows = table(spark, d, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", "text", C.parse_number(F.col("text")).alias("number"), C.value_status(F.col("text"), F.lit(True)).alias("status"))


@query(f"SELECT p_partkey, {letters_sql('(p_partkey % 16384 + 1)')} AS letters, CAST(p_partkey % 16384 + 1 AS BIGINT) AS back, {letters_sql('(p_partkey % 16384 + 1)')} || CAST(p_size AS VARCHAR) AS addr, true AS derived FROM part")
def a1_codec(spark, d):
    n = F.col("p_partkey") % 16384 + 1
    rows = table(spark, d, "part").select("p_partkey", "p_size", n.alias("n"), C.address(n, F.col("p_size")).alias("addr"))
    return rows.select("p_partkey", C.column_letters(F.col("n")).alias("letters"), C.column_index(C.column_letters(F.col("n"))).cast("long").alias("back"), "addr", C.is_derived_address(F.col("addr"), F.col("n"), F.col("p_size")).alias("derived"))


@query(f"""SELECT p_partkey, CAST(p_partkey % 300 + 1 AS BIGINT) AS c1, CAST(p_partkey % 300 + 1 + p_size % 7 AS BIGINT) AS c2, CASE WHEN p_size % 5 = 0 THEN 1 ELSE CAST(p_size AS BIGINT) END AS r1, CASE WHEN p_size % 5 = 0 THEN 1048576 ELSE CAST(p_size + p_partkey % 11 AS BIGINT) END AS r2 FROM part""")
def rectangle_parse(spark, d):
    c1, c2 = C.column_letters(F.col("p_partkey") % 300 + 1), C.column_letters(F.col("p_partkey") % 300 + 1 + F.col("p_size") % 7)
    whole = F.concat(c1, F.lit(":$"), c2)
    body = F.when(F.col("p_size") % 5 == 0, whole).otherwise(F.concat(c2, F.lit("$"), (F.col("p_size") + F.col("p_partkey") % 11).cast("string"), F.lit(":$"), c1, F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", C.rectangle(body).alias("r")).select("p_partkey", "r.*")


@query("SELECT s.l_shipdate, CAST(date_diff('day', DATE '1899-12-30', s.l_shipdate) AS BIGINT) AS serial, strftime(s.l_shipdate, '%d.%m.%Y') AS shown FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem) s")
def excel_serial_dates(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("l_shipdate")).distinct()
    serial = C.date_to_serial(F.col("l_shipdate"))
    return rows.select("l_shipdate", serial.cast("long").alias("serial"), C.display_text(serial.cast("string"), F.lit("dd/mm/yy")).alias("shown"))


@query("""WITH k AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) WHEN 2 THEN year(o_orderdate) || 'H' || (CASE WHEN month(o_orderdate) > 6 THEN 2 ELSE 1 END) WHEN 3 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS key, o_orderdate AS d FROM orders)
SELECT o_orderkey, key, ['year', 'quarter', 'half_year', 'month', 'day'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS grain, CAST(CASE o_orderkey % 5 WHEN 0 THEN year(d) WHEN 1 THEN year(d) * 4 + quarter(d) WHEN 2 THEN year(d) * 2 + (CASE WHEN month(d) > 6 THEN 2 ELSE 1 END) WHEN 3 THEN year(d) * 12 + month(d) ELSE date_diff('day', DATE '0001-01-01', CAST(d AS DATE)) + 1 END AS BIGINT) AS ordinal, CAST(year(d) AS VARCHAR) AS year_key FROM k""")
def period_key_position(spark, d):
    year, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 5
    key = F.when(k == 0, year).when(k == 1, F.concat(year, F.lit("Q"), F.quarter("o_orderdate").cast("string"))).when(k == 2, F.concat(year, F.lit("H"), F.when(F.month("o_orderdate") > 6, "2").otherwise("1"))).when(k == 3, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, d, "orders").select("o_orderkey", key.alias("key"))
    return rows.select("o_orderkey", "key", P.period_position(F.col("key"))["grain"].alias("grain"), P.period_position(F.col("key"))["ordinal"].alias("ordinal"), P.apply_grain(F.col("key"), "year").alias("year_key"))


@query("""WITH k AS (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderkey % 3 AS m FROM orders)
SELECT o_orderkey, CASE WHEN m = 2 THEN 'unaligned' WHEN q = 1 THEN 'same' ELSE CAST(1 - q AS VARCHAR) END AS lag FROM k""")
def calendar_lag(spark, d):
    year = F.year("o_orderdate").cast("string")
    own = F.concat(year, F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 3 == 1, "@plan").otherwise(""))
    other = F.when(F.col("o_orderkey") % 3 == 2, year).otherwise(F.concat(year, F.lit("Q1")))
    return table(spark, d, "orders").select("o_orderkey", P.calendar_lag(own, other).alias("lag"))


@query("""WITH k AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders),
s AS (SELECT o_custkey, date_diff('day', lag(d) OVER w, d) AS days, date_diff('month', lag(d) OVER w, d) AS months FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY d)),
g AS (SELECT o_custkey, list(days ORDER BY days) FILTER (days IS NOT NULL) AS ds, list(months ORDER BY months) FILTER (days IS NOT NULL) AS ms FROM s GROUP BY o_custkey),
u AS (SELECT o_custkey, ds[len(ds) // 2 + 1] AS dd, ms[len(ms) // 2 + 1] AS mm FROM g WHERE len(ds) > 0)
SELECT k.o_custkey, CASE WHEN dd BETWEEN 25 AND 35 THEN 'month' WHEN mm <= 1 THEN 'month' WHEN mm BETWEEN 2 AND 4 THEN 'quarter' WHEN mm BETWEEN 5 AND 7 THEN 'half_year' WHEN mm BETWEEN 11 AND 13 THEN 'year' END AS grain FROM (SELECT DISTINCT o_custkey FROM k) k LEFT JOIN u USING (o_custkey)""")
def infer_grain(spark, d):
    keys = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.date_format("o_orderdate", "yyyy-MM")).alias("keys"))
    return keys.select("o_custkey", P.infer_grain(F.col("keys")).alias("grain"))


@query("SELECT p_brand, arg_max(p_type, n * 1000000 - f) AS p_type, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, count(*) - 1 AS exceptions FROM (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL) GROUP BY p_brand")
def row_fingerprint_majority(spark, d):
    return O.majority(table(spark, d, "part"), ["p_brand"], "p_type", "p_partkey")


RECTS = "SELECT p_partkey AS id, CAST(p_partkey % 20 + 1 AS BIGINT) AS c1, CAST(p_partkey % 20 + 1 + p_size % 4 AS BIGINT) AS c2, CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE CAST(p_size * 10 AS BIGINT) END AS r1, CASE WHEN p_partkey % 97 = 0 THEN 1048576 ELSE CAST(p_size * 10 + p_partkey % 40 AS BIGINT) END AS r2 FROM part"


def rects(spark, d) -> DataFrame:
    whole = F.col("p_partkey") % 97 == 0
    c1 = F.col("p_partkey") % 20 + 1
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("S").alias("sheet"), c1.alias("c1"), (c1 + F.col("p_size") % 4).alias("c2"), F.when(whole, F.lit(1)).otherwise(F.col("p_size") * 10).cast("long").alias("r1"), F.when(whole, F.lit(1048576)).otherwise(F.col("p_size") * 10 + F.col("p_partkey") % 40).cast("long").alias("r2"))


@query(f"WITH r AS ({RECTS}) SELECT id, (c2 - c1 + 1) * (r2 - r1 + 1) AS area, (c2 - c1 + 1) * (r2 - r1 + 1) > 64 OR (r1 = 1 AND r2 = 1048576) AS node FROM r")
def range_node_split(spark, d):
    return rects(spark, d).select("id", R.area().alias("area"), R.is_range_node().alias("node"))


@query(f"WITH r AS ({RECTS}), s AS (SELECT * FROM r WHERE (c2 - c1 + 1) * (r2 - r1 + 1) <= 64) SELECT id, CAST(rr AS BIGINT) AS \"row\", CAST(cc AS BIGINT) AS col, CAST((rr - r1) * (c2 - c1 + 1) + cc - c1 AS BIGINT) AS ord, false AS truncated FROM (SELECT *, unnest(range(c1, c2 + 1)) AS cc FROM (SELECT *, unnest(range(r1, r2 + 1)) AS rr FROM s))")
def expand_range(spark, d):
    return R.expand(rects(spark, d).where(~R.is_range_node())).select("id", "row", "col", "ord", "truncated")


POINTS = "SELECT o_orderkey AS pid, CAST(o_orderkey % 25 + 1 AS BIGINT) AS col, CAST(o_custkey % 600 + 1 AS BIGINT) AS \"row\" FROM orders"


def points(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pid"), F.lit("S").alias("sheet"), (F.col("o_orderkey") % 25 + 1).alias("col"), (F.col("o_custkey") % 600 + 1).alias("row"))


@query(f"WITH r AS ({RECTS}), p AS (SELECT DISTINCT \"row\", col FROM ({POINTS})) SELECT id, count(*) AS members, CAST(min(\"row\" * 100000 + col) AS BIGINT) AS first_member FROM r JOIN p ON p.col BETWEEN c1 AND c2 AND p.\"row\" BETWEEN r1 AND r2 GROUP BY id")
def range_members(spark, d):
    """Present cells of each rectangle: how many, and the first by row and column."""
    cells = points(spark, d).select("sheet", "row", "col").distinct()
    of, same = rects(spark, d), ["sheet", "c1", "c2", "r1", "r2"]
    found = R.cover(cells, of.select(*same).distinct(), ["sheet"])  # equal rectangles are looked up once
    found = found.groupBy(*same).agg(F.count("*").alias("members"), F.min(F.col("row") * 100000 + F.col("col")).alias("first_member"))
    return of.join(found, same).groupBy("id").agg(F.sum("members").alias("members"), F.min("first_member").alias("first_member"))


@query(f"WITH r AS ({RECTS}), p AS (SELECT DISTINCT \"row\", col FROM ({POINTS})) SELECT \"row\", col, count(*) AS covers FROM p JOIN r ON p.col BETWEEN c1 AND c2 AND p.\"row\" BETWEEN r1 AND r2 GROUP BY ALL")
def range_cover(spark, d):
    cells = points(spark, d).select("sheet", "row", "col").distinct()
    return R.cover_counts(cells, rects(spark, d), ["sheet"]).select("row", "col", "covers")


@query("""SELECT l_orderkey, l_linenumber, n, CASE WHEN l_suppkey % 13 = 0 THEN 'unresolved' WHEN s_suppkey IS NOT NULL AND s_suppkey % 3 > 0 THEN 'cell' WHEN l_suppkey % 7 = 0 THEN 'missing' WHEN l_suppkey % 5 = 0 THEN 'missing' ELSE 'empty' END AS status,
CASE WHEN l_suppkey % 13 = 0 THEN 'unresolved' WHEN s_suppkey IS NOT NULL AND s_suppkey % 3 > 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN 'missing_sheet' WHEN l_suppkey % 5 = 0 THEN 'parser_resolution_failure' WHEN l_linenumber > 1 THEN 'empty_range_member' ELSE 'empty_ref' END AS reason
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def classify_member(spark, d):
    """Targets against known cells and sheets, by the first rule that fits."""
    edges = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.count("*").alias("n"))
    known = table(spark, d, "supplier").select("s_suppkey")
    rows = edges.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    of = R.classify_member(F.col("s_suppkey").isNotNull() & (F.col("s_suppkey") % 3 > 0), F.col("l_suppkey") % 7 != 0, F.when(F.col("l_suppkey") % 5 == 0, "populated"), F.col("l_linenumber") > 1, F.col("l_suppkey") % 13 == 0)
    return rows.select("l_orderkey", "l_linenumber", "n", of["status"].alias("status"), of["reason"].alias("reason"))


@query("SELECT o_orderkey AS target, CASE WHEN l.k IS NULL THEN 'empty' ELSE 'cell' END AS kind FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = l.k")
def union_empty_targets(spark, d):
    """Known nodes and targets that are none, by one join; both sides are dealt alike, so no task's share grows."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"))
    targets = table(spark, d, "orders").select(F.col("o_orderkey").alias("target"))
    n = lines.count()
    cells = spread(lines, "target", rows=n).distinct().withColumn("known", F.lit(True))
    found = spread(targets, "target", rows=n).join(cells.hint("merge"), "target", "left")
    return found.select("target", F.when(F.col("known"), "cell").otherwise("empty").alias("kind"))


@query("SELECT l_partkey AS target, arg_min(l_orderkey, l_orderkey * 100 + l_linenumber) AS first_source, min(l_orderkey * 100 + l_linenumber) AS ord FROM lineitem GROUP BY l_partkey")
def first_seen_targets(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("first_source"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return O.first_seen(rows, ["target"], ["ord", "first_source"])


SHEETS = GRID + ", tops AS (SELECT DISTINCT sheet, col FROM grid), spans AS (SELECT sheet, max(\"row\") AS last FROM grid GROUP BY sheet) "


def parsed(spark, d) -> tuple[DataFrame, DataFrame]:
    cells = grid.formulas(grid.grid(spark, d))
    return cells, G.parse_cells(cells)


@query(SHEETS + f"SELECT sheet || '!' || {letters_sql('col')} || (last + 1) AS source, 'range' AS kind, sheet || '!' || {letters_sql('col')} || '2:' || {letters_sql('col')} || last AS target FROM tops JOIN spans USING (sheet) UNION ALL SELECT sheet || '!' || {letters_sql('col')} || (last + 2), 'ref', sheet || '!' || {letters_sql('(col - 1)')} || (last + 2) FROM tops JOIN spans USING (sheet) WHERE col > 2 UNION ALL SELECT sheet || '!' || {letters_sql('col')} || (last + 2), 'ref', sheet || '!' || {letters_sql('col')} || (last + 1) FROM tops JOIN spans USING (sheet) WHERE col > 2")
def formula_edges(spark, d):
    """Edges parsed out of generated formulas; the SQL derives them by arithmetic."""
    return G.formula_edges(parsed(spark, d)[1]).select("source", "kind", "target")


@query(SHEETS + "SELECT sheet || '!' || 'x' AS sheet_x, '=SUM(R[-' || (last - 1) || ']C[0]:R[-1]C[0])' AS formula_template, count(*) AS n FROM tops JOIN spans USING (sheet) GROUP BY ALL UNION ALL SELECT sheet || '!' || 'x', '=R[0]C[-1]+R[-1]C[0]', count(*) FROM tops JOIN spans USING (sheet) WHERE col > 2 GROUP BY ALL")
def formula_template(spark, d):
    return parsed(spark, d)[1].groupBy(F.concat("sheet", F.lit("!x")).alias("sheet_x"), "formula_template").agg(F.count("*").alias("n"))


@query(SHEETS + f"SELECT sheet || '!' || {letters_sql('col')} || (last + 1) AS cell, 'aggregation' AS formula_class, CAST(1 AS BIGINT) AS refs FROM tops JOIN spans USING (sheet) UNION ALL SELECT sheet || '!' || {letters_sql('col')} || (last + 2), CASE WHEN EXISTS (SELECT 1 FROM tops t WHERE t.sheet = tops.sheet AND t.col = tops.col - 1 AND t.col > 2) THEN 'rollforward' ELSE 'same_period' END, CAST(2 AS BIGINT) FROM tops JOIN spans USING (sheet) WHERE col > 2")
def formula_links(spark, d):
    """Formulas with their class: sums are aggregations, carried balances roll forward."""
    cells, tree = parsed(spark, d)
    edges = G.formula_edges(tree)
    nodes = cells.select("book_id", F.concat("sheet", F.lit("!"), "addr").alias("node_id"), "period_id")
    formulas = cells.select("book_id", F.concat("sheet", F.lit("!"), "addr").alias("source"), F.col("formula_raw").alias("formula"))
    out = graph.links(formulas, edges, graph.enrich(edges.where("kind = 'ref'"), nodes))
    return out.select("cell", "formula_class", F.size("refs").cast("long").alias("refs"))


@query(SHEETS + "SELECT 'range' AS kind, count(*) AS edges FROM tops UNION ALL SELECT 'ref', 2 * count(*) FROM tops WHERE col > 2")
def edge_kind_counts(spark, d):
    return graph.edge_counters(G.formula_edges(parsed(spark, d)[1])).select("kind", "edges")


@query("WITH s AS (SELECT l_returnflag, l_partkey, min(l_orderkey) AS o FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY o, l_partkey) AS rn FROM s) SELECT l_returnflag, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 32) AS ids FROM r GROUP BY l_returnflag")
def capped_ids(spark, d):
    out = O.capped_ids(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey", "l_orderkey", 32)
    return out.select("l_returnflag", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


NEXT = "WITH RECURSIVE f AS (SELECT p_partkey AS p, (p_partkey * p_partkey + 3) % (SELECT count(*) FROM part) AS q FROM part)"


def functional(spark, d) -> DataFrame:
    """A graph with one edge from each part key p, to p * p + 3 modulo the number of parts."""
    part = table(spark, d, "part")
    n = part.count()
    p = F.col("p_partkey")
    return part.select(F.lit("parts").alias("book_id"), p.cast("string").alias("source"), ((p * p + 3) % n).cast("string").alias("target"), F.lit("-1").alias("period_lag"))


@query(NEXT + ", walk AS (SELECT p AS a, q AS b FROM f UNION SELECT a, q FROM walk JOIN f ON p = b) SELECT CAST(a AS VARCHAR) AS member, 'iterative_ok' AS class FROM walk WHERE a = b")
def scc_cycles(spark, d):
    out = graph.cycles(functional(spark, d))
    return out.select(F.explode("members").alias("member"), "class")


@query(NEXT + ", walk AS (SELECT p AS o, p AS node, 0 AS depth FROM f WHERE p % 50 = 0 UNION SELECT o, q, depth + 1 FROM walk JOIN f ON p = node WHERE depth < 8) SELECT CAST(o AS VARCHAR) AS origin, CAST(node AS VARCHAR) AS node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY o, node")
def trace_precedents(spark, d):
    """Nodes within eight steps of every origin (part keys divisible by 50), with their least depth."""
    origins = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.lit("parts").alias("book_id"), F.col("p_partkey").cast("string").alias("origin"))
    return graph.trace(functional(spark, d), origins).select("origin", "node", "depth")


@query(NEXT + ", walk AS (SELECT p AS o, p AS node, 0 AS depth FROM f WHERE p % 50 = 0 UNION SELECT o, p, depth + 1 FROM walk JOIN f ON q = node WHERE depth < 4) SELECT CAST(o AS VARCHAR) AS origin, CAST(node AS VARCHAR) AS node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY o, node")
def trace_dependents(spark, d):
    origins = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.lit("parts").alias("book_id"), F.col("p_partkey").cast("string").alias("origin"))
    return graph.trace(functional(spark, d), origins, "dependents", 4).select("origin", "node", "depth")


def every_part(spark, d, direction: str) -> DataFrame:
    origins = table(spark, d, "part").select(F.lit("parts").alias("book_id"), F.col("p_partkey").cast("string").alias("origin"))
    return graph.trace(functional(spark, d), origins, direction).select("origin", "node", "depth")


@query()
def trace_precedents_all(spark, d):
    """trace_precedents from every part, at the default depth."""
    return every_part(spark, d, "precedents")


@query()
def trace_dependents_all(spark, d):
    """trace_dependents from every part, at the default depth."""
    return every_part(spark, d, "dependents")


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS s, CAST(floor(epoch(ts) / 3600) AS BIGINT) + event_id % 5 AS e FROM events),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS b FROM e),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, i""")
def merge_spans(spark, d):
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = table(spark, d, "events").select("user_id", hour.alias("s"), (hour + F.col("event_id") % 5).alias("e")).distinct()
    return O.merge_spans(rows, ["user_id"], "s", "e")


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events), g AS (SELECT *, CASE WHEN day - lag(day) OVER w >= 3 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS band FROM g""")
def gap_bands(spark, d):
    rows = table(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 86400).alias("day")).distinct()
    return O.gap_bands(rows, ["user_id"], "day")


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, row_number() OVER (PARTITION BY user_id ORDER BY day) AS place FROM e)
SELECT user_id, min(place) AS first_place, max(place) AS last_place, min(day) AS first_value, count(*) AS n FROM g GROUP BY user_id, i HAVING count(*) >= 3""")
def integer_runs(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 86400).alias("day")).distinct()
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long"))
    return O.integer_runs(rows, ["user_id"], "place", "day", 3)


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caption FROM events")
def fill_forward(spark, d):
    rows = table(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return rows.select("user_id", "event_id", O.fill_forward("mark", ["user_id"], ["ts", "event_id"]).alias("caption"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, year(min(l_shipdate)) || 'Q' || quarter(min(l_shipdate)) AS key, min(l_returnflag) AS marker FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey, key, count(*) AS n, count(DISTINCT marker) AS m FROM k GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 AND m > 1 THEN k.key || '@' || marker ELSE k.key END AS key FROM k JOIN c USING (l_orderkey, key)""")
def key_disambiguation(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("s"), F.min("l_returnflag").alias("marker"))
    rows = rows.withColumn("key", F.concat(F.year("s").cast("string"), F.lit("Q"), F.quarter("s").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", O.disambiguate("key", "marker", ["l_orderkey"]).alias("key"))


@query("SELECT e.event_id, e.user_id, p.event_id AS caption FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_caption(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    captions = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("caption"))
    return O.as_of(events.where("event_type <> 'purchase'"), captions, ["user_id"], "ts", "caption").select("event_id", "user_id", "caption")


@query("""WITH t AS (SELECT p_partkey, ['k£', 'USD m', '€ bn', 'RUR', 'kUSD', '%', 'years', 'pcs', 'GBP per MWh', '000s EUR'][CAST(p_partkey % 10 + 1 AS INTEGER)] AS u FROM part)
SELECT p_partkey, u AS unit_text, [ 'GBP','USD','EUR','RUB','USD',NULL,NULL,NULL,'GBP','EUR'][CAST(p_partkey % 10 + 1 AS INTEGER)] AS currency, ['k','m','bn','unit','unit','unit','unit','unit','unit','k'][CAST(p_partkey % 10 + 1 AS INTEGER)] AS scale, ['money','money','money','money','money','ratio','years','count','rate','money'][CAST(p_partkey % 10 + 1 AS INTEGER)] AS kind FROM t""")
def measures(spark, d):
    """Currency, scale and kind of unit texts."""
    texts = F.array(*map(F.lit, ["k£", "USD m", "€ bn", "RUR", "kUSD", "%", "years", "pcs", "GBP per MWh", "000s EUR"]))
    rows = table(spark, d, "part").select("p_partkey", F.get(texts, (F.col("p_partkey") % 10).cast("int")).alias("unit_text"))
    u = F.col("unit_text")
    return rows.select("p_partkey", "unit_text", C.currency_code(u).alias("currency"), C.scale_token(u).alias("scale"), C.unit_kind(u).alias("kind"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'blue')")
def label_search(spark, d):
    return table(spark, d, "part").where(C.label_contains(F.col("p_name"), " RING ") | C.label_contains(F.col("p_name"), "Blue")).select("p_partkey", "p_name")


@query(GRID + "SELECT sheet, col, CAST(sum(cents) AS BIGINT) AS total, true AS confirmed FROM grid GROUP BY ALL")
def total_confirmation(spark, d):
    """Sums of columns against the cached totals, within the tolerance."""
    from gridloom.params import TOTAL_ABS, TOTAL_REL

    cells = grid.grid(spark, d)
    sums = cells.groupBy("sheet", "col").agg(F.sum("cents").alias("total"), F.sum(F.col("cents").cast("double")).alias("x"))
    return sums.select("sheet", "col", "total", (F.abs(F.col("x") - F.col("total")) <= F.greatest(F.lit(TOTAL_ABS), F.abs("x") * TOTAL_REL)).alias("confirmed"))


@query(SHEETS + "SELECT sheet, last + 1 AS total_row, last - 1 AS members FROM spans")
def relation_aggregate(spark, d):
    """Total rows and how many line items stand in their span, from the parsed ranges."""
    cells, tree = parsed(spark, d)
    edges = G.formula_edges(tree).where("kind = 'range'")
    body = C.split_sheet(F.col("target"))
    own = C.parse_address(C.split_sheet(F.col("source"))["body"])["row"]
    spans = edges.select(body["sheet"].alias("sheet"), own.alias("total_row"), C.rectangle(body["body"]).alias("r")).select("sheet", "total_row", "r.r1", "r.r2").distinct()
    lines = grid.grid(spark, d).select("sheet", "row").distinct()
    return spans.join(lines, "sheet").where("row between r1 and r2").groupBy("sheet", "total_row").agg(F.count("*").alias("members"))


@query("WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_id % 4 AS g FROM events), k AS (SELECT *, max(g) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT user_id, count(*) AS kept, CAST(arg_max(event_id, o) AS BIGINT) AS last_event FROM k WHERE top IS NULL OR g >= top GROUP BY user_id")
def generation_guard(spark, d):
    """Status events of a generation lower than one already stored are dropped (batch twin of the stream)."""
    from gridloom.streaming.progress import guarded

    events = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", (F.col("event_id") % 4).alias("generation"))
    return guarded(events).groupBy(F.col("job_id").alias("user_id")).agg(F.count("*").alias("kept"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("SELECT event_type, CAST(floor(epoch(time_bucket(INTERVAL 1 DAY, ts))) AS BIGINT) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    w = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select("event_type", F.unix_timestamp("w.start").alias("day"), "n", "users")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS i FROM e) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n FROM g GROUP BY user_id, i""")
def session_window(spark, d):
    w = F.session_window("ts", "6 hours")
    return table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("started"), "n")


@query("SELECT user_id AS session_id, count(*) FILTER (event_type <> 'purchase') AS inflight, count(*) FILTER (event_type <> 'purchase') >= 3 AS full_ FROM events GROUP BY user_id")
def session_inflight(spark, d):
    from gridloom.streaming.progress import inflight

    events = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "purchase", "succeeded").otherwise("queued").alias("status"))
    return inflight(events)


@query("""WITH d AS (SELECT p_partkey AS o, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS sheet, 'Name' || (p_size % 20) AS name, CASE p_partkey % 4 WHEN 0 THEN 'S!$A$' || p_size WHEN 1 THEN 'S!$B$1:$C$' || p_size WHEN 2 THEN 'S!A1' ELSE '[1]S!$A$1' END AS f FROM part),
l AS (SELECT sheet, name, arg_max(f, o) AS f FROM d GROUP BY ALL), u AS (SELECT DISTINCT p_brand AS sheet, 'Name' || (p_size % 23) AS name FROM part),
r AS (SELECT u.sheet, u.name, coalesce(a.f, b.f) AS f FROM u LEFT JOIN l a ON a.sheet = u.sheet AND a.name = u.name LEFT JOIN l b ON b.sheet IS NULL AND b.name = u.name)
SELECT sheet, lower(name) AS name, CASE WHEN f IS NULL THEN 'unknown' WHEN contains(f, '[') THEN 'external' WHEN contains(f, '$') THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN contains(f, '$') AND NOT contains(f, '[') THEN replace(f, '$', '') END AS target FROM r""")
def defined_names(spark, d):
    """Names of sheets and of the workbook: the nearest scope, the last definition, absolute targets only."""
    from gridloom.operators.lookups import resolve_names

    part = table(spark, d, "part")
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    formula = F.when(k == 0, F.concat(F.lit("S!$A$"), size)).when(k == 1, F.concat(F.lit("S!$B$1:$C$"), size)).when(k == 2, "S!A1").otherwise("[1]S!$A$1")
    names = part.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("sheet"), F.concat(F.lit("Name"), (F.col("p_size") % 20).cast("string")).alias("name"), formula.alias("formula"), F.col("p_partkey").alias("ordinal"))
    uses = part.select(F.col("p_brand").alias("sheet"), F.concat(F.lit("name"), (F.col("p_size") % 23).cast("string")).alias("name")).distinct()
    return resolve_names(uses, names).select("sheet", "name", "status", "target")


@query("SELECT coalesce(o_orderkey, k) AS cell, coalesce(v, CAST(o_custkey AS VARCHAR)) AS value FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 > 0) a FULL JOIN (SELECT l_orderkey AS k, 'x' || min(l_partkey) AS v FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey) b ON o_orderkey = k")
def cache_overlay(spark, d):
    """Values of one workbook over those of its converted copy."""
    from gridloom.operators.lookups import overlay

    base = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("cell"), F.col("o_custkey").cast("string").alias("value"))
    top = table(spark, d, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("cell")).agg(F.concat(F.lit("x"), F.min("l_partkey").cast("string")).alias("value"))
    return overlay(base, top, ["cell"], "value")


@query("WITH v AS (SELECT l_returnflag, l_orderkey, min(l_linenumber) AS c FROM lineitem GROUP BY ALL), n AS (SELECT l_returnflag, c, count(*) AS n FROM v GROUP BY ALL) SELECT l_returnflag, CAST(arg_max(c, n * 1000 - c) AS BIGINT) AS label_col, max(n) AS n FROM n GROUP BY l_returnflag")
def label_column_votes(spark, d):
    from gridloom.operators.lookups import label_column

    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return label_column(rows, ["l_returnflag"], "l_orderkey", "l_linenumber")


@query("WITH s AS (SELECT DISTINCT p_brand, p_type, p_size FROM part), g AS (SELECT DISTINCT p_brand FROM part), p AS (SELECT p_brand AS a, lead(p_brand) OVER (ORDER BY p_brand) AS b FROM g), x AS (SELECT a, b, (SELECT count(*) FROM (SELECT DISTINCT p_size FROM s WHERE p_brand = a INTERSECT SELECT DISTINCT p_size FROM s WHERE p_brand = b)) AS i, (SELECT count(*) FROM (SELECT DISTINCT p_size FROM s WHERE p_brand = a UNION SELECT DISTINCT p_size FROM s WHERE p_brand = b)) AS u FROM p WHERE b IS NOT NULL) SELECT a, b, i / CAST(u AS DOUBLE) AS overlap FROM x")
def column_set_overlap(spark, d):
    """Overlap of the column sets of neighbouring brands."""
    from pyspark.sql import Window

    from gridloom.operators.lookups import jaccard

    sets = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("s"))
    w = Window.orderBy("p_brand")
    out = sets.select(F.col("p_brand").alias("a"), F.lead("p_brand").over(w).alias("b"), "s", F.lead("s").over(w).alias("t")).where("b is not null")
    return out.select("a", "b", jaccard(F.col("s"), F.col("t")).alias("overlap"))


@query("SELECT * FROM (SELECT 0 AS priority, s_suppkey AS ord, 'supplier ' || s_suppkey AS line FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 1, p_partkey, 'part ' || p_partkey FROM part) ORDER BY 1, 2 LIMIT 50")
def warning_lines(spark, d):
    """The first fifty warnings, a source before the next."""
    from gridloom.operators.lookups import capped_lines
    from gridloom.params import WARNINGS

    line = lambda t, key, word: t.select(F.col(key).alias("ord"), F.concat(F.lit(word), F.col(key).cast("string")).alias("line"))
    return capped_lines([line(table(spark, d, "supplier").where("s_suppkey % 4 = 0"), "s_suppkey", "supplier "), line(table(spark, d, "part"), "p_partkey", "part ")], "ord", WARNINGS)


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events), g AS (SELECT *, o - row_number() OVER (PARTITION BY user_id, event_type ORDER BY o) AS i FROM e),
r AS (SELECT user_id, event_type, min(o) AS f, count(*) AS n FROM g GROUP BY user_id, event_type, i HAVING count(*) >= 2) SELECT user_id, arg_max(event_type, n * 1000000 - f) AS event_type, arg_max(f, n * 1000000 - f) AS first_place, max(n) AS n FROM r GROUP BY user_id""")
def longest_equal_run(spark, d):
    """The longest run of equal templates in a row, the first among equals."""
    from pyspark.sql import Window

    o = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, d, "events").select("user_id", "event_type", o.alias("o"))
    return O.equal_runs(rows, ["user_id"], "o", "event_type", 2)


@query("""WITH v AS (SELECT DISTINCT p_brand, p_size FROM part), g AS (SELECT p_brand, p_size, p_size - row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM v), s AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS b FROM g GROUP BY p_brand, i)
SELECT p_brand, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM s GROUP BY p_brand""")
def span_texts(spark, d):
    from gridloom.operators.lookups import span_text

    return table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("s")).select("p_brand", span_text(F.col("s")).alias("spans"))


@query("SELECT p_partkey, p_brand || CASE WHEN row_number() OVER w > 1 THEN '#' || row_number() OVER w ELSE '' END AS block_id FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def block_id_suffix(spark, d):
    from gridloom.operators.lookups import suffixed

    return table(spark, d, "part").select("p_partkey", suffixed("p_brand", ["p_partkey"]).alias("block_id"))


@query("WITH q AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) % 5 AS v FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, coalesce(count(*) OVER w >= 2 AND sum(v) OVER w = v, false) AS is_total FROM q WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def left_neighbour_sums(spark, d):
    """Values that are the sum of all values to their left."""
    from gridloom.operators.lookups import is_running_sum

    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.sum(F.col("l_quantity").cast("bigint")) % 5).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", is_running_sum("v", ["l_orderkey"], "l_linenumber").alias("is_total"))


@query("SELECT p_partkey, sha256('context:' || sha256(p_name)) AS job_id, replace(p_name || '|x', '|', '\\|') AS cell FROM part")
def ids_and_escapes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat(F.lit("context:"), F.sha2("p_name", 256)), 256).alias("job_id"), C.markdown_cell(F.concat("p_name", F.lit("|x"))).alias("cell"))


@query("WITH a AS (SELECT n_name AS name, n_nationkey AS o FROM nation), b AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Sheet' || n_nationkey END AS name, n_nationkey AS o FROM nation), s AS (SELECT a.name AS l, b.name AS r FROM a JOIN b ON a.name = b.name), ra AS (SELECT name, row_number() OVER (ORDER BY o) AS k FROM a WHERE name NOT IN (SELECT l FROM s)), rb AS (SELECT name, row_number() OVER (ORDER BY o) AS k FROM b WHERE name NOT IN (SELECT r FROM s)) SELECT l AS left_name, r AS right_name, true AS by_name FROM s UNION ALL SELECT ra.name, rb.name, false FROM ra JOIN rb USING (k)")
def sheet_pairing(spark, d):
    """Sheets of two workbooks by name, the rest by order."""
    from gridloom.operators.lookups import pair

    n = table(spark, d, "nation")
    other = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("Sheet"), F.col("n_nationkey").cast("string"))).alias("n_name"), "n_nationkey")
    return pair(n, other, "n_name", "n_nationkey")


@query("""SELECT p_partkey, ['rate','years','count','ratio','date','money','price','other'][CAST(p_partkey % 8 + 1 AS INTEGER)] AS unit,
CASE p_partkey % 8 WHEN 0 THEN '%' WHEN 1 THEN 'years' WHEN 2 THEN 'count' WHEN 3 THEN 'x' WHEN 4 THEN 'date' WHEN 5 THEN coalesce(nullif(m, ''), 'money') WHEN 6 THEN coalesce(nullif(m, ''), 'money') || '/' || coalesce(CASE WHEN p_size % 2 = 0 THEN 'MWh' END, 'unit') ELSE '' END AS shown
FROM (SELECT *, ['', 'k', 'm', 'bn'][CAST(p_size % 4 + 1 AS INTEGER)] || CASE p_size % 5 WHEN 0 THEN '£' WHEN 1 THEN '$' WHEN 2 THEN '€' WHEN 3 THEN '₽' ELSE '' END AS m FROM part)""")
def unit_displays(spark, d):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    unit = pick(["rate", "years", "count", "ratio", "date", "money", "price", "other"], F.col("p_partkey") % 8)
    shown = C.unit_display(unit, pick(["GBP", "USD", "EUR", "RUB", None], F.col("p_size") % 5), pick(["unit", "k", "m", "bn"], F.col("p_size") % 4), F.when(F.col("p_size") % 2 == 0, "MWh"))
    return table(spark, d, "part").select("p_partkey", unit.alias("unit"), shown.alias("shown"))


@query("""SELECT p_partkey, f AS fmt, CASE p_partkey % 6 WHEN 0 THEN printf('%.0f', p_size + 0.25) WHEN 1 THEN printf('%.2f', p_size + 0.25) WHEN 2 THEN printf('%.1f', (p_size + 0.25) * 100) WHEN 3 THEN printf('%.3f', p_size + 0.25) END AS shown
FROM (SELECT *, ['0', '#,##0.00;[Red]-0', '0.0%', '"x"0.0##', '@', 'General'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS f FROM part)""")
def displayed_numbers(spark, d):
    """Digits under number formats; formats without digits show none."""
    fmt = F.get(F.array(*map(F.lit, ["0", "#,##0.00;[Red]-0", "0.0%", '"x"0.0##', "@", "General"])), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", fmt.alias("fmt"), C.displayed_number((F.col("p_size") + 0.25).cast("string"), fmt).alias("shown"))


@query("""SELECT n_nationkey, s AS sheet, CASE WHEN n_nationkey % 5 IN (0, 2, 4) THEN 'Sheet ' || s || ' is a chart copy, not a calculation' END AS note, n_nationkey % 4 < 3 AS value_block, n_nationkey % 3 < 2 AND n_nationkey % 4 <> 1 AS series
FROM (SELECT *, ['Charts', n_name, 'Dashboard 2', 'Chart of accounts', 'графики'][n_nationkey % 5 + 1] AS s FROM nation)""")
def block_predicates(spark, d):
    """Chart sheets, blocks of values, series columns."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in names]), n)
    k = F.col("n_nationkey")
    sheet = pick(["Charts", F.col("n_name"), "Dashboard 2", "Chart of accounts", "графики"], k % 5)
    block, kind, key = pick(["params", "key_value", "matrix", "timeline"], k % 4), pick(["period", "relative", "total"], k % 3), pick(["2024", "total", "2025", "M1"], k % 4)
    return table(spark, d, "nation").select("n_nationkey", sheet.alias("sheet"), C.chart_note(sheet).alias("note"), C.is_value_block(block).alias("value_block"), C.is_series_column(kind, key).alias("series"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), f AS (SELECT l_linenumber AS sheet, l_orderkey, p % 4 = 0 AS missing, p % 4 = 0 AND s % 3 > 0 AS wanted, p % 9 = 0 AS bad FROM c WHERE s % 7 > 0)
SELECT sheet, count(*) AS formulas, count(*) FILTER (missing) AS missing_cached, count(*) FILTER (wanted) AS missing_values, count(*) FILTER (bad) AS unparsed,
array_to_string(list(l_orderkey ORDER BY l_orderkey) FILTER (wanted)[1:3], ',') AS missing_samples, array_to_string(list(l_orderkey ORDER BY l_orderkey) FILTER (bad)[1:3], ',') AS unparsed_samples FROM f GROUP BY sheet""")
def formula_statistics(spark, d):
    """Line items as cells of sheets by line number: formulas, missing caches, unparsed ones and their first three."""
    from gridloom.operators.facts import formula_stats

    c = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    cells = c.select(F.col("l_linenumber").alias("sheet"), F.col("l_orderkey").alias("cell"), F.col("l_orderkey").alias("ordinal"), F.when(F.col("s") % 7 > 0, "=A1").alias("formula"), F.when(F.col("p") % 4 > 0, "1").alias("cached"), (F.col("p") % 9 == 0).alias("unparsed"), "s")
    out = formula_stats(cells, cells.where("s % 3 = 0").select("sheet", "cell"), ["sheet"])
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return out.select("sheet", "formulas", "missing_cached", "missing_values", "unparsed", text("missing_samples"), text("unparsed_samples"))


@query("""WITH e AS (SELECT user_id % 10 AS axis, event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, bool_or(value > 490 AND event_type <> 'view') AS is_on FROM events GROUP BY ALL), live AS (SELECT axis, event_type FROM e GROUP BY ALL HAVING bool_or(is_on))
SELECT axis, day, coalesce(string_agg(e.event_type || '=' || CASE WHEN is_on THEN 1 ELSE 0 END, ',' ORDER BY e.event_type) FILTER (live.event_type IS NOT NULL), '') AS flags FROM e LEFT JOIN live USING (axis, event_type) GROUP BY axis, day""")
def flag_maps(spark, d):
    """Flags of each period by name; names that are never on are left out."""
    from gridloom.operators.facts import flag_map

    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("axis"), "event_type", F.floor(F.unix_timestamp("ts") / 86400).alias("day"), ((F.col("value") > 490) & (F.col("event_type") != "view")).alias("is_on"))
    out = flag_map(e, ["axis"], "day", "event_type", "is_on")
    entries = F.transform(F.array_sort(F.map_entries("flags")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("int").cast("string")))
    return out.select("axis", "day", F.array_join(entries, ",").alias("flags"))


@query("""WITH v AS (SELECT l_returnflag AS sheet, l_linenumber AS col, count(*) AS readers, min(l_orderkey) AS f FROM lineitem WHERE lower(l_returnflag) <> lower(l_linestatus) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY readers DESC, f, col) AS rn FROM v) SELECT sheet, col, readers FROM r WHERE rn = 1 AND readers >= 2""")
def active_value_columns(spark, d):
    from gridloom.operators.facts import active_value_column

    edges = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("source_sheet"), F.col("l_returnflag").alias("target_sheet"), F.col("l_linenumber").alias("target_col"), F.col("l_orderkey").alias("ord"))
    return active_value_column(edges, [])


@query(f"WITH r AS ({RECTS}) SELECT id, CASE WHEN r1 = 1 AND r2 = 1048576 OR (c2 - c1 + 1) * (r2 - r1 + 1) > 64 THEN 1 ELSE (c2 - c1 + 1) * (r2 - r1 + 1) END AS edges FROM r")
def expansion_estimate(spark, d):
    from gridloom.operators.facts import expansion

    return rects(spark, d).select("id", expansion().alias("edges"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS level, o_orderpriority = '1-URGENT' AS unit FROM orders)
SELECT a.o_orderkey, CASE WHEN NOT unit THEN (SELECT max(b.o_orderkey) FROM l b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.level < a.level AND NOT b.unit) END AS parent_above, CASE WHEN NOT unit THEN (SELECT min(b.o_orderkey) FROM l b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey > a.o_orderkey AND b.level < a.level AND NOT b.unit) END AS parent_below FROM l a""")
def outline_parents(spark, d):
    """The nearest order of the same customer with a smaller level, before and after."""
    from gridloom.operators.facts import outline_parent

    rows = table(spark, d, "orders").withColumn("level", F.col("o_orderkey") % 4)
    unit = F.col("o_orderpriority") == "1-URGENT"
    return rows.select("o_orderkey", *[outline_parent("level", unit, ["o_custkey"], "o_orderkey", below).alias(name) for below, name in ((False, "parent_above"), (True, "parent_below"))])


@query("""WITH k AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), s AS (SELECT o_custkey, m, m - lag(m) OVER (PARTITION BY o_custkey ORDER BY m) AS step FROM k)
SELECT o_custkey, count(step) > 0 AND count(DISTINCT step) = 1 AND coalesce(min(step) IN (1, 3, 6, 12), false) AS steady, count(*) >= 3 AND count(DISTINCT step) = 1 AS regular FROM s GROUP BY o_custkey""")
def steady_steps(spark, d):
    """Whether the order months of a customer go on by one step."""
    from gridloom.operators.facts import regular_run, steady_month_step

    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM"))).alias("k"))
    return rows.select("o_custkey", steady_month_step(F.col("k")).alias("steady"), regular_run(F.col("k")).alias("regular"))


@query("""WITH m AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, t AS members_total, least(t, 5) AS members_shown FROM m WHERE rn <= 5""")
def capped_range_members(spark, d):
    from gridloom.operators.facts import capped_members

    return capped_members(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5)


@query("""WITH a AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_custkey % 3 = 0 AS dated, c_custkey % 7 AS flags FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY dated DESC, flags DESC, c_nationkey, c_custkey) AS rn FROM a) SELECT c_mktsegment AS signature, c_custkey AS axis_id FROM r WHERE rn = 1""")
def canonical_timelines(spark, d):
    from gridloom.operators.facts import canonical_timeline

    k = F.col("c_custkey")
    axes = table(spark, d, "customer").select(F.col("c_mktsegment").alias("signature"), k.alias("axis_id"), (k % 3 == 0).alias("dated"), (k % 7).alias("flags"), F.col("c_nationkey").alias("sheet_no"), k.alias("axis_no"))
    return canonical_timeline(axes, ["signature"]).select("signature", "axis_id")


@query("""WITH a AS (SELECT n_regionkey AS sheet, n_nationkey AS axis_id, n_nationkey % 3 + 1 AS header_row, n_nationkey % 6 + 2 AS lo, n_nationkey % 6 + 2 + n_nationkey % 5 + 1 AS hi FROM nation),
p AS (SELECT sheet, arg_max(axis_id, (hi - lo) * 1000 - header_row * 100 - axis_id) AS id FROM a GROUP BY sheet), x AS (SELECT a.*, b.axis_id AS pid, b.lo AS plo, b.hi AS phi, b.header_row AS ph, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS inter FROM a JOIN p ON a.sheet = p.sheet JOIN a b ON b.axis_id = p.id)
SELECT sheet, axis_id, axis_id = pid AS "primary" FROM x WHERE axis_id = pid OR CASE WHEN hi - 1 < plo THEN hi - lo >= 3 ELSE (abs(lo - plo) <= 1 AND abs(hi - phi) <= 1) OR inter / CAST((hi - lo) + (phi - plo) - inter AS DOUBLE) >= 0.8 OR (header_row <> ph AND hi - lo >= 3) OR (inter = 0 AND (hi - lo >= 3 OR least(hi - lo, phi - plo) / CAST(greatest(hi - lo, phi - plo) AS DOUBLE) >= 0.75)) END""")
def dominant_axis(spark, d):
    """Axes that stay beside the widest one of a sheet."""
    from gridloom.operators.facts import dominant_axes

    k = F.col("n_nationkey")
    axes = table(spark, d, "nation").select(F.col("n_regionkey").alias("sheet"), k.alias("axis_id"), (k % 3 + 1).alias("header_row"), F.sequence(k % 6 + 2, k % 6 + 2 + k % 5).alias("cols"))
    return dominant_axes(axes, ["sheet"]).select("sheet", "axis_id", "primary")


@query(f"""SELECT p_partkey, '=IF(''My ' || p_size || '''!$B$' || p_size || '>0,SUM(A:C,' || {letters_sql('(p_partkey % 300 + 1)')} || p_size || ':D9),"A1")+Other!C' || p_size || '+LOG10(2)' AS formula,
'My ' || p_size || '!$B$' || p_size || ';S!A:C;S!' || {letters_sql('(p_partkey % 300 + 1)')} || p_size || ':D9;Other!C' || p_size AS targets FROM part""")
def formula_target_scan(spark, d):
    """Targets found in formulas without parsing them."""
    from gridloom.operators.facts import formula_targets

    size = F.col("p_size").cast("string")
    formula = F.concat(F.lit("=IF('My "), size, F.lit("'!$B$"), size, F.lit(">0,SUM(A:C,"), C.column_letters(F.col("p_partkey") % 300 + 1), size, F.lit(':D9),"A1")+Other!C'), size, F.lit("+LOG10(2)"))
    return table(spark, d, "part").select("p_partkey", formula.alias("formula"), F.array_join(formula_targets(formula, F.lit("S")), ";").alias("targets"))


@query("""WITH o AS (SELECT l_partkey AS range_id, l_suppkey AS reader, min(l_orderkey) AS o FROM lineitem GROUP BY ALL), n AS (SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0) SELECT range_id, string_agg(CAST(reader AS VARCHAR), ',' ORDER BY o, reader) AS readers, CAST(coalesce(min(p_size), 0) AS BIGINT) AS cells FROM o LEFT JOIN n ON p_partkey = range_id GROUP BY range_id""")
def range_readers(spark, d):
    """Each range once, with its readers in order and its present cells."""
    from gridloom.operators.facts import range_catalogue

    reads = table(spark, d, "lineitem").select(F.col("l_partkey").alias("range"), F.col("l_suppkey").alias("reader"), F.col("l_orderkey").alias("ord"))
    present = table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("range"), F.col("p_size").alias("n"))
    return range_catalogue(reads, present, []).select(F.col("range").alias("range_id"), F.array_join(F.transform("readers", lambda x: x.cast("string")), ",").alias("readers"), "cells")


@query(SHEETS + """SELECT sheet, last + 1 AS "row", 'aggregate' AS kind, CAST(1 - last AS INTEGER) AS up, CAST(-1 AS INTEGER) AS down FROM spans UNION ALL SELECT sheet, last + 2, NULL, NULL, NULL FROM spans WHERE sheet IN (SELECT sheet FROM tops WHERE col > 2)""")
def row_shape_majority(spark, d):
    """The shape of most formulas of each total and closing row."""
    from gridloom.operators.facts import row_patterns

    cells, tree = parsed(spark, d)
    rows = cells.select("book_id", "sheet", "addr", "row", "col").join(tree.select("book_id", "sheet", "addr", "formula_template"), ["book_id", "sheet", "addr"])
    return row_patterns(rows, ["sheet", "row"]).select("sheet", "row", "kind", "up", "down")


TEMPLATES = ["=R[-1]C[0]", "=R[-2]C[-1]", "=SUM(R[-3]C[0]:R[-1]C[0])", "=R[-1]C[0]-R[-2]C[0]", "=R[-1]C[0]/R[-2]C[0]", "=Other!R[2]C[0]"]


@query("""WITH r AS (SELECT DISTINCT p_size AS "row", p_size % 6 AS k FROM part), n AS (SELECT r."row", k, unnest(CASE k WHEN 0 THEN [-1] WHEN 1 THEN [-2] WHEN 2 THEN [-3, -2, -1] WHEN 3 THEN [-1, -2] WHEN 4 THEN [] ELSE [2] END) AS step FROM r)
SELECT n."row", ['alias', 'roll_forward', 'aggregate', 'difference', '', 'alias'][CAST(k + 1 AS INTEGER)] AS kind, n."row" + step AS member FROM n WHERE n."row" + step IN (SELECT "row" FROM r)""")
def row_relation_members(spark, d):
    """Alias, roll-forward, difference and aggregate relations between rows, from formula shapes."""
    from gridloom.operators.facts import row_patterns, row_relations

    rows = table(spark, d, "part").select(F.col("p_size").alias("row"), (F.col("p_partkey") % 50 + 2).alias("col")).distinct()
    cells = rows.withColumn("formula_template", F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("row") % 6).cast("int")))
    return row_relations(row_patterns(cells, ["row"]), rows.select("row").distinct(), [])


@query("""WITH s AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey - s_suppkey % 3 END AS parent, CASE WHEN s_suppkey % 2 = 0 THEN ['Top', (SELECT s_name FROM supplier p WHERE p.s_suppkey = s.s_suppkey - s.s_suppkey % 3)] ELSE ['Top'] END AS sections FROM supplier s)
SELECT s.s_suppkey, array_to_string(CASE WHEN p.s_name IS NOT NULL AND NOT list_contains(s.sections, p.s_name) THEN list_append(s.sections, p.s_name) ELSE s.sections END, '/') AS path FROM s LEFT JOIN supplier p ON p.s_suppkey = s.parent""")
def label_path(spark, d):
    """Section paths with the parent's label where it is not in them."""
    from gridloom.operators.facts import label_paths

    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    up = F.col("s_suppkey") - F.col("s_suppkey") % 3
    names = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("up_name"))
    rows = s.withColumn("k", up).join(names, "k", "left").select(F.col("s_suppkey").alias("row"), F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 3 > 0, up).alias("parent_row"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("Top"), F.col("up_name"))).otherwise(F.array(F.lit("Top"))).alias("section_path"))
    return label_paths(rows, []).select(F.col("row").alias("s_suppkey"), F.array_join("path", "/").alias("path"))


@query("""WITH h AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 3 = 0), c AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 0), k AS (SELECT * FROM h INTERSECT SELECT * FROM c), g AS (SELECT p_brand, p_size, p_size - row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i FROM k), s AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS b FROM g GROUP BY p_brand, i)
SELECT p_brand, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM s GROUP BY p_brand""")
def hidden_but_occupied(spark, d):
    """Hidden rows that hold a value, as spans."""
    from gridloom.operators.facts import hidden_occupied

    part = table(spark, d, "part")
    cells = part.select("p_brand", F.col("p_size").alias("row"), F.when(F.col("p_partkey") % 2 == 0, "1").alias("cached_value"), F.lit(None).cast("string").alias("formula_raw"))
    return hidden_occupied(part.where("p_partkey % 3 = 0").select("p_brand", F.col("p_size").alias("row")).distinct(), cells, ["p_brand"])


@query("SELECT c_nationkey, count(DISTINCT o_custkey) AS published, count(DISTINCT c_custkey) AS \"rows\", count(DISTINCT o_custkey) / CAST(count(DISTINCT c_custkey) AS DOUBLE) AS share FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey")
def content_completeness(spark, d):
    from gridloom.operators.facts import completeness

    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return completeness(c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi"), c, ["c_nationkey"], "c_custkey")


@query("SELECT s_suppkey, s_name AS label, coalesce((SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY CAST(p AS VARCHAR)) FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_suppkey = s_suppkey)), '') AS cells FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Circular ' || s_suppkey ELSE s_name END AS s_name FROM supplier) WHERE s_suppkey % 4 = 0 AND s_nationkey % 2 = 0")
def circular_row_hints(spark, d):
    """Rows that call themselves circular, in books without cycles, with their cells."""
    from gridloom.operators.facts import circularity_hints

    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("book"), F.lit("S").alias("sheet"), F.col("s_suppkey").alias("row"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Circular "), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name")).alias("label"))
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").cast("string").alias("cell"))
    cells = s.select("book", "sheet", "row").join(l, "row")
    out = circularity_hints(s, cells, s.where("book % 2 = 1").select("book"), ["book"])
    return out.select(F.col("row").alias("s_suppkey"), "label", F.array_join("cells", ",").alias("cells"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 4 < 3")
def usable_edges(spark, d):
    """Edges that walks may take."""
    k = F.col("o_orderkey")
    kinds = F.get(F.array(*map(F.lit, ["ref", "range", "cross_sheet", "external"])), (k % 4).cast("int"))
    edges = table(spark, d, "orders").select("o_orderkey", F.lit("a").alias("target"), kinds.alias("kind"), (k % 5 == 0).alias("unresolved"), (k % 7 == 0).alias("dangling"))
    return graph.usable(edges).select("o_orderkey")


@query(NEXT + ", walk AS (SELECT p AS o, p AS node, 0 AS depth FROM f UNION SELECT o, q, depth + 1 FROM walk JOIN f ON p = node WHERE depth < 3), m AS (SELECT o, node, min(depth) AS depth FROM walk GROUP BY ALL) SELECT CAST(o AS VARCHAR) AS origin, CAST(node AS VARCHAR) AS source, CAST(q AS VARCHAR) AS target, CAST(depth AS BIGINT) AS depth FROM m JOIN f ON p = node WHERE depth < 3")
def trace_edge_list(spark, d):
    """The edges of a trace of three steps from every part."""
    origins = table(spark, d, "part").select(F.lit("parts").alias("book_id"), F.col("p_partkey").cast("string").alias("origin"))
    edges = functional(spark, d)
    return graph.trace_edges(edges, graph.trace(edges, origins, "precedents", 3), "precedents", 3).select("origin", "source", "target", "depth")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (KPI), Cash Flow & 5%'), '[^0-9a-z&%]+', ' ', 'g')) AS plain, replace(trim(regexp_replace(lower(p_name || ' (KPI), Cash Flow & 5%'), '[^0-9a-z&%]+', ' ', 'g')), 'cash flow', 'cashflow') AS label FROM part")
def label_normalisation(spark, d):
    text = F.concat("p_name", F.lit(" (KPI), Cash Flow & 5%"))
    plain = F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z&%]+", " "))
    return table(spark, d, "part").select("p_partkey", plain.alias("plain"), C.normalize_label(text).alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = (SELECT min(l_linenumber) FROM lineitem k WHERE k.l_orderkey = l.l_orderkey) THEN 'first' ELSE 'later' END AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l")
def row_neighbours(spark, d):
    """Rows of an order as a chain: only the first has no precedent."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    from pyspark.sql import Window

    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    chain = rows.withColumn("before", before)
    edges = chain.select(F.col("l_orderkey").cast("string").alias("book_id"), F.col("l_linenumber").cast("string").alias("source_row"), F.coalesce("before", "l_linenumber").cast("string").alias("target_row"))
    found = graph.row_adjacency(edges).select(F.col("book_id").cast("long").alias("l_orderkey"), F.col("row_key").cast("int").alias("l_linenumber"), "precedents")
    return rows.join(found, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.when(F.size(F.coalesce("precedents", F.array())) > 0, "later").otherwise("first").alias("place"))


@query("SELECT coalesce(o_orderkey, k) AS cell, coalesce(v, b) AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS b FROM orders) FULL JOIN (SELECT l_orderkey + 5 AS k, CASE WHEN l_orderkey % 2 = 0 THEN 'x' || min(l_partkey) END AS v FROM lineitem GROUP BY l_orderkey) ON o_orderkey = k")
def cache_overlay_all(spark, d):
    """Values of all orders' lines, five keys on, over those of all orders; either side lacks some values and some rows."""
    from gridloom.operators.lookups import overlay

    key, of = F.col("o_orderkey"), F.col("l_orderkey")
    base = table(spark, d, "orders").select(key.alias("cell"), F.when(key % 3 > 0, F.col("o_custkey").cast("string")).alias("value"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("x"), F.min("l_partkey").cast("string")).alias("least"))
    return overlay(base, lines.select((of + 5).alias("cell"), F.when(of % 2 == 0, F.col("least")).alias("value")), ["cell"], "value")


@query("SELECT * FROM (SELECT 0 AS priority, CAST(n_nationkey AS BIGINT) AS ord, 'nation ' || n_nationkey AS line FROM nation UNION ALL SELECT 1, p_partkey, 'part ' || p_partkey FROM part) ORDER BY 1, 2 LIMIT 50")
def warning_lines_all(spark, d):
    """The first fifty warnings of two whole tables, a source before the next."""
    from gridloom.operators.lookups import capped_lines
    from gridloom.params import WARNINGS

    line = lambda name, key, word: table(spark, d, name).select(F.col(key).cast("long").alias("ord"), F.concat(F.lit(word), F.col(key).cast("string")).alias("line"))
    return capped_lines([line("nation", "n_nationkey", "nation "), line("part", "p_partkey", "part ")], "ord", WARNINGS)


@query("SELECT c_custkey, (SELECT arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS label FROM customer")
def precedent_labels(spark, d):
    """Every customer with the label of their first order, null where they have none."""
    from gridloom.operators.lookups import labelled

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    return labelled(table(spark, d, "customer").select("c_custkey"), rows, [], "c_custkey", "label", "o_orderkey")


@query("WITH b AS (SELECT DISTINCT p_brand, p_size, p_partkey, p_name FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS o FROM b) SELECT p_brand, p_partkey, CASE WHEN n = 1 THEN p_name END AS flag_key FROM n")
def flag_key_names(spark, d):
    """Keys of all parts as flags of their brand; shown where the name is the only one."""
    from gridloom.operators.facts import flag_key_parts

    flags = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("row"), F.col("p_name").alias("base"))
    own = F.col("before").isNull() & (F.col("tail") == "")
    return flag_key_parts(flags, ["p_brand"]).select("p_brand", F.col("row").alias("p_partkey"), F.when(own, F.col("base")).alias("flag_key"))

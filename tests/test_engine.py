"""The engine: every query against its SQL, the micro workbook end to end, the formula language, headers, streams."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_query_equals_its_sql(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    res = db.execute(own.ORACLE[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    from gridloom.plans.book import build
    from gridloom.sources.workbook import write_book

    path = tmp_path_factory.mktemp("books") / "micro.xlsx"
    cells = {"A1": ("k£", None), "B1": (2023, None), "C1": (2024, None), "A2": ("Opening cash", None), "B2": (100, None), "C2": (100, "=B2"), "A3": ("Flow", None), "B3": (10, None), "C3": (20, None), "A4": ("Total", None), "B4": (110, "=SUM(B2:B3)"), "C4": (120, "=SUM(C2:C3)")}
    path.write_bytes(write_book({"CF": cells}))
    return build(spark, str(path))


def test_micro_book(book):
    rows = {r["row"]: r for r in book.layout.collect()}
    assert {n: (r["label"], r["kind"], r["row_key"]) for n, r in rows.items()} == {2: ("Opening cash", "fact", "CF|2|CF!r1"), 3: ("Flow", "fact", "CF|3|CF!r1"), 4: ("Total", "fact", "CF|4|CF!r1")}
    assert [(r["col"], r["period_id"]) for r in book.periods.orderBy("col").collect()] == [(2, "2023"), (3, "2024")]
    assert {r["addr"]: r["formula_template"] for r in book.parsed.collect()} == {"C2": "=R[0]C[-1]", "B4": "=SUM(R[-2]C[0]:R[-1]C[0])", "C4": "=SUM(R[-2]C[0]:R[-1]C[0])"}
    edges = {(r["source"], r["target"]): (r["kind"], r["period_lag"]) for r in book.enriched.collect()}
    assert edges == {("CF!C2", "CF!B2"): ("ref", "-1"), ("CF!B4", "CF!B2"): ("range", "same"), ("CF!B4", "CF!B3"): ("range", "same"), ("CF!C4", "CF!C2"): ("range", "same"), ("CF!C4", "CF!C3"): ("range", "same")}
    links = {r["cell"]: (r["formula_class"], r["refs"]) for r in book.links.collect()}
    assert links == {"CF!C2": ("rollforward", ["CF!B2"]), "CF!B4": ("aggregation", ["CF!B2:B3"]), "CF!C4": ("aggregation", ["CF!C2:C3"])}
    assert {r["node_type"]: r["count"] for r in book.index.groupBy("node_type").count().collect()} == {"calculated": 3, "input": 9}
    assert book.cycles.count() == 0
    assert {(r["addr"], r["normalized"], r["status"]) for r in book.series.where("row = 3").collect()} == {("B3", "10000", "cached"), ("C3", "20000", "cached")}
    trace = {r["node"]: r["depth"] for r in book.trace("CF!C4").collect()}
    assert trace == {"CF!C4": 0, "CF!C2": 1, "CF!C3": 1, "CF!B2": 2}
    seen = book.observations(q=" FLOW ", period_ids=["2024"]).collect()
    assert [(r["cached_value"], r["normalized"], r["cell"], r["formula"]) for r in seen] == [("20", "20000", "CF!C3", None)]
    assert book.catalog().count() == 3
    with pytest.raises(ValueError, match="selector_required"):
        book.observations()


@pytest.mark.parametrize("direction", ["precedents", "dependents"])
def test_traces_of_all_parts_equal_a_plain_search(spark, db, direction):
    keys = [k for (k,) in db.execute("SELECT p_partkey FROM part").fetchall()]
    nexts = {}
    for k in keys:
        a, b = (k, (k * k + 3) % len(keys)) if direction == "precedents" else ((k * k + 3) % len(keys), k)
        nexts.setdefault(a, set()).add(b)
    want = set()
    for k in keys:
        seen, edge = {k}, {k}
        for depth in range(9):
            want |= {(str(k), str(n), depth) for n in edge}
            edge = {t for n in edge for t in nexts.get(n, ())} - seen
            seen |= edge
    got = own.QUERIES[f"trace_{direction}_all"](spark, SF).collect()
    assert len(got) == len(want) and {(r["origin"], r["node"], r["depth"]) for r in got} == want


def test_labelled_trace(book):
    got = {r["node"]: (r["row_key"], r["period_id"], r["label"]) for r in book.labelled_trace("CF!C4").collect()}
    assert got["CF!C2"] == ("CF|2|CF!r1", "2024", "Opening cash")
    assert got["CF!C3"] == ("CF|3|CF!r1", "2024", "Flow")
    assert set(got) == {r["node"] for r in book.trace("CF!C4").collect()}


def test_trace_passes_through_large_ranges(spark, tmp_path):
    from gridloom.plans.book import build
    from gridloom.sources.workbook import write_book

    cells = {"A1": ("Item", None), "B1": (2023, None), "D1": (0, "=SUM(B2:B101)"), "E1": (0, "=SUM(B:B)"), "F1": (0, "=D1+1")}
    cells |= {f"A{r}": (f"Line {r}", None) for r in range(2, 102)}
    cells |= {f"B{r}": (r, "=C2" if r == 90 else None) for r in range(2, 102) if r != 50} | {"C2": (7, None)}
    (tmp_path / "long.xlsx").write_bytes(write_book({"S": cells}))
    book = build(spark, str(tmp_path / "long.xlsx"))
    at = lambda *a, **k: {r["node"]: r["depth"] for r in book.trace(*a, **k).collect()}
    filled = {f"S!B{r}": 1 for r in range(2, 102) if r != 50}
    assert at("S!D1") == {"S!D1": 0, **filled, "S!C2": 2}
    assert at("S!E1") == {"S!E1": 0, "S!B1": 1, **filled, "S!C2": 2}
    assert at("S!D1", range_members=3) == {"S!D1": 0, "S!B2": 1, "S!B3": 1, "S!B4": 1}
    readers = {"S!D1": 1, "S!E1": 1, "S!F1": 2}
    assert at("S!B77", "dependents") == {"S!B77": 0, **readers}
    assert at("S!C2", "dependents") == {"S!C2": 0, "S!B90": 1, "S!D1": 2, "S!E1": 2, "S!F1": 3}
    assert at("S!B50", "dependents") == {"S!B50": 0, "S!D1": 1, "S!F1": 2}
    assert at("S!Z9", "dependents") == {}
    by_label = book.trace("line 77", "dependents").where("depth > 0")
    assert {r["node"]: r["depth"] for r in by_label.collect()} == readers


def test_books_keep_apart_and_ghosts_dangle(spark, tmp_path):
    """Two workbooks with equal sheet names; sheets in document order; unknown sheets, names and gaps."""
    from gridloom.plans.book import build
    from gridloom.sources.workbook import write_book

    head = {"A1": ("k£", None), "B1": (2023, None), "C1": (2024, None)}
    for name, v in (("one", 1), ("two", 7)):
        sheet = head | {"A2": ("Sales", None), "B2": (v, None), "C2": (v + 1, None), "A3": ("Sales cost", None), "B3": (3, "=SUM(Ghost!A1:Z99)"), "A4": ("Link", None), "B4": (v, "=Rate"), "C4": (v, "=B2")}
        (tmp_path / f"{name}.xlsx").write_bytes(write_book({"Z": sheet, "A": head | {"A2": ("Sales", None), "B2": (5, None), "C2": (6, None)}}, {"Rate": "A!$B$2"}))
    book = build(spark, str(tmp_path / "*.xlsx"))
    got = book.observations(q="sales").collect()
    assert len(got) == 12 and len({r["book_id"] for r in got}) == 2
    for b in {r["book_id"] for r in got}:
        own = [r for r in got if r["book_id"] == b]
        assert {r["cached_value"] for r in own if r["sheet"] == "Z" and r["label"] == "Sales"} in ({"1", "2"}, {"7", "8"})
        assert [r["status"] for r in own if r["cell"] == "Z!C3"] == ["empty"]
    first = book.observations(q="sales", limit=1).collect()
    assert [(r["sheet"], r["truncated"]) for r in first] == [("Z", True)] * 2
    assert [r["sheet"] for r in book.catalog(q="sales").orderBy("row").collect()].count("Z") == 4
    edges = book.cell_edges.where("source = 'Z!B3'").collect()
    assert len(edges) == 2 * 2000 and {(r["status"], r["reason"], r["dangling"]) for r in edges} == {("missing", "missing_sheet", True)}
    named = book.cell_edges.where("source = 'Z!B4'").collect()
    assert {(r["kind"], r["target"], r["status"], r["unresolved"]) for r in named} == {("cross_sheet", "A!B2", "cell", False)}
    assert book.trace("Z!B3").count() == 2


def test_trace_edges_and_documents(spark, book, tmp_path):
    import json

    from gridloom.plans.book import graph_markdown, trace_markdown
    from gridloom.sources.sinks import read_document, session_jobs, write_lines

    edges = {(r["source"], r["target"]) for r in book.trace_edges("CF!C4").collect()}
    assert edges == {("CF!C4", "CF!C2:C3"), ("CF!C2", "CF!B2")}
    write_lines(str(tmp_path / "graph.md"), graph_markdown(book))
    text = (tmp_path / "graph.md").read_text()
    assert "range" in text and "rollforward" in text
    assert any("CF!C2:C3" in line for line in trace_markdown(book, "CF!C4"))
    for i, status in enumerate(["done", "failed", "done"]):
        folder = tmp_path / "sessions" / "s" / "jobs" / str(i) / "meta"
        folder.mkdir(parents=True)
        (folder / "meta.json").write_text(json.dumps({"job_id": f"j{i}", "filename": f"Book{i}.xlsx", "status": status}))
    (tmp_path / "sessions" / "s" / "jobs" / "0" / "meta" / "other.json").write_text("{}")
    assert [r["job_id"] for r in session_jobs(spark, str(tmp_path / "sessions"), "done", " BOOK").collect()] == ["j0", "j2"]
    (tmp_path / "doc.json").write_text(json.dumps({"a": 1, "blocks": [{"x": 2}]}))
    assert read_document(spark, str(tmp_path / "doc.json"), "a int, blocks array<struct<x:int>>", ("blocks",)).first().asDict() == {"a": 1}


def test_markdown(book):
    from gridloom.plans.book import context_markdown

    assert context_markdown(book.series).splitlines()[2:5] == ["| row | label | 2023 | 2024 |", "| --- | --- | --- | --- |", "| 2 | Opening cash | 100 | 100 |"]


def test_zip_guard():
    import io
    import zipfile

    from gridloom.sources.workbook import Book, BookError

    for name, data, code in (("../x.xml", b"a", "zip_path"), ("xl/media/a.bin", b"0" * 10_000_000, "zip_ratio"), ("a.txt", b"a", "not_a_workbook")):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)
        with pytest.raises(BookError) as e:
            Book(out.getvalue())
        assert e.value.code == code


@pytest.mark.parametrize(
    "formula, template, edges",
    [
        ("=-B2^2", "=-R[-2]C[-1]^2", [("ref", "CF!B2")]),
        ("=(2^3)^2", "=(2^3)^2", []),
        ("=2^3^2", "=2^3^2", []),
        ("=1-(2-3)", "=1-(2-3)", []),
        ("=$A$1+A$2+$A3", "=R1C1+R2C[-2]+R[-1]C1", [("ref", "CF!A1"), ("ref", "CF!A2"), ("ref", "CF!A3")]),
        ("='My Sheet'!A1", "='My Sheet'!R[-3]C[-2]", [("cross_sheet", "My Sheet!A1")]),
        ("=INDIRECT(A1)+B:B", "=INDIRECT(R[-3]C[-2])+C[-1]:C[-1]", [("dynamic", None), ("range", "CF!B:B")]),
        ("=_xlfn.XLOOKUP(1,{1,2;3,4},Rate)", "=XLOOKUP(1,{1,2;3,4},Rate)", [("ref", "Rate")]),
        ("=A1+", None, []),
        ("={1,2;3}", None, []),
    ],
)
def test_formulas(formula, template, edges):
    from gridloom.operators.formula import parse

    got = parse(formula, "CF", "C4")
    assert got.template == template and got.unparsed == (template is None)
    assert [(e["kind"], e["target"]) for e in got.edges] == edges


def test_shift_keeps_anchors():
    from gridloom.operators.formula import shift

    assert shift("=SUM($A1:B$2)+Other!C3", 1, 2) == "=SUM($A3:C$2)+Other!D5"
    assert shift("=B2", -5, -5) == "=A1"


def test_formula_table_function(spark):
    from gridloom.operators.formula import register

    register(spark)
    got = spark.sql("SELECT kind, target FROM VALUES ('S', 'A1', '=B1+C1:C3') v(s, a, f), LATERAL formula_edges(s, a, f)").collect()
    assert sorted(map(tuple, got)) == [("range", "S!C1:C3"), ("ref", "S!B1")]


@pytest.mark.parametrize("text, key", [("2025-01-31", "2025-01-31"), ("01.01.2026", "2026-01-01"), ("2025-01", "2025-01"), ("01.2025", "2025-01"), ("янв.25", "2025-01"), ("May 2025", "2025-05"), ("Q1 2025", "2025Q1"), ("1Q25", "2025Q1"), ("1 кв. 2025", "2025Q1"), ("I кв. 2025", "2025Q1"), ("2025 Q1", "2025Q1"), ("2025-H1", "2025H1"), ("2H25", "2025H2"), ("1 полугодие 2025", "2025H1"), ("FY25", "2025"), ("2025E", "2025"), ("2025 год", "2025"), ("31.02.2025", None), ("revenue 2025 and 2024", None), (None, None)])
def test_headers(text, key):
    from gridloom.functions.headers import classify_header

    got = classify_header(text)
    assert (got and got[1]) == key


def test_serial_dates(spark):
    from gridloom.functions.cells import is_date_format, serial_to_date

    rows = spark.createDataFrame([(1.0,), (59.0,), (60.0,), (61.0,), (45292.0,), (0.0,), (3e6,)], "s double")
    assert [str(r[0]) for r in rows.select(serial_to_date(F.col("s"))).collect()] == ["1900-01-01", "1900-02-28", "None", "1900-03-01", "2024-01-01", "None", "None"]
    formats = spark.createDataFrame([("dd/mm/yy",), ("0.00",), ("h:mm",), ('"day"0',), ("[$-409]mmm",), ("General",)], "f string")
    assert [r[0] for r in formats.select(is_date_format(F.col("f"))).collect()] == [True, False, False, False, True, False]


def test_cover_equals_brute_force(spark):
    from gridloom.operators.ranges import cover

    rng = random.Random(1)
    rects = [(i, "S", c, c + rng.randint(0, 5), r, r + rng.choice([0, 3, 5000, 900_000])) for i in range(60) for c, r in [(rng.randint(1, 40), rng.randint(1, 9000))]]
    cells = [(rng.randint(1, 50), rng.randint(1, 12_000), "S") for _ in range(300)]
    got = cover(spark.createDataFrame(cells, "col long, row long, sheet string"), spark.createDataFrame(rects, "id long, sheet string, c1 long, c2 long, r1 long, r2 long"), ["sheet"])
    want = sorted((i, c, r) for i, _, c1, c2, r1, r2 in rects for c, r, _ in cells if c1 <= c <= c2 and r1 <= r <= r2)
    assert sorted((x["id"], x["col"], x["row"]) for x in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_cycles_and_their_class(spark):
    from gridloom.plans.graph import cycles

    edges = spark.createDataFrame([("b", "1", "2", "-1"), ("b", "2", "1", "-1"), ("b", "3", "3", "same"), ("b", "4", "1", None), ("c", "1", "2", "same"), ("c", "2", "1", "-1")], "book_id string, source string, target string, period_lag string")
    got = {(r["book_id"], r["cycle"]): (r["members"], r["class"]) for r in cycles(edges).collect()}
    assert got == {("b", "c1"): (["1", "2"], "iterative_ok"), ("b", "c2"): (["3"], "unexpected"), ("c", "c1"): (["1", "2"], "unexpected")}


def test_flag_keys(spark):
    from gridloom.operators.facts import flag_keys

    bases = ["on", "case a", "on", "on", "case b", "on", None, ""]
    rows = [("x", r, b) for r, b in enumerate(bases, 5)] + [("y", 5, "on"), ("y", 6, "on")]
    got = flag_keys(spark.createDataFrame(rows, "axis string, row long, base string"), ["axis"]).orderBy("axis", "row").collect()
    own = ["on 5", "case a", "on (case a)", "on (case a) 8", "case b", "on (case b)", "row 11", "row 12"]
    assert [r["flag_key"] for r in got] == own + ["on 5", "on 6"]


def test_range_hops_equal_brute_force(spark):
    from gridloom.plans.graph import range_hops

    rnd = random.Random(5)
    cells = [("b", f"S!n{r}.{c}", "S", r, c) for r, c in {(rnd.choice([1, 2, 3, 64, 65, 127, 128, 1048576, rnd.randint(1, 300)]), rnd.randint(1, 4)) for _ in range(120)}]
    rects = [("b", "S!r0", "S", 1, 16384, 1, 1048576), ("b", "S!r1", "S", 2, 2, 64, 127), ("b", "S!r2", "S", 1, 3, 1, 1), ("b", "T!r3", "T", 1, 4, 1, 300)]
    for k in range(20):
        c, r = sorted(rnd.choices(range(1, 6), k=2)), sorted(rnd.choices(range(1, 320), k=2))
        rects.append(("b", f"S!x{k}", "S", *c, *r))
    edges = range_hops(spark.createDataFrame(rects, "book_id string, range string, sheet string, c1 long, c2 long, r1 long, r2 long"), spark.createDataFrame(cells, "book_id string, node string, sheet string, row long, col long"))
    nexts: dict = {}
    for e in edges.collect():
        nexts.setdefault(e["source"], []).append(e["target"])
    for _, name, sheet, c1, c2, r1, r2 in rects:
        got = sorted(n for b in nexts.get(name, []) for n in nexts.get(b, []))
        assert got == sorted(n for _, n, s, r, c in cells if s == sheet and r1 <= r <= r2 and c1 <= c <= c2)


def test_cycles_through_large_ranges(spark, tmp_path):
    from gridloom.plans.book import build
    from gridloom.sources.workbook import write_book

    cells = {"A1": ("Item", None), "B1": (2023, None), "C1": (2024, None)}
    cells |= {f"A{r}": (f"Line {r}", None) for r in range(2, 90)}
    cells |= {f"B{r}": (r, None) for r in range(2, 90)} | {f"C{r}": (r, None) for r in range(2, 90)}
    cells |= {"A92": ("Loop", None), "C92": (0, "=SUM(C2:C91)"), "C40": (0, "=C92")}  # over a range of the same period
    cells |= {"E5": (0, "=SUM(E1:E100)"), "G1": (0, "=SUM(B2:B89)")}  # a loop by itself; a range without formulas
    (tmp_path / "loop.xlsx").write_bytes(write_book({"S": cells}))
    got = {tuple(r["members"]): r["class"] for r in build(spark, str(tmp_path / "loop.xlsx")).cycles.collect()}
    assert got == {("S!C40", "S!C92"): "unexpected", ("S!E5",): "unexpected"}


def test_class_of_cycles_through_ranges(spark):
    from gridloom.plans.graph import cycles

    edges = [("b", "S!B1", "S!A1:A90", None), ("b", "S!A7", "S!B1", "-1"), ("b", "S!D1", "S!C1:C90", None), ("b", "S!C7", "S!D1", "-1"), ("b", "S!C9", "S!D1", "-1")]
    ranges = [("b", "S!A1:A90", "S", 1, 1, 1, 90), ("b", "S!C1:C90", "S", 3, 3, 1, 90)]
    periods = [("b", "S!B1", "2024"), ("b", "S!A7", "2023"), ("b", "S!D1", "2024"), ("b", "S!C7", "2023"), ("b", "S!C9", "2024")]
    out = cycles(
        spark.createDataFrame(edges, "book_id string, source string, target string, period_lag string"),
        spark.createDataFrame(ranges, "book_id string, range string, sheet string, c1 long, c2 long, r1 long, r2 long"),
        spark.createDataFrame(periods, "book_id string, node_id string, period_id string"),
    )
    assert {tuple(r["members"]): r["class"] for r in out.collect()} == {("S!A7", "S!B1"): "iterative_ok", ("S!C7", "S!C9", "S!D1"): "unexpected"}


def test_job_stream(spark, tmp_path):
    from gridloom.streaming.progress import EVENT, job_states

    rows = [("j", 1, 1, "queued", None, "2026-01-01 00:00:00"), ("j", 2, 2, "running", "parse", "2026-01-01 00:00:01"), ("j", 3, 1, "running", "old", "2026-01-01 00:00:02"), ("j", 4, 1, "failed", None, "2026-01-01 00:00:03"), ("j", 5, 2, "succeeded", None, "2026-01-01 00:00:04"), ("j", 6, 2, "failed", None, "2026-01-01 00:00:05")]
    data = spark.createDataFrame(rows, "job_id string, event_id long, generation long, status string, stage string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = job_states(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["event_id"]: r["accepted"] for r in spark.table("decisions").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_sinks(spark, tmp_path):
    from gridloom.sources import sinks

    df = spark.createDataFrame([(1, None), (2, "b")], "id long, t string")
    assert sorted(sinks.json_lines(df)) == ['{"id":1}', '{"id":2,"t":"b"}']
    sinks.write_table(df, str(tmp_path / "local"), rows_per_file=1)
    sinks.export({"rows": df.where("id = 2")}, str(tmp_path / "out"), "e1")
    assert sinks.read_published(spark, str(tmp_path / "out"), "rows", str(tmp_path / "local")).count() == 1
    assert sinks.read_published(spark, str(tmp_path / "out"), "other", str(tmp_path / "local")).count() == 2
    assert sinks.read_published(spark, str(tmp_path / "none"), "rows", str(tmp_path / "local")).count() == 2
    sinks.write_bytes(str(tmp_path / "a.json"), b"{}")
    assert (tmp_path / "a.json").read_bytes() == b"{}"
    good = {s: sinks.fingerprint("v1", {"stage": s}) for s in sinks.STAGES}
    assert sinks.stale_from(good, good) is None
    assert sinks.stale_from(good, good | {"graph": "x"}) == "graph"
    assert sinks.etag("v1", "a") != sinks.etag("v2", "a")


def test_windows_and_dedup_on_a_stream(spark, tmp_path):
    from gridloom.streaming.progress import queued_once, windowed

    rows = [("s", "j", "queued", "2026-01-01 00:00:00"), ("s", "j", "queued", "2026-01-01 00:01:00"), ("s", "k", "queued", "2026-01-01 00:06:00"), ("t", "j", "failed", "2026-01-01 00:07:00")]
    data = spark.createDataFrame(rows, "session_id string, job_id string, status string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for name, stream, mode, want in (("once", queued_once(read()), "append", 3), ("windows", windowed(read()), "complete", 3)):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert spark.table(name).count() == want
    assert windowed(data).count() == 3


def test_shared_formulas_and_presence(spark, tmp_path):
    import io
    import zipfile

    from gridloom.sources.workbook import presence_runs, read_cells, read_workbooks, write_book

    raw = io.BytesIO(write_book({"S": {"A1": (1, None)}}, {"Rate": "S!$A$1"}, iterate=True))
    out = tmp_path / "shared.xlsx"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{main}"><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><f t="shared" si="0" ref="B1:B3">A1*$A$1</f><v>1</v></c><c r="C1"/></row><row r="2" hidden="1"><c r="B2"><f t="shared" si="0"/><v>2</v></c><c r="C2"/></row><row r="3"><c r="B3"><f t="shared" si="0"/><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(raw) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(n, sheet if n.endswith("sheet1.xml") else a.read(n))
    cells = read_cells(spark, str(out))
    got = {r["addr"]: (r["formula_raw"], r["cached_value"], r["hidden"]) for r in cells.collect()}
    assert got["B2"] == ("=A2*$A$1", "2", True) and got["B3"] == ("=A3*$A$1", "3", False) and got["C1"] == (None, None, True)
    runs = {(r["col"], r["presence"], r["row_start"], r["row_end"]) for r in presence_runs(cells).collect()}
    assert (3, "styled_blank", 1, 2) in runs and (2, "populated", 2, 2) in runs
    facts = read_workbooks(spark, str(out)).first()
    assert facts["iterate"] and facts["defined_names"][0]["name"] == "Rate"

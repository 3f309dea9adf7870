"""One workbook with stacked headers, a vertical table, its horizontal twin and a parameter sheet, from file to observations."""

import pytest

STACK = {"B1": ("2024", None), "B2": ("Q1", None), "C2": ("Q2", None), "D2": ("Q3", None), "A3": ("Sales", None), "B3": (11, None), "C3": (12, None), "D3": (13, "=C3+B3")}
PARAMS = {"B1": ("Base", None), "C1": ("High", None), "A2": ("Rate", None), "B2": (0.1, None), "C2": (0.2, None), "A3": ("Growth", None), "B3": (5, "=C2*25"), "A4": ("Days", None), "B4": (30, "=B3*6")}
DOWN = {"B1": ("Price", None), "C1": ("Volume", None)} | {f"A{i + 2}": (2020 + i, None) for i in range(3)} | {f"B{i + 2}": (i + 7, None) for i in range(3)} | {f"C{i + 2}": (i + 4, None) for i in range(3)}
ACROSS = {"A2": ("Price", None), "A3": ("Volume", None)} | {f"{c}1": (2020 + i, None) for i, c in enumerate("BCD")} | {f"{c}2": (i + 7, None) for i, c in enumerate("BCD")} | {f"{c}3": (i + 4, None) for i, c in enumerate("BCD")}
BESIDE = {f"{c}1": (y, None) for c, y in zip("BCDGHI", (2020, 2021, 2022, 2030, 2031, 2032))} | {"A2": ("one", None), "B2": (3, None), "C2": (4, None), "D2": (4, None), "F3": ("two", None), "G3": (5, None), "H3": (6, None), "I3": (8, None)}


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    from gridloom.plans.book import build
    from gridloom.sources.workbook import write_book

    path = tmp_path_factory.mktemp("layouts") / "book.xlsx"
    path.write_bytes(write_book({"Stack": STACK, "Par": PARAMS, "Down": DOWN, "Across": ACROSS, "Beside": BESIDE}))
    return build(spark, str(path))


@pytest.fixture(scope="module")
def facts(book):
    out = {}
    for r in book.series.where("cached_value is not null").collect():
        out.setdefault(r["sheet"], {})[(r["label"], r["period_id"])] = r
    return out


def test_two_header_rows_make_quarters(facts):
    assert {k: r["normalized"] for k, r in facts["Stack"].items()} == {("Sales", "2024Q1"): "11", ("Sales", "2024Q2"): "12", ("Sales", "2024Q3"): "13"}


def test_a_vertical_table_gives_the_facts_of_its_twin(facts):
    assert {k: r["normalized"] for k, r in facts["Down"].items()} == {k: r["normalized"] for k, r in facts["Across"].items()}
    assert facts["Down"][("Volume", "2021")]["row_key"] == "Down|1|c3|Down!c1r2" and facts["Down"][("Volume", "2021")]["cell"] == "Down!C3"


def test_tables_side_by_side_keep_their_rows(facts):
    assert {k: r["cached_value"] for k, r in facts["Beside"].items()} == {("one", "2020"): "3", ("one", "2021"): "4", ("one", "2022"): "4", ("two", "2030"): "5", ("two", "2031"): "6", ("two", "2032"): "8"}


def test_parameters_are_observations(book, facts):
    assert {k: (r["scenario"], r["cell"]) for k, r in facts["Par"].items()} == {("Rate", "Base"): ("Base", "Par!B2"), ("Rate", "High"): ("High", "Par!C2"), ("Growth", "Base"): ("Base", "Par!B3"), ("Days", "Base"): ("Base", "Par!B4")}
    got = book.observations(q="days", precedent_depth=3).collect()
    assert [(r["formula"], r["precedents_total"], [(n["node"], n["label"]) for n in r["precedents"]]) for r in got] == [("=B3*6", 2, [("Par!B3", "Growth"), ("Par!C2", "Rate")])]
    assert [r["precedents_total"] for r in book.observations(q="sales", period_ids=["2024Q1", "2024Q3"], precedent_depth=1).orderBy("period_id").collect()] == [0, 2]


def test_cells_of_vertical_tables_know_their_line(book):
    got = {r["node_id"]: (r["row_key"], r["period_id"]) for r in book.index.where("node_id like 'Down!%'").collect()}
    assert got["Down!B3"] == ("Down|1|c2|Down!c1r2", "2021") and got["Down!C4"] == ("Down|1|c3|Down!c1r2", "2022")


def test_why_traces_stop(book):
    at = lambda *a: [(r["nodes"], r["deepest"], r["stop"]) for r in book.trace_stops(*a).collect()]
    assert at("Stack!D3") == [(3, 1, "complete")] and at("Stack!B3") == [(1, 0, "leaf")]
    assert at("Par!B4", "precedents", 1) == [(2, 1, "depth")] and at("Par!B4", "precedents", 2) == [(3, 2, "complete")]
    assert at("Par!B3", "dependents") == [(2, 1, "complete")]


def test_cells_out_of_order_and_dangling_targets(spark):
    from gridloom.plans.graph import dangling_ids
    from gridloom.sources.workbook import order_warnings

    cells = spark.createDataFrame([("b", "S", 0, 1, 1, "A1"), ("b", "S", 1, 3, 1, "A3"), ("b", "S", 2, 2, 1, "A2"), ("b", "T", 3, 1, 1, "A1")], "book_id string, sheet string, ordinal long, row long, col long, addr string")
    assert [(r["sheet"], r["n"], r["samples"]) for r in order_warnings(cells).collect()] == [("S", 1, ["A2"])]
    edges = spark.createDataFrame([("b", f"X!A{i % 40}", "missing_sheet", True, i) for i in range(80)] + [("b", "S!A1", None, False, 99)], "book_id string, target string, reason string, dangling boolean, ord long")
    got = dangling_ids(edges).collect()
    assert len(got) == 1 and got[0]["reason"] == "missing_sheet" and 40 in got[0].asDict().values()

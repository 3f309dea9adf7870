"""Period axes: bands, composed keys, runs, markers, relative and vertical axes, bodies."""

import pytest
from gridloom.functions.headers import header_atom, with_atoms
from gridloom.operators import axes as A
from gridloom.session import checkpointed


def cells_of(spark, sheets):
    """Cells of sheets, each a list of rows of values; text starting with = is a formula's template."""
    out = []
    for name, rows in sheets.items():
        for r, values in enumerate(rows, 1):
            for c, v in enumerate(values, 1):
                if v is not None:
                    formula = v if isinstance(v, str) and v.startswith("=") else None
                    shown = "1" if formula else str(v)
                    number = 1.0 if formula else float(v) if isinstance(v, (int, float)) or v.isdigit() else None
                    out.append(("b", name, r, c, shown, number, formula, formula))
    cells = spark.createDataFrame(out, "book_id string, sheet string, row long, col long, shown string, number double, formula_template string, formula_raw string")
    return checkpointed(with_atoms(cells, "shown"))


QUARTERS = [None, "Q1 2024", "Q2 2024", "Total", "Q3 2024", "Q4 2024", None, "Q1 2025"]
CONFLICT = [[None, "Plan", None, "Actual"], [None, "2024 план", "2024 факт", "2024 план", "2024 факт"]]
SHEETS = {
    "years over quarters": [[None, 2024, None, None, None, 2025], [None, "Q1", "Q2", "Q3", "Q4", "Q1", "Q2"], ["Sales", 1, 2, 3, 4, 5, 6]],
    "one year over quarters": [["Model"], [None, "2024"], [None, "Q1", "Q2", "Q3"], ["Sales", 1, 2, 3]],
    "years over months": [[None, "2024", "2024", "2025"], [None, "January", "February", "January"], ["Sales", 1, 2, 3]],
    "bounds": [["Period start", "01.01.2024", "01.02.2024", "01.03.2024"], ["Period end", "31.01.2024", "29.02.2024", "31.03.2024"], ["Month", 1, 2, 3], ["Sales", 1, 2, 3]],
    "two rulers": [[None, 2020, 2021, 2022, 2023], [None, "Q1", "Q2", "Q3", "Q4"], ["Sales", 1, 2, 3, 4]],
    "two years in a column": [[None, "FY2024", "FY2025"], [None, "Q1 2024", "Q2 2024"], ["x", 1, 2]],
    "runs": [[None, 2020, 2021, 2022, 2020, 2021, 2022, None, 2030, 2031, None, "01.01.2024", "01.02.2024"], ["x", *range(1, 13)]],
    "total between": [QUARTERS, ["x", 1, 2, 3, 4, 5, 6, 7]],
    "hidden between": [QUARTERS, ["x", 1, 2, 3, 4, 5, 6, 7]],
    "tails": [[None, "2024 факт", "2024 план", "2025 факт", "2025 план"], ["x", 1, 2, 3, 4]],
    "banner": [[None, "Actual", None, "Forecast"], [None, 2024, 2025, 2024, 2025], ["x", 1, 2, 3, 4]],
    "same tail": [[None, "2024 факт", "2025 факт"], ["x", 1, 2]],
    "conflict": [*CONFLICT, ["x", 5, 6, 7, 8]],
    "conflict and flag": [*CONFLICT, ["on", 0, 0, 1, 1]],
    "labelled count": [["Year", 1, 2, 3, 4], ["Sales", 5, 6, 7, 8]],
    "count over formulas": [[None, *range(1, 9)], ["Sales", *["=RC[-1]*2"] * 8], ["Other", *range(10, 18)]],
    "count over values": [[None, *range(1, 9)], ["Other", *range(10, 18)]],
    "down": [[None, "Price", "Volume"], [2020, 1, 4], [2021, 2, 5], [2022, 3, 6]],
    "journal": [[None, "Paid"], ["05.01.2024", 1], ["06.01.2024", 2], ["07.01.2024", 3]],
    "groups": [[None, 2024, 2024, 2024, 2024], ["note", 7], [None, "Jan 2024", "Feb 2024", "Mar 2024", "Apr 2024"], ["x", 1, 2, 3, 4]],
    "prose": [["Revenue in 2024"], ["a", 5], ["b", 2020, "x"]],
}


@pytest.fixture(scope="module")
def cells(spark):
    return cells_of(spark, SHEETS)


@pytest.fixture(scope="module")
def found(spark, cells):
    """The periods of every sheet's axes, from one run over all sheets."""
    shut = spark.createDataFrame([("b", "hidden between", 7)], "book_id string, sheet string, col long")
    out = {name: [] for name in SHEETS}
    for r in sorted(A.candidates(cells, shut).collect(), key=lambda r: (r["axis_id"], r["col"])):
        out[r["sheet"]].append(r)
    return out


def keys(rows):
    out = {}
    for r in rows:
        out.setdefault(r["axis_id"].rpartition("!")[2], []).append(r["key"])
    return out


@pytest.mark.parametrize(
    "text, want",
    [
        ("Q1", ("quarter", 1)), ("4Q", ("quarter", 4)), ("I кв.", ("quarter", 1)), ("2 квартал", ("quarter", 2)), ("3rd quarter", ("quarter", 3)),
        ("H2", ("half", 2)), ("II полугодие", ("half", 2)), ("March", ("month", 3)), ("янв.", ("month", 1)), ("сентябрь", ("month", 9)), ("marketing", None), ("Total", ("total", None)),
        ("2024", ("full", "2024")), ("2024 план", ("full", "2024")), ("план", ("marker", None)), ("Revenue", None), (None, None), ("x" * 80, None), ("Plan Q2", ("quarter", 2)), ("31.12.2024", ("full", "2024-12-31")),
    ],
)
def test_atoms(text, want):
    got = header_atom(text)
    assert (got and (got["kind"], got["key"] if got["kind"] == "full" else got.get(got["kind"]))) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("years over quarters", {"r2": ["2024Q1", "2024Q2", "2024Q3", "2024Q4", "2025Q1", "2025Q2"]}),
        ("one year over quarters", {"r3": ["2024Q1", "2024Q2", "2024Q3"]}),
        ("years over months", {"r2": ["2024-01", "2024-02", "2025-01"]}),
        ("bounds", {"r3": ["2024-01", "2024-02", "2024-03"]}),
        ("two rulers", {"r1": ["2020", "2021", "2022", "2023"]}),
        ("two years in a column", {}),
        ("runs", {"r1c2": ["2020", "2021", "2022"], "r1c5": ["2020", "2021", "2022"]}),
        ("total between", {"r1": ["2024Q1", "2024Q2", "2024Q3", "2024Q4"]}),
        ("hidden between", {"r1": ["2024Q1", "2024Q2", "2024Q3", "2024Q4", "2025Q1"]}),
        ("tails", {"r1": ["2024@факт", "2024@план", "2025@факт", "2025@план"]}),
        ("banner", {"r2": ["2024@actual", "2025@actual", "2024@forecast", "2025@forecast"]}),
        ("same tail", {"r1": ["2024", "2025"]}),
        ("conflict", {"r2": ["2024"] * 4}),
        ("conflict and flag", {"r2": ["2024@plan", "2024@plan", "2024@actual", "2024@actual"]}),
        ("labelled count", {"r1": ["Y1", "Y2", "Y3", "Y4"]}),
        ("count over formulas", {"r1": [f"P{i}" for i in range(1, 9)]}),
        ("count over values", {}),
        ("down", {"c1r2": ["2020", "2021", "2022"]}),
        ("journal", {}),
        ("groups", {"r3": ["2024-01", "2024-02", "2024-03", "2024-04"]}),
        ("prose", {}),
    ],
)
def test_axes(found, name, want):
    assert keys(found[name]) == want


def test_what_axes_say_beside_keys(found):
    assert [(r["start_date"], r["end_date"]) for r in found["bounds"]] == [("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-31")]
    assert all(r["ambiguous"] for r in found["conflict"]) and not any(r["ambiguous"] for r in found["conflict and flag"])
    assert {r["group_key"] for r in found["groups"]} == {"2024"} and {r["grain"] for r in found["years over quarters"]} == {"quarter"}
    assert [(r["turned"], r["header_row"], r["col"]) for r in found["down"]] == [(True, 1, 2), (True, 1, 3), (True, 1, 4)]
    assert [r["text"] for r in found["years over quarters"]][:2] == ["2024 Q1", "Q2"]


def test_bodies_of_axes_side_by_side(spark):
    rows = [[None, 2020, 2021, None, None, 2030, 2031], ["a", 1, 2], [None, None, None, None, "b", 3, 4], [None, 2020, 2021], ["c", 5, 6]]
    axes = spark.createDataFrame([("b", "S", "x", 1, 1, [2, 3]), ("b", "S", "y", 1, 1, [6, 7]), ("b", "S", "z", 4, 4, [2, 3])], "book_id string, sheet string, axis_id string, start_row long, header_row long, cols array<bigint>")
    got = {r["row"]: r["axis_id"] for r in A.body_rows(cells_of(spark, {"S": rows}), axes).collect()}
    assert got[2] == "x" and got[3] == "y" and got[5] == "z"

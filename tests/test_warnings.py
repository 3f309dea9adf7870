"""One workbook with a fault of each kind: merges and hidden rows from the file, and its list of warnings."""

import pytest

MERGED = {"B1": ("2024", None), "D1": ("2025", None), "B2": ("Q1", None), "C2": ("Q2", None), "D2": ("Q1", None), "E2": ("Q2", None), "A3": ("Sales", None)} | {f"{c}3": (i, None) for i, c in enumerate("BCDE", 5)}
FAULTS = {"B1": ("9M 2024 нет", None), "C1": ("12M 2024 нет", None), "A2": ("Rate", None), "B2": (1, None), "C2": (2, None), "A3": ("Gone", None), "B3": (1, "=Nowhere!A1+"), "C3": (4, "=Nowhere!A1"), "A4": ("Blank", None), "B4": (None, "=B2*2"), "C4": (3, "=Unknown_name"), "A6": ("Plan for Q3 only", None), "A7": ("Plan for Q3 only", None)}


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    from gridloom.plans.book import build
    from gridloom.sources.workbook import write_book

    path = tmp_path_factory.mktemp("faults") / "book.xlsx"
    path.write_bytes(write_book({"Merged": MERGED, "Faults": FAULTS}, merges={"Merged": ["B1:C1", "D1:E1"]}, hidden={"Faults": [2, 3, 6]}))
    return build(spark, str(path))


def test_merges_and_hidden_rows_come_from_the_file(book):
    cells = {(r["sheet"], r["addr"]): r for r in book.cells.collect()}
    assert [(cells[("Merged", a)]["merge_end_row"], cells[("Merged", a)]["merge_end_col"]) for a in ("B1", "D1", "B2")] == [(1, 3), (1, 5), (None, None)]
    assert cells[("Faults", "A3")]["hidden_row"] and not cells[("Faults", "A3")]["hidden_col"] and not cells[("Faults", "A4")]["hidden_row"]
    got = {r["period_id"]: r["cached_value"] for r in book.series.where("sheet = 'Merged'").collect()}
    assert got == {"2024Q1": "5", "2024Q2": "6", "2025Q1": "7", "2025Q2": "8"}


def test_warnings_in_order(book):
    rows = book.warnings().orderBy("no").collect()
    assert [r["line"] for r in rows] == [
        "1 unparsed formula(s) (e.g. Faults!B3)",
        "Unparsed period header Faults!A6: «Plan for Q3 only»",
        "1 formula cell(s) missing cached values (e.g. Faults!B4)",
        "Graph: 1 dangling targets",
        "Graph: 1 unresolved formula targets",
        "Hidden rows Faults!2:3,6:6 are included",
        "No time axis on Faults: headers «9M 2024 нет», «12M 2024 нет» look like periods but form no axis",
    ]
    assert {r["total"] for r in rows} == {7} and [r["no"] for r in rows] == list(range(1, 8))
    assert [(r["no"], r["total"]) for r in book.warnings(2).orderBy("no").collect()] == [(1, 7), (2, 7)]

"""Repeated headers, timelines across sheets and switches, in one workbook and on small relations."""

import pytest
from gridloom.operators import timelines as T

YEARS = {"B1": (2020, None), "C1": (2021, None), "D1": (2022, None)}
ONE = YEARS | {"A2": ("Sales", None), "B2": (5, None), "C2": (6, None), "D2": (7, None), "B5": (2020, None), "C5": (2021, None), "D5": (2022, None), "A6": ("Costs", None), "B6": (3, None), "C6": (4, None), "D6": (9, None)}
TWO = YEARS | {"A2": ("On", None), "B2": (0, None), "C2": (1, None), "D2": (1, None), "A3": ("Debt", None), "B3": (8, None), "C3": (8, None), "D3": (9, None)}
THREE = YEARS | {"A2": ("On", None), "B2": (1, None), "C2": (1, None), "D2": (0, None), "A3": ("Cash", None), "B3": (8, None), "C3": (8, None), "D3": (9, None)}
SWITCH = {"B1": (2020, None), "C1": (2021, None), "D1": (2022, None)} | {f"A{r}": (f"Line {r}", None) for r in (2, 3)} | {f"{c}{r}": (r, f"=CHOOSE($H$9,{c}{r}0,SUM({c}{r}1:{c}{r}2))") for c in "BCD" for r in (2, 3)} | {f"D{r}": (r, "=INDEX(B2:D2,1,Case)") for r in (2, 3)}
SWITCH |= {"H8": ("Case to run", None), "H9": (1, None), "J9": (2, None)}

PARAMS = {f"{c}1": (t, None) for c, t in zip("ABCDE", ("Parameter", "Base case", "Ед. изм.", "Источник информации", "№"))}
for _r in range(2, 7):
    PARAMS |= {f"A{_r}": (f"Rate {_r}", None), f"B{_r}": (_r / 10, None), f"C{_r}": ("%", None), f"D{_r}": ("as the board of directors said", None), f"E{_r}": (_r - 1, None)}


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    from gridloom.plans.book import build
    from gridloom.sources.workbook import write_book

    path = tmp_path_factory.mktemp("models") / "book.xlsx"
    path.write_bytes(write_book({"One": ONE, "Two": TWO, "Three": THREE, "Switch": SWITCH, "Params": PARAMS}, {"Case": "Switch!$J$9"}))
    return build(spark, str(path))


def test_a_repeated_header_is_the_first_axis(book):
    rows = {r["label"]: r for r in book.layout.where("sheet = 'One'").collect()}
    assert rows["Sales"]["axis_id"] == rows["Costs"]["axis_id"] == "One!r1" and rows["Costs"]["row_key"] == "One|6|One!r5"
    got = {(r["label"], r["period_id"]): r["cached_value"] for r in book.series.where("sheet = 'One'").collect()}
    assert got[("Costs", "2022")] == "9" and got[("Sales", "2020")] == "5" and len(got) == 6


def test_sheets_share_a_timeline_unless_flags_differ(book):
    got = {r["axis_id"]: r["timeline_id"] for r in book.timelines().collect()}
    # One has no flags: it goes with the first that has some, which names the timeline; Three's flags differ
    assert got["One!r1"] == got["Two!r1"] == "Two!r1" and got["Three!r1"] == "Three!r1"


def test_switches_become_rows_of_their_own(book):
    assert {(r["addr"], r["readers"]) for r in book.switches.collect()} == {("H9", 2), ("J9", 2)}
    row = book.layout.where("kind = 'flag' and sheet = 'Switch'").collect()
    assert [(r["row"], r["label"], r["block_id"], r["value_cols"]) for r in row] == [(9, "Case to run", "Switch!r9", [8])]
    assert [(r["period_id"], r["cached_value"]) for r in book.series.where("label = 'Case to run'").collect()] == [("H9", "1")]


def test_roles_of_parameter_columns(book):
    got = {r["col"]: (r["caption"], r["role"]) for r in book.column_roles().where("sheet = 'Params'").collect()}
    assert got == {1: ("Parameter", "label"), 2: ("Base case", "value"), 3: ("Ед. изм.", "unit"), 4: ("Источник информации", "note"), 5: ("№", "index")}


@pytest.mark.parametrize("text, role", [("Значение базовое", "value"), ("Source of information", "note"), ("source of all the information", None), ("Ёмкость", None), ("comment(s)", "note"), ("", None), (None, None)])
def test_header_roles(spark, text, role):
    from gridloom.operators.roles import header_role
    from pyspark.sql import functions as F

    assert spark.range(1).select(header_role(F.lit(text).cast("string")).alias("r")).first()["r"] == role


def plain(axes):
    """shared_axes one axis after another."""
    kept, out = [], {}
    for a in sorted(axes, key=lambda a: a["place"]):
        fits = [k for k in kept if k["columns"] == a["columns"] and (k["flags"] is None or a["flags"] is None or k["flags"] == a["flags"])]
        hit = next((k for k in fits if k["marked"] and not a["marked"]), None) or next((k for k in fits if k["exact"] == a["exact"]), None)
        out[a["axis_id"]] = hit["axis_id"] if hit else a["axis_id"]
        if hit and hit["flags"] is None:
            hit["flags"] = a["flags"]
        if not hit:
            kept.append(dict(a))
    return out


def test_shared_axes_are_dealt_in_order(spark):
    import random

    pick = random.Random(5)
    axes = []
    for i in range(80):
        marked = pick.random() < 0.3
        c = pick.choice("ab")
        axes.append({"book_id": "b", "sheet": "S", "columns": c, "exact": c + (pick.choice("xy") if marked else ""), "marked": marked, "flags": pick.choice([None, None, "1", "2"]), "place": i, "axis_id": f"x{i}"})
    schema = "book_id string, sheet string, columns string, exact string, marked boolean, flags string, place long, axis_id string"
    got = {r["axis_id"]: r["first"] for r in T.shared_axes(spark.createDataFrame(axes, schema), ["book_id", "sheet"]).collect()}
    assert got == plain(axes)
    assert T.shared_axes(spark.createDataFrame([], schema), ["book_id", "sheet"]).count() == 0
    assert T.linked_timelines(spark.createDataFrame([], schema + ", signature string, dates string, n_flags int, sheet_no int"), ["book_id"]).count() == 0

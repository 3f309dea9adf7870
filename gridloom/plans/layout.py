"""Layout: period axes, blocks and row kinds from where cells stand in a sheet.

Axes and the rows that belong to them come from joins and windows over all sheets (operators.axes). What depends on the
order of a block's rows (label column, sections, parents) runs as one grouped function a block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.functions.headers import with_atoms
from gridloom.operators.axes import KEYS, body_rows, candidates
from gridloom.params import RUN_LEAST
from gridloom.session import checkpointed, ship

LAYOUT = "book_id string, sheet string, block_id string, block_kind string, axis_id string, label_col long, row long, label string, row_key string, kind string, parent_row long, section_path array<string>, periods array<struct<col:long,key:string,text:string,kind:string,group_key:string,start_date:string,end_date:string>>, value_cols array<long>, unit string, turned boolean, captions map<long,string>"

#: What an axis says of each of its columns.
PERIOD = ("col", "key", "text", "kind", "group_key", "start_date", "end_date")


def prepared(cells: DataFrame) -> DataFrame:
    """Cells with what they show, their number and header atom. Each step is computed once, for the next to use."""
    ship(cells.sparkSession)
    more = [c for c in ("formula_template", "merge_end_col", "hidden") if c in cells.columns]
    since_1904 = F.coalesce("date1904", F.lit(False)) if "date1904" in cells.columns else F.lit(False)
    out = cells.select(*KEYS, "row", "col", "formula_raw", "style_indent", *more, F.trim("cached_value").alias("text"), C.parse_number(F.col("cached_value")).alias("number"), C.is_date_format(F.col("number_format")).alias("dated"), since_1904.alias("since_1904"))
    day = F.floor("number").cast("int")
    date = F.when(F.col("dated"), F.when(F.col("since_1904"), C.serial_to_date(day, True)).otherwise(C.serial_to_date(day)))
    out = checkpointed(out.withColumn("date", date))
    out = out.withColumn("shown", F.coalesce(F.date_format("date", "dd.MM.yyyy"), F.nullif("text", F.lit(""))))
    # a date is no amount beside other headers
    out = out.withColumn("number", F.when(F.col("date").isNull(), F.col("number"))).drop("text", "dated", "since_1904", "date")
    return checkpointed(with_atoms(out, "shown"))


def block_rows(sheet: str, block: str, kind: str, body: dict[int, list], columns: list[int], periods: list[dict], unit: str | None) -> list[dict]:
    """The rows of a block: label, kind, parent by indent, sections by rows without values; captions of parameter columns."""
    inside = set(columns)
    votes: dict[int, int] = {}
    for cells in body.values():
        left = [c.col for c in cells if c.col not in inside and c.shown and c.number is None]
        if left:
            votes[min(left)] = votes.get(min(left), 0) + 1
    label_col = max(votes, key=lambda c: (votes[c], -c)) if votes else None
    out, stack, section = [], [], []
    captions: dict[int, str] = {}
    for n in sorted(body):
        at = {c.col: c for c in body[n]}
        label = at[label_col].shown if label_col in at else None
        values = [at[c] for c in columns if c in at and (at[c].shown or at[c].formula_raw)]
        if not label and not values:
            continue
        numbers = [c.number for c in values if c.number is not None]
        if not periods and not out and values and not numbers:  # words over the first numbers of a parameter block name its columns
            captions = {c.col: c.shown for c in values}
            continue
        whole = len(numbers) == len(values) and len(values) >= 2
        if not values:
            row_kind = "abstract"
        elif periods and whole and all(v in (0, 1) for v in numbers):
            row_kind = "flag"
        elif periods and whole and len(values) >= RUN_LEAST and numbers[0] in (0, 1) and all(b - a == 1 for a, b in zip(numbers, numbers[1:], strict=False)):
            row_kind = "index"
        else:
            row_kind = "fact"
        indent = int(getattr(at.get(label_col), "style_indent", 0) or 0)
        while stack and stack[-1][1] >= indent:
            stack.pop()
        parent = stack[-1][0] if stack else None
        stack.append((n, indent))
        if row_kind == "abstract":
            section = [s for s in section if s[1] < indent] + [(label, indent)]
        out.append({"sheet": sheet, "block_id": block, "block_kind": kind, "axis_id": block if periods else None, "label_col": label_col, "row": n, "label": label, "row_key": f"{sheet}|{n}|{block}", "kind": row_kind, "parent_row": parent, "section_path": [s for s, _ in section if row_kind != "abstract"], "periods": periods, "value_cols": columns, "unit": unit, "turned": False, "captions": captions})
    return out


def turned_rows(cells: DataFrame, axes: DataFrame) -> DataFrame:
    """LAYOUT rows of vertical axes: one for each named column beside the periods; row is the names' row, label_col the series' column."""
    lines = axes.where("turned").groupBy(*KEYS, "axis_id", "header_row", "top_row").agg(F.array_sort(F.collect_list(F.struct(*PERIOD))).alias("periods"))
    names = cells.where("number is null and shown is not null").select(*KEYS, F.col("row").alias("header_row"), F.col("col").alias("label_col"), F.col("shown").alias("label"))
    held = cells.where("number is not null").select(*KEYS, F.col("row"), F.col("col").alias("label_col"))
    span = F.transform("periods", lambda p: p["col"])
    out = lines.join(names, [*KEYS, "header_row"]).where("label_col > top_row")
    full = out.join(held, [*KEYS, "label_col"]).where(F.array_contains(span, F.col("row"))).select(*KEYS, "axis_id", "label_col").distinct()
    out = out.join(full, [*KEYS, "axis_id", "label_col"], "left_semi")
    key = F.concat_ws("|", "sheet", F.col("header_row").cast("string"), F.concat(F.lit("c"), F.col("label_col").cast("string")), "axis_id")
    none = F.lit(None)
    return out.select(*KEYS, F.col("axis_id").alias("block_id"), F.lit("timeline").alias("block_kind"), "axis_id", "label_col", F.col("header_row").alias("row"), "label", key.alias("row_key"), F.lit("fact").alias("kind"), none.cast("long").alias("parent_row"), F.array().cast("array<string>").alias("section_path"), "periods", F.array("label_col").alias("value_cols"), none.cast("string").alias("unit"), F.lit(True).alias("turned"), F.create_map().cast("map<bigint,string>").alias("captions"))


def detect(cells: DataFrame) -> DataFrame:
    """LAYOUT rows of every sheet of cells(book_id, sheet, row, col, cached_value, number_format, formula_raw, style_indent; date1904, formula_template, hidden and merge_end_col where known)."""
    rows = prepared(cells)
    shut = rows.groupBy(*KEYS, "col").agg(F.min("hidden").alias("h")).where("h").select(*KEYS, "col") if "hidden" in rows.columns else None
    axes = checkpointed(candidates(rows, shut))
    # totals and stubs between periods are columns of the axis, too
    across = axes.where("not turned").groupBy(*KEYS, "axis_id", "header_row").agg(F.array_sort(F.collect_list(F.struct(*PERIOD))).alias("periods"), F.min("top_row").alias("start_row"), F.array_sort(F.collect_set("col")).alias("cols"))
    heads = across.select(*KEYS, F.explode(F.sequence("start_row", "header_row")).alias("row")).distinct()
    left = rows.where("shown is not null").join(across.select(*KEYS, "axis_id", F.col("header_row").alias("row"), F.array_min("cols").alias("first")), [*KEYS, "row"]).where((F.col("col") < F.col("first")) & F.col("atom").isNull())
    across = across.join(left.groupBy(*KEYS, "axis_id").agg(F.min_by("shown", "col").alias("unit")), [*KEYS, "axis_id"], "left")
    down = axes.where("turned").groupBy(*KEYS, "axis_id").agg(F.explode(F.sequence(F.min("header_row"), F.max("col"))).alias("row")).select(*KEYS, "row").distinct()
    at = rows.select(*KEYS, "row", "col", "shown", "number", "formula_raw", "style_indent")
    at = at.join(body_rows(rows, across.select(*KEYS, "axis_id", "start_row", "header_row", "cols")), [*KEYS, "row"], "left").join(heads, [*KEYS, "row"], "left_anti").join(down, [*KEYS, "row"], "left_anti")
    at = at.withColumns({"axes": F.count("axis_id").over(Window.partitionBy(*KEYS)), "axis_id": F.coalesce("axis_id", F.lit(""))})
    names = [f.split()[0] for f in LAYOUT.split(", ")]

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        book, sheet, axis = key
        body: dict[int, list] = {}
        for r in x.astype(object).where(x.notna(), None).sort_values(["row", "col"]).itertuples():
            body.setdefault(int(r.row), []).append(r)
        found: list[dict] = []
        if len(y):
            periods = [{c: p[c] for c in PERIOD} | {"col": int(p["col"])} for p in y["periods"].iloc[0]]
            found = block_rows(sheet, axis, "timeline", body, [p["col"] for p in periods], periods, y["unit"].iloc[0]) if body else []
        else:
            values = sorted({int(c.col) for cells in body.values() for c in cells if c.number is not None})
            if values and len(body) >= RUN_LEAST + (int(x["axes"].iloc[0]) > 0):
                kind = "params" if len(values) > 2 else "key_value"
                found = block_rows(sheet, f"{sheet}!{'params' if kind == 'params' else 'values'}", kind, body, values, [], None)
        return pd.DataFrame([r | {"book_id": book} for r in found], columns=names)

    of = [*KEYS, "axis_id"]
    out = at.groupBy(*of).cogroup(across.select(*of, "periods", "unit").groupBy(*of)).applyInPandas(run, LAYOUT)
    return out.unionByName(turned_rows(rows, axes))


def axis_periods(layout: DataFrame) -> DataFrame:
    """One row for each period of an axis: book_id, sheet, axis_id, period_index, col, period_id, text, kind, group_key, start_date, end_date."""
    one = layout.where("axis_id is not null").groupBy("book_id", "sheet", "axis_id").agg(F.first("periods").alias("periods"))
    return one.select("book_id", "sheet", "axis_id", F.posexplode("periods").alias("i", "p")).select("book_id", "sheet", "axis_id", (F.col("i") + 1).cast("long").alias("period_index"), "p.col", F.col("p.key").alias("period_id"), *[f"p.{c}" for c in PERIOD[2:]])

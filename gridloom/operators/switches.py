"""Switches: constant cells that the formulas of other rows pass to INDEX, CHOOSE or OFFSET."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordered import as_of
from gridloom.params import SWITCH_READERS

SHEET = ["book_id", "sheet"]


def selects_scenario(label: Column) -> Column:
    """Whether a label names the chosen scenario."""
    plain = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))
    return F.coalesce(plain.rlike(r"\b(scenario (chosen|selected|choice)|(chosen|selected) scenario)\b"), F.lit(False))


def switch_reads(parsed: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(book_id, sheet, addr, reader_row) of parsed formulas: each cell of the own sheet that a selecting call takes, once for
    each row that reads it. named(book_id, sheet, name, means) says which cell Sheet!A1 a defined name is."""
    rows = parsed.select(*SHEET, F.regexp_extract("addr", r"(\d+)$", 1).cast("long").alias("reader_row"), F.inline("switches"))
    own = rows.where("not named").select(*SHEET, F.col("target").alias("addr"), "reader_row")
    if named is not None:
        part = F.regexp_extract("means", r"!([A-Z]+[0-9]+)$", 1)
        found = rows.where("named").join(named.withColumnRenamed("name", "target"), [*SHEET, "target"])
        own = own.unionByName(found.where(F.col("means") == F.concat("sheet", F.lit("!"), part)).select(*SHEET, part.alias("addr"), "reader_row"))
    return own.distinct()


def switch_cells(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """(book_id, sheet, row, col, addr, label, readers) of cells(book_id, sheet, row, col, addr, text, number, formula_raw):
    constants that SWITCH_READERS or more other rows read. Where a sheet has several, labels of a chosen scenario win."""
    fixed = cells.where("formula_raw is null").select(*SHEET, "row", "col", "addr")
    at = fixed.join(reads, [*SHEET, "addr"]).where("reader_row <> row")
    found = at.groupBy(*SHEET, "row", "col", "addr").agg(F.count("*").alias("readers")).where(F.col("readers") >= SWITCH_READERS)
    texts = cells.where("number is null and text is not null").groupBy(*SHEET, "row").agg(F.min_by("text", "col").alias("label"))
    out = found.join(texts, [*SHEET, "row"], "left").withColumn("__s", selects_scenario(F.col("label")))
    return out.withColumn("__any", F.max("__s").over(Window.partitionBy(*SHEET))).where("__s or not __any").drop("__s", "__any")


def orphan_rows(switches: DataFrame, layout: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows for the layout of switches that no block has, on sheets with blocks: one parameter each, by the name above it.

    The name is the nearest constant above in its column if that is text, else the first text of its row; without a name
    it is left out."""
    lone = switches.join(layout.select(*SHEET, "row").distinct(), [*SHEET, "row"], "left_anti").join(layout.select(*SHEET).distinct(), SHEET, "left_semi")
    lone = lone.groupBy(*SHEET, "row").agg(F.min("col").alias("col"), F.min_by("label", "col").alias("beside"))
    fixed = cells.where("formula_raw is null and text is not null")
    above = fixed.select(*SHEET, "col", F.col("row").alias("at"), F.struct("text", "number").alias("above"))
    out = as_of(lone.withColumn("at", F.col("row") - 1), above, [*SHEET, "col"], "at", "above")
    first = fixed.where("number is null").groupBy(*SHEET, "row").agg(F.min("col").alias("first_col"))
    out = out.join(first, [*SHEET, "row"], "left")
    over = F.when(F.col("above.number").isNull(), F.col("above.text"))
    block = F.concat("sheet", F.lit("!r"), F.col("row").cast("string"))
    made = {
        "block_id": block, "block_kind": F.lit("params"), "label_col": F.when(over.isNotNull(), F.col("col")).otherwise(F.col("first_col")), "label": F.coalesce(over, "beside"),
        "row_key": F.concat_ws("|", "sheet", F.col("row").cast("string"), block), "kind": F.lit("flag"), "section_path": F.array().cast("array<string>"), "value_cols": F.array("col"),
        "periods": F.array().cast(layout.schema["periods"].dataType), "turned": F.lit(False), "captions": F.create_map().cast("map<bigint,string>"),
    }
    out = out.withColumns(made).where("label is not null")
    return out.select(*[F.col(f.name) if f.name in (*SHEET, "row", *made) else F.lit(None).cast(f.dataType).alias(f.name) for f in layout.schema.fields])

"""Rectangles: expansion, range nodes, cover and membership by an equi-join of tiles, member classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.params import EXPAND_CAP, GRID_COLUMNS, GRID_ROWS, NODE_AREA


def area(r: DataFrame | None = None) -> Column:
    return (F.col("c2") - F.col("c1") + 1) * (F.col("r2") - F.col("r1") + 1)


def is_whole_axis() -> Column:
    return ((F.col("r1") == 1) & (F.col("r2") == GRID_ROWS)) | ((F.col("c1") == 1) & (F.col("c2") == GRID_COLUMNS))


def is_range_node(most: int = NODE_AREA) -> Column:
    """Whether a rectangle stays one node: a whole axis, or more cells than most."""
    return is_whole_axis() | (area() > most)


def expand(df: DataFrame, cap: int = EXPAND_CAP) -> DataFrame:
    """The first cap cells of each rectangle, row by row, with ord (from 0) and truncated; generated within the row."""
    wide = F.col("c2") - F.col("c1") + 1
    out = df.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.least(area(), F.lit(cap)) - 1)))
    return out.withColumns({"row": F.col("r1") + F.floor(F.col("ord") / wide), "col": F.col("c1") + F.col("ord") % wide, "truncated": area() > cap})


def cover(points: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of points(keys, row, col, ...) and rects(keys, c1, c2, r1, r2, ...) that contain them.

    A rectangle is placed on a grid whose tiles are as high and as wide as itself, up to the next power of two, so it
    meets at most two of them each way; a point is repeated for each such size that occurs under its keys. The join is
    an equi-join on keys, sizes and tile, and compares a rectangle with what lies near it, not with all of its sheet. It
    is a merge join: either side may be small before rows are made of pairs, and a broadcast would leave all to its few tasks.
    """
    power = lambda a, b: F.pow(F.lit(2), F.ceil(F.log2((F.col(b) - F.col(a) + 1).cast("double")))).cast("long")
    tile = lambda x, size: F.floor(F.col(x) / F.col(size))
    sized = rects.where("r1 <= r2 and c1 <= c2").withColumns({"__h": power("r1", "r2"), "__w": power("c1", "c2")})
    at = points.join(sized.select(*keys, "__h", "__w").distinct(), keys).withColumns({"__y": tile("row", "__h"), "__x": tile("col", "__w")})
    tiles = lambda a, b, size: F.explode(F.sequence(tile(a, size), tile(b, size)))
    sized = sized.withColumn("__y", tiles("r1", "r2", "__h")).withColumn("__x", tiles("c1", "c2", "__w"))
    inside = (F.col("row") >= F.col("r1")) & (F.col("row") <= F.col("r2")) & (F.col("col") >= F.col("c1")) & (F.col("col") <= F.col("c2"))
    return at.join(sized.hint("merge"), [*keys, "__h", "__w", "__y", "__x"]).where(inside).drop("__h", "__w", "__y", "__x")


def cover_counts(points: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, covers): how many of rects(keys, c1, c2, r1, r2) contain each of points(keys, row, col) that any contains.

    Equal rectangles are counted first and joined once with their number, so pairs grow with the different ones, which the
    sheet bounds, and not with copies.
    """
    different = rects.groupBy(*keys, "c1", "c2", "r1", "r2").agg(F.count("*").alias("__n"))
    return cover(points, different, keys).groupBy(*keys, "row", "col").agg(F.sum("__n").alias("covers"))


def classify_member(known: Column, sheet_known: Column, presence: Column, in_range: Column, unresolved: Column) -> Column:
    """struct(status, reason, dangling) of an edge's target, by the first rule that fits."""
    kind = lambda status, reason, dangling: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), F.lit(dangling).alias("dangling"))
    return (
        F.when(unresolved, kind("unresolved", "unresolved", False))
        .when(known, kind("cell", None, False))
        .when(~sheet_known, kind("missing", "missing_sheet", True))
        .when(F.coalesce(presence, F.lit("")) == "populated", kind("missing", "parser_resolution_failure", True))
        .when(in_range, kind("empty", "empty_range_member", False))
        .otherwise(kind("empty", "empty_ref", False))
    )

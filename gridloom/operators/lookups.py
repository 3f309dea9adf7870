"""Lookups and votes: defined names, overlays, pairings, labels, column sets, caps, texts of spans, id suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordered import first_seen


def resolve_names(uses: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """uses(keys, sheet, name) with what the name stands for; names(keys, sheet or null, name, formula, ordinal).

    A sheet's own name hides the workbook's; the last definition of a scope wins; only a wholly absolute cell or
    range resolves, one level deep; a bracket means another workbook.
    """
    keys = keys or []
    last = first_seen(names.withColumn("__n", F.lower("name")).withColumn("__o", -F.col("ordinal")), [*keys, "sheet", "__n"], ["__o"])
    local = last.where("sheet is not null").select(*keys, F.col("sheet").alias("__s"), "__n", F.col("formula").alias("__local"))
    book = last.where("sheet is null").select(*keys, "__n", F.col("formula").alias("__book"))
    out = uses.withColumns({"__n": F.lower("name"), "__s": F.col("sheet")}).join(local, [*keys, "__s", "__n"], "left").join(book, [*keys, "__n"], "left")
    text = F.coalesce("__local", "__book")
    corner = r"\$[A-Za-z]{1,3}\$[0-9]{1,7}"
    absolute = text.rlike(rf"^=?('[^']+'!|[^!'\[]+!)?{corner}(:{corner})?$")
    status = F.when(text.isNull(), "unknown").when(text.contains("["), "external").when(absolute, "resolved").otherwise("unresolved")
    return out.withColumns({"status": status, "target": F.when(absolute & ~text.contains("["), F.regexp_replace(F.regexp_replace(text, r"^=", ""), r"\$", ""))}).drop("__n", "__s", "__local", "__book")


def overlay(base: DataFrame, top: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with the values of top where top has any; rows of either side stay."""
    return base.join(top.withColumnRenamed(value, "__top"), keys, "full_outer").withColumn(value, F.coalesce("__top", value)).drop("__top")


def labelled(nodes: DataFrame, rows: DataFrame, keys: list[str], ident: str, label: str, order: str) -> DataFrame:
    """nodes with the first label in order that any row of the same ident has; null where there is none."""
    first = rows.where(F.col(label).isNotNull()).groupBy(*keys, ident).agg(F.min_by(label, order).alias(label))
    return nodes.join(first, [*keys, ident], "left")


def pair(left: DataFrame, right: DataFrame, name: str, order: str) -> DataFrame:
    """Pairs of rows by equal name; the rest by their order among the rest: left name, right name, by_name."""
    a, b = left.select(F.col(name).alias("left_name"), F.col(order).alias("__a")), right.select(F.col(name).alias("right_name"), F.col(order).alias("__b"))
    same = a.join(b, F.col("left_name") == F.col("right_name")).select("left_name", "right_name", F.lit(True).alias("by_name"))
    rank = lambda o: F.row_number().over(Window.orderBy(o))
    rest_a = a.join(same.select("left_name"), "left_name", "left_anti").withColumn("__k", rank("__a"))
    rest_b = b.join(same.select("right_name"), "right_name", "left_anti").withColumn("__k", rank("__b"))
    return same.union(rest_a.join(rest_b, "__k").select("left_name", "right_name", F.lit(False)))


def label_column(df: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """The column that is most often the leftmost of its row, the left one among equals: keys, label_col, n."""
    votes = df.groupBy(*keys, row).agg(F.min(col).alias("label_col")).groupBy(*keys, "label_col").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "label_col")
    return votes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; null if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either)


def capped_lines(sources: list[DataFrame], order: str, cap: int) -> DataFrame:
    """The first cap rows of several sources, a source before the next, each in its order."""
    out = sources[0].withColumn("priority", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("priority", F.lit(k)))
    return out.orderBy("priority", order).limit(cap)


def ranked_lines(sources: list[DataFrame], keys: list[str], order: list[str], cap: int) -> DataFrame:
    """(keys, no, line, total): the first cap lines of each key from several sources(keys, order, line), a source before the
    next, each in its order; total counts all lines."""
    out = sources[0].withColumn("priority", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("priority", F.lit(k)))
    top = out.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", *order, "line"))).where(F.col("no") <= cap)
    return top.select(*keys, "no", "line").join(out.groupBy(*keys).agg(F.count("*").alias("total")), keys)


def span_text(values: Column) -> Column:
    """Sorted whole numbers as spans: 17:18,20:20."""
    v = F.array_sort(F.array_distinct(values))
    zero = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, x: Column) -> Column:
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), x.cast("long").alias("b"))))
        new = F.concat(acc, F.array(F.struct(x.cast("long").alias("a"), x.cast("long").alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == x - 1), grown).otherwise(new)

    return F.aggregate(v, zero, step, lambda acc: F.array_join(F.transform(acc, lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ","))


def suffixed(ident: str, order: list[str]) -> Column:
    """An id that is unique: repeated ids get #2, #3 and so on in order."""
    n = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    return F.when(n > 1, F.concat(F.col(ident), F.lit("#"), n.cast("string"))).otherwise(F.col(ident))


def is_running_sum(value: str, keys: list[str], order: str) -> Column:
    """Whether a value is the sum of all values before it in its row (two or more)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce((F.count(value).over(w) >= 2) & (F.abs(F.sum(value).over(w) - F.col(value)) <= F.greatest(F.lit(1e-6), F.abs(value) * 1e-4)), F.lit(False))

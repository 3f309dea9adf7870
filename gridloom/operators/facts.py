"""Facts about cells, rows, axes and ranges: statistics, votes, shapes, parents, estimates, catalogues."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, count, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.periods import period_position
from gridloom.operators.lookups import span_text
from gridloom.operators.ranges import area, is_range_node, is_whole_axis
from gridloom.params import EXPAND_CAP, MAJORITY, MONTH_STEPS, OUTLINE_MOST, TRACE_MEMBERS


def formula_stats(cells: DataFrame, not_applicable: DataFrame, keys: list[str], samples: int = 3) -> DataFrame:
    """Formulas of cells(keys, cell, ordinal, formula, cached, unparsed): how many, without a cached value, of these in rows where one applies, unparsed, and the first few of both; cells of not_applicable(keys, cell) need no value."""
    rows = cells.where(F.coalesce("formula", F.lit("")) != "").join(not_applicable.select(*keys, "cell", F.lit(True).alias("__na")), [*keys, "cell"], "left")
    missing = F.col("cached").isNull()
    wanted = missing & F.col("__na").isNull()
    w = Window.partitionBy(*keys)
    rank = lambda c: F.sum(c.cast("int")).over(w.orderBy("ordinal", "cell").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"__w": wanted, "__u": F.coalesce("unparsed", F.lit(False))})
    rows = rows.withColumns({"__wn": rank(F.col("__w")), "__un": rank(F.col("__u"))})
    some = lambda flag, n: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag) & (F.col(n) <= samples), F.struct(n, "cell")))), lambda x: x["cell"])
    return rows.groupBy(*keys).agg(F.count("*").alias("formulas"), F.count_if(missing).alias("missing_cached"), F.count_if("__w").alias("missing_values"), F.count_if("__u").alias("unparsed"), some("__w", "__wn").alias("missing_samples"), some("__u", "__un").alias("unparsed_samples"))


def flag_map(flags: DataFrame, axis: list[str], period: str, name: str, on: str) -> DataFrame:
    """(axis, period, flags): for each period a map of flag names to on or off; only names that are on in some period of the axis."""
    live = flags.groupBy(*axis, name).agg(F.bool_or(on).alias("__live")).where("__live").drop("__live")
    kept = flags.join(live, [*axis, name], "left_semi").groupBy(*axis, period, name).agg(F.bool_or(on).alias("__on"))
    maps = kept.groupBy(*axis, period).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "__on")))).alias("flags"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>"))
    return flags.select(*axis, period).distinct().join(maps, [*axis, period], "left").withColumn("flags", F.coalesce("flags", empty))


def active_value_column(edges: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, sheet, col, readers): of each sheet the column that formulas of other sheets read most; the first read among equals; edges(keys, source_sheet, target_sheet, target_col, ord)."""
    other = edges.where(F.lower("source_sheet") != F.lower("target_sheet"))
    votes = other.groupBy(*keys, F.col("target_sheet").alias("sheet"), F.col("target_col").alias("col")).agg(F.count("*").alias("readers"), F.min("ord").alias("__first"))
    w = Window.partitionBy(*keys, "sheet").orderBy(F.desc("readers"), "__first", "col")
    return votes.withColumn("__rn", F.row_number().over(w)).where((F.col("__rn") == 1) & (F.col("readers") >= least)).drop("__rn", "__first")


def expansion(cap: int = EXPAND_CAP, present: Column | None = None) -> Column:
    """How many edges a rectangle (c1, c2, r1, r2) becomes, without making them: one as a node, else its cells up to the cap (a whole axis only its present ones)."""
    cells = F.least(area(), F.lit(cap))
    return F.when(is_range_node(), F.lit(1)).when(is_whole_axis() & F.lit(present is not None), present if present is not None else cells).otherwise(cells).cast("long")


def outline_parent(level: str, unit: Column, keys: list[str], row: str, below: bool) -> Column:
    """The nearest row before (where summaries stand below: after) with a smaller outline level; unit rows neither are one nor have one."""
    order = F.desc(row) if below else F.asc(row)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = F.lit(None).cast("long")
    for k in range(1, OUTLINE_MOST + 1):  # levels are few, so one running value for each level does
        out = F.when(F.col(level) == k, F.last(F.when((F.col(level) < k) & ~unit, F.col(row)), ignorenulls=True).over(w)).otherwise(out)
    return F.when(~unit, out).cast("long")


def steady_month_step(keys: Column) -> Column:
    """Whether an array of dates as keys (YYYY-MM or YYYY-MM-DD), in order, goes on by one of the usual month steps."""
    months = F.transform(keys, lambda k: F.substring(k, 1, 4).cast("int") * 12 + F.substring(k, 6, 2).cast("int"))
    steps = F.zip_with(F.slice(months, F.lit(2), F.greatest(F.size(months) - 1, F.lit(0))), F.slice(months, F.lit(1), F.greatest(F.size(months) - 1, F.lit(0))), lambda b, a: b - a)
    return (F.size(steps) > 0) & (F.size(F.array_distinct(steps)) == 1) & F.coalesce(F.get(steps, F.lit(0)).isin(*MONTH_STEPS), F.lit(False))


def regular_run(keys: Column, least: int = 3) -> Column:
    """Whether period keys, in order, are at least three of one grain (no days) with one positive step."""
    at = F.transform(keys, lambda k: period_position(k))
    ordinals = F.transform(at, lambda p: p["ordinal"])
    n = F.greatest(F.size(keys) - 1, F.lit(0))
    steps = F.zip_with(F.slice(ordinals, F.lit(2), n), F.slice(ordinals, F.lit(1), n), lambda b, a: b - a)
    grains = F.array_distinct(F.transform(at, lambda p: p["grain"]))
    return (F.size(keys) >= least) & ~F.exists(at, lambda p: p["grain"].isNull()) & (F.size(grains) == 1) & (F.get(grains, F.lit(0)) != "day") & (F.size(F.array_distinct(steps)) == 1) & (F.get(steps, F.lit(0)) > 0)


def circularity_hints(labels: DataFrame, cells: DataFrame, cycles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sheet, row, label, cells): rows of labels(keys, sheet, row, label) that call themselves circular, in books without a cycle, with the cells(keys, sheet, row, cell) of each."""
    said = labels.where(F.lower("label").contains("circular")).join(cycles.select(*keys).distinct(), keys, "left_anti")
    of = cells.groupBy(*keys, "sheet", "row").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    return said.join(of, [*keys, "sheet", "row"], "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))


def capped_members(members: DataFrame, keys: list[str], order: list[str], cap: int = TRACE_MEMBERS) -> DataFrame:
    """members with members_total and members_shown of their range, the first cap of each (0: all)."""
    w = Window.partitionBy(*keys)
    out = members.withColumns({"members_total": F.count("*").over(w), "__rn": F.row_number().over(w.orderBy(*order))})
    shown = F.least(F.col("members_total"), F.lit(cap)) if cap > 0 else F.col("members_total")
    out = out.withColumn("members_shown", shown.cast("long"))
    return (out.where(F.col("__rn") <= cap) if cap > 0 else out).drop("__rn")


def dominant_axes(axes: DataFrame, keys: list[str]) -> DataFrame:
    """The axes(keys, axis_id, header_row, cols) of a sheet that stay beside its widest one (primary): those wholly before it, with much the same columns, or with a header row or columns of their own."""
    w = Window.partitionBy(*keys)
    width = F.size("cols")
    first = F.min_by(F.struct("axis_id", "header_row", "cols"), F.struct(-width, "header_row", "axis_id")).over(w)
    out = axes.withColumn("__p", first).withColumn("primary", F.col("axis_id") == F.col("__p.axis_id"))
    mine, top = F.col("cols"), F.col("__p.cols")
    both, any_ = F.size(F.array_intersect(mine, top)), F.size(F.array_union(mine, top))
    near = (F.abs(F.array_min(mine) - F.array_min(top)) <= 1) & (F.abs(F.array_max(mine) - F.array_max(top)) <= 1)
    same = near | (both / any_ >= 0.8)
    apart = (both == 0) & ((width >= 3) | (F.least(width, F.size(top)) / F.greatest(width, F.size(top)) >= 0.75))
    keep = F.when(F.col("primary"), True).when(width == 0, False).when(F.array_max(mine) < F.array_min(top), width >= 3).otherwise(same | ((F.col("header_row") != F.col("__p.header_row")) & (width >= 3)) | apart)
    return out.where(keep).drop("__p")


def canonical_timeline(axes: DataFrame, keys: list[str]) -> DataFrame:
    """The first of axes(keys, axis_id, dated, flags, sheet_no, axis_no): with dates, then with most flags, then of the earliest sheet and place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("dated"), F.desc("flags"), "sheet_no", "axis_no")
    return axes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def formula_targets(formula: Column, sheet: Column) -> Column:
    """The A1 targets that a formula names, found without parsing: Sheet!A1 or Sheet!A1:B2, own sheet where none is named, $ kept."""
    text = F.regexp_replace(F.regexp_replace(formula, r'"[^"]*"', ""), r"^=", "")
    corner = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}"
    owner = r"(?:'(?:[^']|'')+'|[A-Za-z_][A-Za-z0-9_.]*)!"
    body = rf"(?:{corner}:{corner}|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?[0-9]{{1,7}}:\$?[0-9]{{1,7}}|{corner})"
    found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_.!'$])(?:{owner})?{body}(?![A-Za-z0-9_.(!])"), F.lit(0))
    return F.transform(found, lambda m: F.when(m.contains("!"), F.regexp_replace(m, r"^'((?:[^']|'')*)'!", "$1!")).otherwise(F.concat(sheet, F.lit("!"), m)))


def range_catalogue(reads: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range, readers, cells): each range of reads(keys, range, reader, ord) once, its readers in order of first reading and its present(keys, range, n) cells."""
    once = reads.groupBy(*keys, "range", "reader").agg(F.min("ord").alias("__o"))
    of = once.groupBy(*keys, "range").agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "reader"))), lambda x: x["reader"]).alias("readers"))
    return of.join(present.select(*keys, "range", F.col("n").alias("cells")), [*keys, "range"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)).cast("long"))


def formula_shape(template: Column) -> Column:
    """struct(kind, up, down): alias, roll, aggregate, diff or ratio of a formula in R1C1 form, with the row steps it names; null for other forms."""
    ref = r"R\[(-?[0-9]+)\]"
    number = lambda rx, k: F.regexp_extract(template, rx, k).cast("int")
    one = lambda kind, rx, rows: F.struct(F.lit(kind).alias("kind"), number(rx, 1).alias("up"), (number(rx, 2) if rows > 1 else F.lit(None).cast("int")).alias("down"))
    roll, alias = rf"^={ref}C\[-1\]$", rf"^=(?:[^!]+!)?{ref}C(?:\[-?[0-9]+\]|[0-9]+)$"
    total, diff = rf"^=SUM\({ref}C\[0\]:{ref}C\[0\]\)$", rf"^={ref}C\[0\]-{ref}C\[0\]$"
    moved = lambda rx: template.rlike(rx) & (number(rx, 1) != 0)
    none = F.struct(F.lit("ratio").alias("kind"), F.lit(None).cast("int").alias("up"), F.lit(None).cast("int").alias("down"))
    return F.when(moved(roll), one("roll", roll, 1)).when(moved(alias), one("alias", alias, 1)).when(template.rlike(total), one("aggregate", total, 2)).when(template.rlike(diff), one("diff", diff, 2)).when(template.rlike(r"^=R\[-?[0-9]+\]C\[0\]/R\[-?[0-9]+\]C\[0\]$"), none)


def row_patterns(cells: DataFrame, keys: list[str], share: float = MAJORITY) -> DataFrame:
    """(keys, kind, template, up, down): the shape of most formulas of a row of cells(keys, col, formula_template), or mixed; the first among equals."""
    rows = cells.where("formula_template is not null").withColumn("__s", formula_shape(F.col("formula_template")))
    by = rows.groupBy(*keys, "formula_template").agg(F.count("*").alias("n"), F.min("col").alias("first"))
    template = by.groupBy(*keys).agg(F.max_by("formula_template", F.struct("n", -F.col("first"))).alias("template"))
    kinds = rows.where("__s is not null").groupBy(*keys, F.col("__s.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("col").alias("first"), F.min_by(F.struct("__s.up", "__s.down"), "col").alias("of"))
    best = kinds.groupBy(*keys).agg(F.sum("n").alias("all"), F.max_by(F.struct("kind", "n", "of"), F.struct("n", -F.col("first"))).alias("b"))
    kind = F.when(F.col("b.n") >= F.greatest(F.lit(1), F.ceil(F.col("all") * share - 1e-9)), F.col("b.kind")).otherwise("mixed")
    best = best.withColumn("kind", kind).select(*keys, "kind", *[F.when(F.col("kind") != "mixed", F.col(f"b.of.{c}")).alias(c) for c in ("up", "down")])
    return template.join(best, keys, "left").select(*keys, "kind", "template", "up", "down")


def row_relations(patterns: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, kind, member): the rows that a row's pattern names (alias, roll_forward, difference) or sums (aggregate); rows(keys, row) are those that exist."""
    known = rows.select(*keys, F.col("row").alias("member")).distinct()
    one = patterns.where("kind in ('alias', 'roll', 'diff')").select(*keys, "row", "kind", F.explode(F.array_compact(F.array("up", "down"))).alias("__d"))
    one = one.withColumn("member", F.col("row") + F.col("__d")).drop("__d").join(known, [*keys, "member"])
    spans = patterns.where("kind = 'aggregate'").select(*keys, "row", "kind", F.explode(F.sequence(F.col("row") + F.col("up"), F.col("row") + F.col("down"))).alias("member")).join(known, [*keys, "member"])
    name = F.create_map(*[F.lit(x) for x in ("alias", "alias", "roll", "roll_forward", "diff", "difference", "aggregate", "aggregate")])
    return one.unionByName(spans).withColumn("kind", name[F.col("kind")]).select(*keys, "row", "kind", "member").distinct()


def label_paths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, row, label, parent_row, section_path) with path: the sections and, if it is not among them, the parent's label."""
    parents = rows.select(*keys, F.col("row").alias("parent_row"), F.col("label").alias("__parent"))
    out = rows.join(parents, [*keys, "parent_row"], "left")
    add = F.col("__parent").isNotNull() & ~F.array_contains("section_path", F.col("__parent"))
    return out.withColumn("path", F.when(add, F.array_append("section_path", F.col("__parent"))).otherwise(F.col("section_path"))).drop("__parent")


def hidden_occupied(hidden: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans): hidden(keys, row) rows that hold a value or a formula, as spans of text."""
    held = hidden.join(cells.where("cached_value is not null or formula_raw is not null").select(*keys, "row").distinct(), [*keys, "row"], "left_semi")
    return held.groupBy(*keys).agg(span_text(F.collect_set("row")).alias("spans"))


def completeness(published: DataFrame, layout: DataFrame, keys: list[str], row: str) -> DataFrame:
    """(keys, published, rows, share): how many of the layout's rows are published."""
    out = layout.select(*keys, row).distinct().join(published.select(*keys, row, F.lit(1).alias("__p")).distinct(), [*keys, row], "left")
    return out.groupBy(*keys).agg(F.count("__p").alias("published"), F.count("*").alias("rows")).withColumn("share", F.col("published") / F.col("rows"))


def flag_key_parts(flags: DataFrame, keys: list[str]) -> DataFrame:
    """flags(keys, row long, base) with what each flag's key is made of: its base, in brackets the key of the flag at place
    (from 0, by row) before of its axis, and tail. Keys are unique on their axis: the base if no other flag has it, else with
    the key of the last flag before that has another base, or else its row; place is the flag's own.

    The flags of one axis (keys) are one task's: keys build on those before. Where all bases are repeated keys nest as deep
    as the axis is long, so only parts are held. A null or empty base is "row n".
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rows = flags.withColumn("base", F.coalesce(F.nullif(F.col("base"), F.lit("")), F.concat(F.lit("row "), F.col("row").cast("string"))))
    schema = StructType([*rows.schema, StructField("place", LongType()), StructField("before", LongType()), StructField("tail", StringType())])

    def run(x: pa.Table) -> pa.Table:
        x = x.sort_by([("row", "ascending")])
        parts = unique_parts(x.column("base").to_pylist(), x.column("row").to_pylist())
        made = pa.array(range(len(parts)), pa.int64()), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.string())
        for name, column in zip(("place", "before", "tail"), made, strict=True):
            x = x.append_column(name, column)
        return x.select(schema.names)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def unique_parts(bases: list[str], at: list[int]) -> list[tuple[str, int | None, str]]:
    """(base, before, tail) of each flag's key; keys are compared by length and hash, then piece by piece."""
    times = Counter(bases)
    parts: list[tuple[str, int | None, str]] = []
    sums: list[tuple[int, int]] = []
    taken: dict[tuple[int, int], list[int]] = {}

    def free(part: tuple[str, int | None, str], total: tuple[int, int]) -> bool:
        return not any(parts[i] == part or same_text(pieces(parts, parts[i]), pieces(parts, part)) for i in taken.get(total, ()))

    before = None  # the place before the present run of equal bases
    for i, (base, row) in enumerate(zip(bases, at, strict=True)):
        if i and bases[i - 1] != base:
            before = i - 1
        inner, tail = (None, "") if times[base] == 1 else (before, "") if before is not None else (None, f" {row}")
        head = text_sum(base) if inner is None else joined(joined(joined(text_sum(base), text_sum(" (")), sums[inner]), text_sum(")"))
        for more in chain(["", f" {row}"], (f" {row} {n}" for n in count(2))):
            part, total = (base, inner, tail + more), joined(head, text_sum(tail + more))
            if free(part, total):
                break
        parts.append(part)
        sums.append(total)
        taken.setdefault(total, []).append(i)
    return parts


HASH_BASE, HASH_MOD = 1_000_003, (1 << 61) - 1


def text_sum(text: str) -> tuple[int, int]:
    """(length, hash) of a text; joined gives those of two texts in a row."""
    h = 0
    for c in text:
        h = (h * HASH_BASE + ord(c) + 1) % HASH_MOD
    return len(text), h


def joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] + b[0], (a[1] * pow(HASH_BASE, b[0], HASH_MOD) + b[1]) % HASH_MOD


def pieces(parts: list[tuple[str, int | None, str]], part: tuple[str, int | None, str]) -> Iterator[str]:
    """The texts that make up a key, from left to right."""
    ends = []
    while part[1] is not None:
        yield from (part[0], " (")
        ends.append(")" + part[2])
        part = parts[part[1]]
    yield from (part[0], part[2])
    yield from reversed(ends)


def same_text(a: Iterator[str], b: Iterator[str]) -> bool:
    return all(x == y for x, y in zip_longest(chain.from_iterable(a), chain.from_iterable(b)))


def flag_keys(flags: DataFrame, keys: list[str]) -> DataFrame:
    """flags(keys, row long, base) with flag_key, the whole text of each flag's key (flag_key_parts).

    Texts grow with the square of an axis whose bases are all repeated: take the parts where an axis is long. One task
    writes the keys of one axis in turn.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    parted = flag_key_parts(flags, keys)
    schema = StructType([*flags.schema, StructField("flag_key", StringType())])

    def run(x: pa.Table) -> pa.Table:
        x = x.sort_by([("place", "ascending")])
        parts = list(zip(*(x.column(c).to_pylist() for c in ("base", "before", "tail")), strict=True))
        return x.append_column("flag_key", pa.array(["".join(pieces(parts, p)) for p in parts], pa.string())).select(schema.names)

    return parted.groupBy(*keys).applyInArrow(run, schema)

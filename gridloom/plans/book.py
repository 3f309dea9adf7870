"""Workbooks from files to answers: cells, layout, formulas, graph, series, and the slices over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import cells as C
from gridloom.operators import formula as G
from gridloom.operators import ranges as R
from gridloom.operators.lookups import labelled, resolve_names
from gridloom.operators.roles import column_roles
from gridloom.operators.switches import orphan_rows, switch_cells, switch_reads
from gridloom.operators.timelines import axis_facts, linked_timelines, with_shared_axes
from gridloom.params import ID_CAP, NOISE, TRACE_MEMBERS, WARNINGS
from gridloom.plans import graph
from gridloom.plans.layout import axis_periods, detect
from gridloom.session import checkpointed
from gridloom.sources.workbook import read_cells, read_workbooks


@dataclass
class Books:
    """The relations of a set of workbooks; every one has book_id."""

    workbooks: DataFrame
    cells: DataFrame
    layout: DataFrame
    periods: DataFrame
    identity: DataFrame
    parsed: DataFrame
    edges: DataFrame
    cell_edges: DataFrame
    index: DataFrame
    enriched: DataFrame
    links: DataFrame
    cycles: DataFrame
    series: DataFrame
    switches: DataFrame

    def observations(self, q: str | None = None, row_keys: list[str] | None = None, period_ids: list[str] | None = None, limit: int = 24, precedent_depth: int = 0) -> DataFrame:
        """Row by period facts with the formula behind each; see grid.observations for the selection.

        With a precedent_depth also precedents, the nodes that each formula reads in so many steps (the ID_CAP nearest,
        with row key, period and label), and precedents_total.
        """
        from gridloom.plans.grid import observations

        out = observations(self.series, row_keys, q, period_ids, limit, ("book_id", "cell", "scenario"))
        out = out.join(self.links.select("book_id", "cell", "formula", "formula_class"), ["book_id", "cell"], "left")
        if precedent_depth <= 0:
            return out
        out = checkpointed(out)
        cells, ranges = self._grid()
        nodes = graph.trace(self.cell_edges, out.select("book_id", F.col("cell").alias("origin")).distinct(), "precedents", precedent_depth, ranges, cells, TRACE_MEMBERS)
        at = self.index.select("book_id", F.col("node_id").alias("node"), "row_key", "period_id")
        nodes = labelled(nodes.where("depth > 0").join(at, ["book_id", "node"], "left"), self.layout.where("row_key is not null"), ["book_id"], "row_key", "label", "row")
        one = F.array_sort(F.collect_list(F.struct("depth", "node", "row_key", "period_id", "label")))
        found = nodes.groupBy("book_id", F.col("origin").alias("cell")).agg(F.slice(one, 1, ID_CAP).alias("precedents"), F.count("*").alias("precedents_total"))
        out = out.join(found, ["book_id", "cell"], "left")
        return out.withColumns({"precedents": F.coalesce("precedents", F.array().cast(found.schema["precedents"].dataType)), "precedents_total": F.coalesce("precedents_total", F.lit(0).cast("long"))})

    def _grid(self) -> tuple[DataFrame, DataFrame]:
        """Cells as nodes with whether they are filled, and the ranges that formulas read."""
        cells = self.cells.select("book_id", "sheet", "row", "col", F.concat("sheet", F.lit("!"), "addr").alias("node"), (F.col("presence") == "populated").alias("filled"))
        return cells, checkpointed(graph.range_nodes(self.cell_edges))

    def catalog(self, q: str | None = None, sheet: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        from gridloom.plans.grid import catalog

        return catalog(self.series, q, sheet, limit, offset)

    def timelines(self) -> DataFrame:
        """(book_id, axis_id, timeline_id): axes of a book with the same years, and dates and flags that fit, share a timeline."""
        populated = self.cells.where("presence = 'populated'")
        return linked_timelines(axis_facts(self.layout, self.periods, populated), ["book_id"])

    def column_roles(self) -> DataFrame:
        """(book_id, sheet, block_id, col, caption, role): what the columns of blocks without periods are for; hidden cells do not count."""
        blocks = self.layout.where("axis_id is null").select("book_id", "sheet", "block_id", "row")
        ends = blocks.groupBy("book_id", "sheet", "block_id").agg(F.min("row").alias("first"))
        seen = shown(self.cells.where("presence = 'populated' and not hidden"))
        # the row of captions above a block's first row is no row of the layout
        heads = ends.where("first > 1").select("book_id", "sheet", "block_id", (F.col("first") - 1).alias("row"))
        return column_roles(seen.join(blocks.unionByName(heads).distinct(), ["book_id", "sheet", "row"]), ["book_id", "sheet", "block_id"])

    def warnings(self, cap: int = WARNINGS) -> DataFrame:
        """(book_id, no, line, total): the first cap warnings of each book; see plans.warnings."""
        from gridloom.plans.warnings import warnings

        return warnings(self, cap)

    def trace(self, origin: str, direction: str = "precedents", depth: int = 8, range_members: int = 0) -> DataFrame:
        """Nodes around a cell (Sheet!A1), a row key or part of a label, by their least depth.

        Each book takes the first of these that it has, or else a blank cell inside a range. range_members bounds
        the filled cells followed from each large range (the reference's default is TRACE_MEMBERS); 0 follows all.
        """
        origin = origin.strip()
        cells, ranges = self._grid()
        ids = self.index.where(F.col("node_id") == origin).select("book_id", "node_id").distinct()
        if "|" in origin:
            rows = self.layout.where(F.col("row_key") == origin)
        else:
            rows = self.layout.where(C.label_contains(F.col("label"), origin))
        rows = rows.select("book_id", "row_key").distinct().join(ids.select("book_id"), "book_id", "left_anti")
        ids = ids.unionByName(self.index.join(rows, ["book_id", "row_key"], "left_semi").select("book_id", "node_id").distinct())
        blank = ranges.select("book_id").distinct().withColumn("node", F.lit(origin)).join(ids.select("book_id"), "book_id", "left_anti")
        blank = graph.covering(blank, ranges, cells).select("book_id", F.col("node").alias("node_id")).distinct()
        ids = ids.unionByName(blank).select("book_id", F.col("node_id").alias("origin"))
        return graph.trace(self.cell_edges, ids, direction, depth, ranges, cells, range_members)

    def labelled_trace(self, origin: str, direction: str = "precedents", depth: int = 8, range_members: int = 0) -> DataFrame:
        """trace with the row key, period and first label of each node (null where it has none)."""
        at = self.index.select("book_id", F.col("node_id").alias("node"), "row_key", "period_id")
        nodes = self.trace(origin, direction, depth, range_members).join(at, ["book_id", "node"], "left")
        return labelled(nodes, self.layout.where("row_key is not null"), ["book_id"], "row_key", "label", "row")

    def trace_stops(self, origin: str, direction: str = "precedents", depth: int = 8) -> DataFrame:
        """How many nodes a trace has, how deep it goes, and why it stops."""
        return graph.trace_stops(self.trace(origin, direction, depth), self.cell_edges, direction, depth)

    def trace_edges(self, origin: str, direction: str = "precedents", depth: int = 8) -> DataFrame:
        """The edges along which trace goes."""
        return graph.trace_edges(self.cell_edges, self.trace(origin, direction, depth), direction, depth)


def build(spark: SparkSession, path: str | list[str]) -> Books:
    """All relations of the workbooks under a path; cells and layout are written once and read by what follows."""
    workbooks = checkpointed(read_workbooks(spark, path))
    cells = checkpointed(read_cells(spark, path))
    populated = cells.where("presence = 'populated'").join(workbooks.select("book_id", "date1904").distinct(), "book_id", "left")
    parsed = checkpointed(G.parse_cells(populated))
    layout = checkpointed(detect(populated.join(parsed.select("book_id", "sheet", "addr", "formula_template"), ["book_id", "sheet", "addr"], "left")))
    facts = axis_facts(layout, axis_periods(layout), populated)
    layout = checkpointed(with_shared_axes(layout, facts))
    switches = checkpointed(switch_cells(switch_reads(parsed, defined(parsed, workbooks)), shown(populated)))
    if not switches.isEmpty():
        layout = checkpointed(layout.unionByName(orphan_rows(switches, layout, shown(populated))))
    periods = checkpointed(axis_periods(layout))
    identity = checkpointed(identities(populated, layout, periods))
    edges = G.formula_edges(parsed)
    if not workbooks.where(F.size("defined_names") > 0).isEmpty():
        edges = checkpointed(with_names(edges, workbooks))
    cell_edges = checkpointed(expand_edges(edges, cells))
    index = graph.index(identity, cell_edges)
    enriched = graph.enrich(cell_edges, index)
    formulas = populated.where("formula_raw is not null").select("book_id", F.concat("sheet", F.lit("!"), "addr").alias("source"), F.col("formula_raw").alias("formula"))
    ranges = checkpointed(graph.range_nodes(cell_edges))
    cycles = graph.cycles(enriched) if ranges.isEmpty() else graph.cycles(enriched, ranges, index)
    return Books(workbooks, cells, layout, periods, identity, parsed, edges, cell_edges, index, enriched, graph.links(formulas, edges, enriched), cycles, checkpointed(series(layout, periods, cells)), switches)


def identities(cells: DataFrame, layout: DataFrame, periods: DataFrame) -> DataFrame:
    """Cells with the row of the layout that they belong to, and their period; lines of vertical axes go down a column."""
    facts = ["row_key", "label", "kind", "axis_id", "block_kind", "unit", "label_col"]
    rows = layout.where("not turned").select("book_id", "sheet", "row", *facts)
    dated = periods.select("book_id", "axis_id", "col", "period_id")
    lines = layout.where("turned").select("book_id", "sheet", F.col("label_col").alias("col"), *[F.col(c).alias(f"__{c}") for c in facts])
    down = lines.join(dated.select("book_id", F.col("axis_id").alias("__axis_id"), F.col("col").alias("row"), F.col("period_id").alias("__period_id")), ["book_id", "__axis_id"])
    at = cells.join(rows, ["book_id", "sheet", "row"], "left").join(dated, ["book_id", "axis_id", "col"], "left")
    at = at.withColumn("row_key", F.when(F.col("period_id").isNotNull() | (F.col("col") != F.col("label_col")), F.col("row_key")))
    at = at.join(down, ["book_id", "sheet", "row", "col"], "left")
    turned = F.col("__row_key").isNotNull()
    return at.withColumns({c: F.when(turned, F.col(f"__{c}")).otherwise(F.col(c)) for c in [*facts, "period_id"]}).drop(*[f"__{c}" for c in [*facts, "period_id"]])


def resolved(wanted: DataFrame, workbooks: DataFrame) -> DataFrame:
    """(book_id, sheet, name, status, means): what wanted(book_id, sheet, name) are defined as, as Sheet!A1, Sheet!A1:B2 or an outer target."""
    names = workbooks.select("book_id", F.posexplode("defined_names").alias("ordinal", "d")).select("book_id", "d.sheet", "d.name", "d.formula", "ordinal")
    found = resolve_names(wanted.select("book_id", "sheet", "name").distinct(), names, ["book_id"]).where("status in ('resolved', 'external')")
    return found.select("book_id", "sheet", "name", "status", F.when(F.col("target").contains("!"), F.regexp_replace("target", "'", "")).otherwise(F.concat("sheet", F.lit("!"), "target")).alias("means"))


def defined(parsed: DataFrame, workbooks: DataFrame) -> DataFrame:
    """What the names that selecting calls take are defined as."""
    return resolved(parsed.select("book_id", "sheet", F.inline("switches")).where("named").withColumnRenamed("target", "name"), workbooks)


def shown(cells: DataFrame) -> DataFrame:
    """Cells with their trimmed text (null where empty) and number."""
    return cells.select("book_id", "sheet", "row", "col", "addr", "formula_raw", F.nullif(F.trim("cached_value"), F.lit("")).alias("text"), C.parse_number(F.col("cached_value")).alias("number"))


def with_names(edges: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Edges whose defined names stand for what they are defined as; a name that does not resolve stays as it is."""
    own = edges.withColumn("sheet", C.split_sheet(F.col("source"))["sheet"]).withColumn("name", F.when(F.col("named"), F.col("target")))
    found = resolved(own.where("named"), workbooks)
    out = own.join(found, ["book_id", "sheet", "name"], "left")
    known = F.col("means").isNotNull()
    other = C.split_sheet(F.col("means"))["sheet"] != F.col("sheet")
    kind = F.when(F.col("status") == "external", "external").when(known & F.col("means").contains(":"), "range").when(known & other, "cross_sheet").otherwise(F.col("kind"))
    return out.select("book_id", "source", kind.alias("kind"), F.coalesce("means", "target").alias("target"), (F.col("unresolved") & ~known).alias("unresolved"), "named", "ord")


def expand_edges(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges to cells: small ranges as their cells, large ones on sheets of the book as one node; with status and whether they dangle."""
    known = cells.where("presence = 'populated'").select("book_id", F.concat("sheet", F.lit("!"), "addr").alias("target"), F.lit(True).alias("known"))
    blank = cells.where("presence <> 'populated'").select("book_id", F.concat("sheet", F.lit("!"), "addr").alias("target"), "presence")
    sheets = cells.select("book_id", "sheet", F.lit(True).alias("sheet_known")).distinct()
    part = C.split_sheet(F.col("target"))
    rows = edges.withColumns({"sheet": part["sheet"], "__r": C.rectangle(part["body"])}).select("book_id", "source", "kind", "target", "unresolved", "ord", "sheet", "__r.*")
    rows = rows.join(sheets, ["book_id", "sheet"], "left")
    ranges = rows.where("kind = 'range' and not unresolved")
    node = R.is_range_node() & F.coalesce("sheet_known", F.lit(False))
    small = R.expand(ranges.where(~node)).select("book_id", "source", "kind", "unresolved", F.col("target").alias("range_ref"), F.concat("sheet", F.lit("!"), C.address(F.col("col"), F.col("row"))).alias("target"), "sheet", "sheet_known", (F.col("ord") * 0).cast("long").alias("ord"), "truncated")
    nodes = ranges.where(node).select("book_id", "source", "kind", "unresolved", F.col("target").alias("range_ref"), "target", "sheet", "sheet_known", F.col("ord").cast("long").alias("ord"), F.lit(False).alias("truncated"))
    single = rows.where("kind <> 'range' or unresolved").select("book_id", "source", "kind", "unresolved", F.lit(None).cast("string").alias("range_ref"), "target", "sheet", "sheet_known", F.col("ord").cast("long").alias("ord"), F.lit(False).alias("truncated"))
    out = small.unionByName(single).join(known, ["book_id", "target"], "left").join(blank, ["book_id", "target"], "left")
    out = out.unionByName(nodes.withColumn("known", F.lit(True)), allowMissingColumns=True)
    status = R.classify_member(F.coalesce("known", F.lit(False)), F.coalesce("sheet_known", F.lit(False)), F.col("presence"), F.col("range_ref").isNotNull(), F.col("unresolved"))
    return out.withColumn("__s", status).select("book_id", "source", "target", "kind", "unresolved", "truncated", "range_ref", "ord", F.col("__s.status").alias("status"), F.col("__s.reason").alias("reason"), F.col("__s.dangling").alias("dangling"))


def series(layout: DataFrame, periods: DataFrame, cells: DataFrame) -> DataFrame:
    """Values by row and period in base units: one row for each row and period of a timeline, with status empty where
    there is no cell, and one for each filled value cell of a block without an axis, whose period_id is its column's
    caption (scenario) or else its address."""
    from gridloom.operators.ordered import noise_floor

    sheets = cells.groupBy("book_id", "sheet").agg(F.min("ordinal").alias("sheet_no"))
    names = ["book_id", "sheet", "row_key", "label", "kind", "axis_id", "unit"]
    null = F.lit(None).cast("string")
    lines = layout.where("axis_id is not null").select(*names, F.col("row").alias("line"), "label_col", "turned").join(periods.select("book_id", "axis_id", F.col("col").alias("at"), "period_id"), ["book_id", "axis_id"])
    turned = lambda c: F.when(F.col("turned"), F.col(c))
    place = C.value_coordinate(turned("label_col"), turned("at"), F.col("at"), F.col("line"))
    grid = lines.select(*names, "period_id", null.alias("scenario"), place["row"].alias("row"), place["col"].alias("col"))
    values = cells.select("book_id", "sheet", "row", "col", "cached_value")
    out = grid.join(values, ["book_id", "sheet", "row", "col"], "left")
    loose = layout.where("axis_id is null").select(*names, "row", "captions", F.explode("value_cols").alias("col"))
    loose = loose.join(values.where("cached_value is not null"), ["book_id", "sheet", "row", "col"]).withColumn("scenario", F.try_element_at("captions", "col"))
    loose = loose.withColumn("period_id", F.coalesce("scenario", C.address(F.col("col"), F.col("row"))))
    out = out.unionByName(loose.select(out.columns)).join(sheets, ["book_id", "sheet"], "left")
    out = out.withColumns({"addr": C.address(F.col("col"), F.col("row")), "status": C.value_status(F.col("cached_value"), ~F.col("kind").isin("abstract", "index")), "scale_factor": C.scale_factor(C.scale_token(F.coalesce("unit", F.lit("unit"))))})
    out = out.withColumn("cell", F.concat("sheet", F.lit("!"), "addr"))
    out = out.withColumn("number", C.normalized_number(F.col("cached_value"), F.col("scale_factor")))
    floored = noise_floor("number", ["book_id", "row_key"], NOISE)
    out = out.withColumn("number", F.when(F.col("axis_id").isNull(), F.col("number")).otherwise(floored)).withColumn("normalized", C.number_text(F.col("number")))
    return out.select("book_id", "sheet", "sheet_no", "row", "col", "addr", "cell", "row_key", "label", "kind", "axis_id", "period_id", "scenario", "unit", "cached_value", "status", "scale_factor", "number", "normalized")


def context_markdown(series_rows: DataFrame) -> str:
    """One Markdown table for each axis: a line for each row, a column for each period."""
    from gridloom.functions.cells import markdown_cell

    rows = series_rows.groupBy("book_id", "axis_id", "row", "row_key", "label").agg(F.array_sort(F.collect_list(F.struct("col", "period_id", F.coalesce(markdown_cell(F.col("cached_value")), F.lit("")).alias("v")))).alias("v"))
    out: list[str] = []
    last = None
    for r in rows.orderBy("book_id", "axis_id", "row").toLocalIterator():
        if (r.book_id, r.axis_id) != last:
            last = (r.book_id, r.axis_id)
            heads = [x.period_id for x in r.v]
            out += ["", f"## {r.axis_id}", "", "| " + " | ".join(["row", "label", *heads]) + " |", "|" + " --- |" * (len(heads) + 2)]
        out.append("| " + " | ".join([str(r.row), r.label or "", *[x.v for x in r.v]]) + " |")
    return "\n".join(out).strip() + "\n"


def markdown_table(rows: DataFrame, title: str, columns: list[str], order: list[str]) -> Iterator[str]:
    """Lines of a Markdown table, one at a time on the driver."""
    yield f"## {title}"
    yield ""
    yield "| " + " | ".join(columns) + " |"
    yield "|" + " --- |" * len(columns)
    cells = [F.coalesce(C.markdown_cell(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]
    for r in rows.orderBy(*order).select(*cells).toLocalIterator():
        yield "| " + " | ".join(r) + " |"


def graph_markdown(books: Books) -> Iterator[str]:
    """The formula graph: edges by kind, cycles, formulas with their class."""
    yield from markdown_table(graph.edge_counters(books.edges), "Edges", ["book_id", "kind", "edges"], ["book_id", "kind"])
    yield ""
    yield from markdown_table(books.cycles.withColumn("members", F.array_join("members", ", ")), "Cycles", ["book_id", "cycle", "class", "members"], ["book_id", "cycle"])
    yield ""
    yield from markdown_table(books.links.withColumn("refs", F.array_join("refs", ", ")), "Formulas", ["book_id", "cell", "formula_class", "refs", "formula"], ["book_id", "cell"])


def trace_markdown(books: Books, origin: str, direction: str = "precedents", depth: int = 8) -> Iterator[str]:
    """A trace: its nodes by depth and the edges between them."""
    yield from markdown_table(books.trace(origin, direction, depth), "Nodes", ["book_id", "node", "depth"], ["book_id", "depth", "node"])
    yield ""
    yield from markdown_table(books.trace_edges(origin, direction, depth), "Edges", ["book_id", "source", "target", "kind"], ["book_id", "depth", "source", "target"])

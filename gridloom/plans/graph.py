"""The formula graph: index, enriched edges, links, counters, cycles, traces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.cells import node_type, rectangle, split_sheet
from gridloom.functions.periods import calendar_lag, formula_class, lag_bits
from gridloom.operators.ordered import capped_ids
from gridloom.operators.ranges import cover, is_whole_axis
from gridloom.params import ID_CAP, TRACE_DEPTH, TRACE_DEPTH_MOST
from gridloom.session import ship


def index(cells: DataFrame, cell_edges: DataFrame) -> DataFrame:
    """Parsed cells and, once each, empty targets that are no parsed cell: book_id, node_id, node_type, row_key, period_id."""
    own = cells.select("book_id", F.concat("sheet", F.lit("!"), "addr").alias("node_id"), node_type(F.col("formula_raw"), F.col("cached_value")).alias("node_type"), "row_key", "period_id")
    empty = cell_edges.where("status = 'empty'").select("book_id", F.col("target").alias("node_id")).distinct()
    empty = empty.join(own, ["book_id", "node_id"], "left_anti")
    return own.unionByName(empty.withColumn("node_type", F.lit("empty")), allowMissingColumns=True)


def enrich(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the lag between the periods of their ends (null where an end has no period)."""
    ends = nodes.select("book_id", "node_id", "period_id")
    out = edges.join(ends.select("book_id", F.col("node_id").alias("source"), F.col("period_id").alias("source_period")), ["book_id", "source"], "left")
    out = out.join(ends.select("book_id", F.col("node_id").alias("target"), F.col("period_id").alias("target_period")), ["book_id", "target"], "left")
    both = F.col("source_period").isNotNull() & F.col("target_period").isNotNull()
    return out.withColumn("period_lag", F.when(both, calendar_lag(F.col("source_period"), F.col("target_period"))))


def links(formulas: DataFrame, refs: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row for each formula: its distinct targets in first-seen order and its class."""
    of = refs.where("target is not null").groupBy("book_id", "source", "target").agg(F.min("ord").alias("o"))
    of = of.groupBy("book_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "target"))), lambda x: x["target"]).alias("refs"))
    bits = enriched.groupBy("book_id", "source").agg(F.bit_or(lag_bits(F.col("period_lag"))).alias("bits"))
    out = formulas.join(of, ["book_id", "source"], "left").join(bits, ["book_id", "source"], "left")
    klass = formula_class(F.col("formula"), F.size(F.coalesce("refs", F.array())) > 0, F.coalesce("bits", F.lit(0)))
    return out.select("book_id", F.col("source").alias("cell"), "formula", klass.alias("formula_class"), F.coalesce("refs", F.array()).alias("refs"))


def edge_counters(edges: DataFrame) -> DataFrame:
    """Edges by kind."""
    return edges.groupBy("book_id", "kind").agg(F.count("*").alias("edges"))


def dangling_ids(edges: DataFrame, cap: int = ID_CAP) -> DataFrame:
    """Distinct dangling targets by reason, the first cap of them and how many there are."""
    return capped_ids(edges.where("dangling"), ["book_id", "reason"], "target", "ord", cap)


def usable(edges: DataFrame) -> DataFrame:
    """Edges that a walk may take: with a target, resolved, not dangling, between cells or ranges of the book (as far as edges have these columns)."""
    out = edges.where("target is not null")
    if "unresolved" in edges.columns:
        out = out.where(~F.coalesce("unresolved", F.lit(False)))
    if "dangling" in edges.columns:
        out = out.where(~F.coalesce("dangling", F.lit(False)))
    return out.where(F.col("kind").isin("ref", "cross_sheet", "range")) if "kind" in edges.columns else out


def range_hops(ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges (book_id, source, target) from ranges(book_id, range, sheet, c1, c2, r1, r2) to the cells(book_id, node, sheet, row, col) inside.

    A range leads to blocks of rows of a column whose sizes are powers of two (at most two of each size), and a
    block to its cells; so many ranges over one column share blocks, and a cell is repeated for each size only.
    """
    key = ["book_id", "sheet"]
    columns = cells.groupBy(*key).agg(F.collect_set("col").alias("__cols"))  # at most as many as a sheet has columns
    ends = f"filter(transform(sequence(0, {ROW_LEVELS}), k -> struct(k AS k, shiftright(r1 - 2 + shiftleft(1L, k), k) AS a, shiftright(r2, k) AS b)), x -> x.a < x.b)"
    blocks = f"flatten(transform({ends}, x -> filter(array(struct(x.k AS k, x.a AS b, x.a % 2 = 1 AS taken), struct(x.k AS k, x.b - 1 AS b, x.b % 2 = 1 AS taken)), y -> y.taken)))"
    parts = ranges.join(columns, key).withColumn("col", F.explode(F.expr("filter(__cols, c -> c between c1 and c2)")))
    parts = parts.select(*key, "range", "col", F.explode(F.expr(blocks)).alias("__b")).select(*key, "range", "col", "__b.k", "__b.b")
    name = F.concat_ws("/", F.concat("sheet", F.lit("!"), F.col("col").cast("string")), F.col("k").cast("string"), F.col("b").cast("string"))
    leads = parts.select("book_id", F.col("range").alias("source"), name.alias("target"))
    at = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ROW_LEVELS)))).withColumn("b", F.expr("shiftright(row - 1, k)"))
    inside = at.join(parts.select(*key, "col", "k", "b").distinct(), [*key, "col", "k", "b"])
    return leads.unionByName(inside.select("book_id", name.alias("source"), F.col("node").alias("target")))


#: Halvings of the rows of a sheet (2^20).
ROW_LEVELS = 20


def placed(nodes: DataFrame) -> DataFrame:
    """nodes(book_id, node, ...) with the sheet, row and col of the cell."""
    part = split_sheet(F.col("node"))
    return nodes.withColumns({"sheet": part["sheet"], "__r": rectangle(part["body"])}).withColumns({"row": F.col("__r.r1"), "col": F.col("__r.c1")}).drop("__r")


def cycles(edges: DataFrame, ranges: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Strongly connected components with two cells or a loop: book_id, cycle (c1..), members, class.

    The graph of one workbook is the unit: it is solved in linear time by one task, workbooks in parallel. Only
    edges between cells that have both an incoming and an outgoing edge are gathered. Targets that are nodes of
    ranges are seen through (range_hops) and are no members; whether they shift the period is asked of each pair
    of a formula and a cell of its range within one component, by the periods in nodes(book_id, node_id, period_id).
    """
    ship(edges.sparkSession)
    all_edges = usable(edges).select("book_id", "source", "target", "period_lag").withColumn("hop", F.lit(False))
    kept = all_edges
    if ranges is not None:
        uses = all_edges.join(ranges.select("book_id", F.col("range").alias("target")), ["book_id", "target"], "left_semi")
        kept = all_edges.join(uses.select("book_id", "target").distinct(), ["book_id", "target"], "left_anti")
        kept = kept.unionByName(uses.withColumn("period_lag", F.lit("hop")))
        cells = placed(all_edges.select("book_id", F.col("source").alias("node")).distinct())
        kept = kept.unionByName(range_hops(ranges, cells).withColumns({"period_lag": F.lit("hop"), "hop": F.lit(True)}))
    into = kept.select("book_id", F.col("target").alias("source")).distinct()
    out_of = kept.select("book_id", F.col("source").alias("target")).distinct()
    for _ in range(2):
        kept = kept.join(into, ["book_id", "source"], "left_semi").join(out_of, ["book_id", "target"], "left_semi")

    def run(x: pa.Table) -> pa.Table:
        names = sorted({*x.column("source").to_pylist(), *x.column("target").to_pylist()})
        at = {n: i for i, n in enumerate(names)}
        nexts: list[list[int]] = [[] for _ in names]
        pairs = [(at[s], at[t], lag) for s, t, lag in zip(*(x.column(c).to_pylist() for c in ("source", "target", "period_lag")), strict=True)]
        for s, t, _ in pairs:
            nexts[s].append(t)
        of = components(nexts)
        size = [0] * len(names)
        for c in of:
            size[c] += 1
        loop = {s for s, t, _ in pairs if s == t}
        keep = {c for i, c in enumerate(of) if size[c] > 1 or i in loop}
        steady = dict.fromkeys(keep, True)
        for s, t, lag in pairs:
            if of[s] == of[t] and of[s] in keep and (lag is None or lag in ("same", "unaligned")):
                steady[of[s]] = False
        passed = {at[s] for s, hop in zip(x.column("source").to_pylist(), x.column("hop").to_pylist(), strict=True) if hop}
        members: dict[int, list[str]] = {}
        for i, c in enumerate(of):
            if c in keep and i not in passed:
                members.setdefault(c, []).append(names[i])
        rows = sorted((sorted(m), c) for c, m in members.items())
        return pa.table({"book_id": pa.array([x.column("book_id")[0].as_py()] * len(rows), pa.string()), "cycle": pa.array([f"c{i + 1}" for i in range(len(rows))], pa.string()), "members": pa.array([m for m, _ in rows], pa.list_(pa.string())), "class": pa.array(["iterative_ok" if steady[c] else "unexpected" for _, c in rows], pa.string())})

    found = kept.groupBy("book_id").applyInArrow(run, "book_id string, cycle string, members array<string>, class string")
    if ranges is None:
        return found
    from gridloom.session import checkpointed

    found = checkpointed(found)
    own = placed(found.select("book_id", "cycle", F.explode("members").alias("node")))
    around = uses.select("book_id", F.col("source").alias("node"), F.col("target").alias("range")).join(own.select("book_id", "cycle", "node"), ["book_id", "node"])
    around = around.select("book_id", "cycle", F.col("node").alias("source"), "range").join(ranges, ["book_id", "range"])
    pairs = cover(own, around, ["book_id", "cycle", "sheet"]).select("book_id", "cycle", "source", F.col("node").alias("target"))
    lag = F.col("period_lag")
    still = enrich(pairs, nodes).where(lag.isNull() | lag.isin("same", "unaligned")).select("book_id", "cycle").distinct().withColumn("still", F.lit(True))
    return found.join(still, ["book_id", "cycle"], "left").select("book_id", "cycle", "members", F.when(F.col("still"), "unexpected").otherwise(F.col("class")).alias("class"))


def components(nexts: list[list[int]]) -> list[int]:
    """The component of each node, by two depth-first passes without recursion (finish order, then the reversed graph)."""
    n = len(nexts)
    seen, finish = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        path = [(root, iter(nexts[root]))]
        while path:
            node, rest = path[-1]
            for t in rest:
                if not seen[t]:
                    seen[t] = True
                    path.append((t, iter(nexts[t])))
                    break
            else:
                finish.append(node)
                path.pop()
    back: list[list[int]] = [[] for _ in range(n)]
    for s, ts in enumerate(nexts):
        for t in ts:
            back[t].append(s)
    of = [-1] * n
    for root in reversed(finish):
        if of[root] < 0:
            of[root] = root
            heap = [root]
            while heap:
                for t in back[heap.pop()]:
                    if of[t] < 0:
                        of[t] = root
                        heap.append(t)
    return of


def trace(edges: DataFrame, origins: DataFrame, direction: str = "precedents", depth: int = TRACE_DEPTH, ranges: DataFrame | None = None, cells: DataFrame | None = None, range_members: int = 0) -> DataFrame:
    """Nodes reached from each origin(book_id, origin) with their least depth, 0 for the origin itself.

    Breadth first: every round joins the frontier with the edges and drops what has been visited; at most
    TRACE_DEPTH_MOST rounds, all origins at once. Each round writes the rows it adds, cut off from their lineage, and none
    of those before. Joins are merges: nothing is broadcast, as each round would send another copy through the driver.

    Targets that are nodes of ranges(book_id, range, sheet, c1, c2, r1, r2) are passed through and never
    listed: precedents go on to their filled cells(book_id, node, sheet, row, col, filled), at most
    range_members of each range, row by row (0 follows all); dependents come from every range around a node.
    """
    from gridloom.session import checkpointed

    depth = max(1, min(TRACE_DEPTH_MOST, depth))
    a, b = ("source", "target") if direction == "precedents" else ("target", "source")
    hops = usable(edges).select("book_id", F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    hops = checkpointed(hops) if depth > 1 else hops
    visited = level = checkpointed(origins.select("book_id", "origin", F.col("origin").alias("node"), F.lit(0).cast("long").alias("depth")))
    for step in range(1, depth + 1):
        frontier = level.select("book_id", "origin", "node")
        if ranges is not None and direction != "precedents":
            frontier = frontier.unionByName(frontier.join(covering(frontier, ranges, cells), ["book_id", "node"]).select("book_id", "origin", F.col("range").alias("node")))
        new = frontier.join(hops.hint("merge"), ["book_id", "node"]).select("book_id", "origin", F.col("next").alias("node")).distinct()
        if ranges is not None and direction == "precedents":
            new = pass_through(new, ranges, cells, range_members)
        level = new.join(visited.select("book_id", "origin", "node").hint("merge"), ["book_id", "origin", "node"], "left_anti").withColumn("depth", F.lit(step).cast("long"))
        if step < depth:
            level = checkpointed(level)
            if level.isEmpty():
                break
        visited = visited.unionByName(level)
    return visited


def trace_edges(edges: DataFrame, visited: DataFrame, direction: str = "precedents", depth: int = TRACE_DEPTH) -> DataFrame:
    """(book_id, origin, source, target, kind, depth): the edges that a trace's visited(book_id, origin, node, depth) went along, an expanded range once as a whole."""
    own = "source" if direction == "precedents" else "target"
    kept = usable(edges)
    whole = F.coalesce("range_ref", "target") if "range_ref" in edges.columns else F.col("target")
    kind = F.col("kind") if "kind" in edges.columns else F.lit("ref")
    kept = kept.select("book_id", "source", "target", whole.alias("shown"), kind.alias("kind"))
    steps = visited.where(F.col("depth") < depth).select("book_id", "origin", F.col("node").alias(own), "depth")
    return kept.join(steps, ["book_id", own]).groupBy("book_id", "origin", "source", F.col("shown").alias("target"), "kind").agg(F.min("depth").alias("depth"))


def range_nodes(edges: DataFrame) -> DataFrame:
    """The ranges that edges keep as one node: book_id, range, sheet, c1, c2, r1, r2."""
    part = split_sheet(F.col("range"))
    out = edges.where("kind = 'range' and not unresolved and target = range_ref").select("book_id", F.col("target").alias("range")).distinct()
    return out.withColumns({"sheet": part["sheet"], "__r": rectangle(part["body"])}).select("book_id", "range", "sheet", "__r.*")


def pass_through(nodes: DataFrame, ranges: DataFrame, cells: DataFrame, range_members: int = 0) -> DataFrame:
    """nodes(book_id, origin, node) with the filled cells of each range in its place."""
    met = ranges.join(nodes.select("book_id", F.col("node").alias("range")).distinct(), ["book_id", "range"], "left_semi")
    members = cover(cells.where("filled"), met, ["book_id", "sheet"])
    if range_members > 0:
        members = members.withColumn("__n", F.row_number().over(Window.partitionBy("book_id", "range").orderBy("row", "col"))).where(F.col("__n") <= range_members)
    members = members.select("book_id", "range", F.col("node").alias("member"))
    plain = nodes.join(ranges.select("book_id", F.col("range").alias("node")), ["book_id", "node"], "left_anti").select("book_id", "origin", "node")
    inside = nodes.withColumnRenamed("node", "range").join(members, ["book_id", "range"]).select("book_id", "origin", F.col("member").alias("node"))
    return plain.unionByName(inside).distinct()


def covering(nodes: DataFrame, ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """(book_id, node, range): the ranges around each node; a whole axis holds only cells that exist, a bounded range its blanks too."""
    part = split_sheet(F.col("node"))
    points = nodes.select("book_id", "node").distinct().withColumns({"sheet": part["sheet"], "__r": rectangle(part["body"])})
    points = points.select("book_id", "node", "sheet", F.col("__r.r1").alias("row"), F.col("__r.c1").alias("col"))
    points = points.join(cells.select("book_id", "node", F.lit(True).alias("exists")).distinct(), ["book_id", "node"], "left")
    return cover(points, ranges, ["book_id", "sheet"]).where(F.col("exists") | ~is_whole_axis()).select("book_id", "node", "range")


def row_adjacency(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each row, itself left out: book_id, row_key, precedents, dependents."""
    pairs = edges.where("source_row is not null and target_row is not null and source_row <> target_row").select("book_id", "source_row", "target_row").distinct()
    before = pairs.groupBy("book_id", F.col("source_row").alias("row_key")).agg(F.array_sort(F.collect_list("target_row")).alias("precedents"))
    after = pairs.groupBy("book_id", F.col("target_row").alias("row_key")).agg(F.array_sort(F.collect_list("source_row")).alias("dependents"))
    return before.join(after, ["book_id", "row_key"], "full_outer")


def trace_stops(nodes: DataFrame, edges: DataFrame, direction: str, depth: int) -> DataFrame:
    """(book_id, origin, nodes, deepest, stop) of traced nodes(book_id, origin, node, depth): depth where a node at the last depth leads on, leaf where only the origin was found, or complete."""
    depth = max(1, min(TRACE_DEPTH_MOST, depth))
    come, go = ("source", "target") if direction == "precedents" else ("target", "source")
    on = usable(edges).where(F.col(come) != F.col(go)).select("book_id", F.col(come).alias("node"), F.lit(True).alias("on")).distinct()
    out = nodes.join(on, ["book_id", "node"], "left")
    left = F.max((F.col("depth") == depth) & F.coalesce("on", F.lit(False)))
    out = out.groupBy("book_id", "origin").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"), left.alias("left"))
    stop = F.when(F.col("left"), "depth").when(F.col("nodes") == 1, "leaf").otherwise("complete")
    return out.select("book_id", "origin", "nodes", "deepest", stop.alias("stop"))

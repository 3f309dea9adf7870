"""Queries on tables whose groups grow with the input: whole results, and work that does not grow faster than they do."""

import random
import re

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F


def plain_flag_keys(bases, at):
    """One key after another, as whole texts."""
    taken, out = set(), []
    for i, (base, row) in enumerate(zip(bases, at, strict=True)):
        before = next((out[j] for j in range(i - 1, -1, -1) if bases[j] != base), None)
        key = base if bases.count(base) == 1 else f"{base} ({before})" if before else f"{base} {row}"
        tries = [key, f"{key} {row}", *(f"{key} {row} {n}" for n in range(2, len(bases) + 2))]
        out.append(next(k for k in tries if k not in taken))
        taken.add(out[-1])
    return out


def test_flag_key_parts_make_the_same_texts():
    from gridloom.operators.facts import pieces, unique_parts

    rng = random.Random(1)
    pool = ["a", "b", "a (b)", "b (a)", "a 3", "a 3 2", "row 4", "row", "b (a) 5", "a (b", "c)", "b (c)"]
    for _ in range(2000):
        bases = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        at = sorted(rng.randint(1, 6) for _ in bases)
        parts = unique_parts(bases, at)
        assert ["".join(pieces(parts, p)) for p in parts] == plain_flag_keys(bases, at)


def test_flag_key_names_of_a_long_brand(spark, tmp_path):
    """All names but one are repeated, so keys nest 40,000 deep; as texts they would take 6 GB."""
    n = 40_000
    name = F.when(F.col("id") == 77, "only").otherwise(F.concat(F.lit("n"), (F.col("id") % 5).cast("string")))
    spark.range(n).select(F.lit("b").alias("p_brand"), F.col("id").alias("p_partkey"), name.alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    out = entry.queries()["flag_key_names"](spark, str(tmp_path))
    assert out.count() == n
    assert [tuple(r) for r in out.where("flag_key is not null").collect()] == [("b", 77, "only")]


def test_cover_joins_tiles_of_the_size_of_rectangles(spark):
    """All of a full sheet's pairs, by a join on sizes and tiles that no side is broadcast for."""
    from gridloom.operators.ranges import cover

    cells = spark.range(600 * 25).select(F.lit("S").alias("sheet"), (F.col("id") % 600 + 1).alias("row"), (F.floor(F.col("id") / 600) + 1).alias("col"))
    k = F.col("id")
    rects = spark.range(400).select("id", F.lit("S").alias("sheet"), (k % 20 + 1).alias("c1"), (k % 20 + 1 + k % 4).alias("c2"), (k % 500 + 1).alias("r1"), (k % 500 + 1 + k % 40).alias("r2"))
    found = cover(cells, rects, ["sheet"])
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "__y" in x]
    assert joins and all("SortMergeJoin" in x and "__h" in x and "__w" in x and "__x" in x for x in joins)
    held = found.groupBy("id").count().join(rects, "id").select((F.col("count") == (F.col("c2") - F.col("c1") + 1) * (F.col("r2") - F.col("r1") + 1)).alias("whole")).collect()
    assert [r["whole"] for r in held] == [True] * 400


def test_equal_rectangles_are_joined_once(spark, tmp_path, monkeypatch):
    """Rectangles that are copies meet the cells once, and count as often as they are; cells and ids as when joined one by one."""
    from gridloom.operators import ranges

    met, cover = [], ranges.cover
    monkeypatch.setattr(ranges, "cover", lambda points, rects, keys: met.append(rects.count()) or cover(points, rects, keys))
    k = F.col("id")
    spark.range(97 * 40).where("id % 97 > 0").select((k % 97 * 4000 + F.floor(k / 97) * 400_000).alias("p_partkey"), F.lit(2).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(25 * 600).select(k.alias("o_orderkey"), F.floor(k / 25).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    part = spark.read.parquet(f"{tmp_path}/part.parquet")
    whole = part.where("p_partkey % 97 = 0").count()
    covers = {(r["row"], r["col"]): r["covers"] for r in entry.queries()["range_cover"](spark, str(tmp_path)).collect()}
    assert covers == {(row, col): 96 * 40 if row == 20 else whole for row in range(1, 601) for col in (1, 2, 3) if row == 20 or whole}
    held = entry.queries()["range_members"](spark, str(tmp_path)).groupBy("members").count().collect()
    assert {r["members"]: r["count"] for r in held} == {n: c for n, c in ((3, 96 * 40 - whole), (1800, whole)) if c}
    assert met == [1 + (whole > 0)] * 2


def test_shared_axes_fold_few_of_many_like_axes(spark):
    """20,000 axes of a sheet that say six different things: as dealt one after another, and only a few are folded."""
    from gridloom.operators import timelines as T

    k = F.col("id")
    marked = (k % 7 == 0) & (k > 50)
    exact = F.when(marked, F.concat(F.lit("c"), (k % 2).cast("string"))).otherwise("c")
    flags = F.when(k % 5 < 2, (k % 5).cast("string"))
    axes = spark.range(20_000).select(F.lit("b").alias("book_id"), F.lit("S").alias("sheet"), F.lit("c").alias("columns"), exact.alias("exact"), marked.alias("marked"), flags.alias("flags"), k.alias("place"), F.concat(F.lit("x"), k.cast("string")).alias("axis_id"))
    rows = [r.asDict() for r in axes.collect()]
    kept, want = [], {}
    for a in rows:
        fits = [x for x in kept if x["flags"] is None or a["flags"] is None or x["flags"] == a["flags"]]
        hit = next((x for x in fits if x["marked"] and not a["marked"]), None) or next((x for x in fits if x["exact"] == a["exact"]), None)
        want[a["axis_id"]] = (hit or a)["axis_id"]
        if hit:
            hit["flags"] = hit["flags"] or a["flags"]
        else:
            kept.append(dict(a))
    out = T.shared_axes(axes, ["book_id", "sheet"])
    assert {r["axis_id"]: r["first"] for r in out.collect()} == want
    assert "__e" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_axes_meet_their_kind_not_their_group(spark, seed):
    """Axes are joined to what their own kind says, so a task need not hold a sheet's axes; as dealt one after another."""
    from gridloom.operators import timelines as T

    pick, axes = random.Random(seed), []
    for i in range(600):
        c, marked = pick.choice("aaaab"), i > 40 * seed and pick.random() < 0.1
        axes.append({"book_id": "b", "sheet": pick.choice("SSST"), "columns": c, "exact": c + (pick.choice("wxyz") if marked else ""), "marked": marked, "flags": pick.choice([None, None, "1", "2", "3"]), "place": i // 2, "axis_id": f"x{i:03}"})
    kept, want = [], {}
    for a in axes:
        fits = [x for x in kept if all(x[c] == a[c] for c in ("sheet", "columns")) and (x["flags"] is None or a["flags"] is None or x["flags"] == a["flags"])]
        hit = next((x for x in fits if x["marked"] and not a["marked"]), None) or next((x for x in fits if x["exact"] == a["exact"]), None)
        want[a["axis_id"]] = (hit or a)["axis_id"]
        if hit:
            hit["flags"] = hit["flags"] or a["flags"]
        else:
            kept.append(dict(a))
    schema = "book_id string, sheet string, columns string, exact string, marked boolean, flags string, place long, axis_id string"
    out = T.shared_axes(spark.createDataFrame(axes, schema), ["book_id", "sheet"])
    assert {r["axis_id"]: r["first"] for r in out.collect()} == want
    joins = re.findall(r"Join \w+, (.*)", out._jdf.queryExecution().optimizedPlan().toString())
    assert joins and all("__k" in on for on in joins)


def test_linked_timelines_of_many_axes(spark):
    """Axes of one signature in two sorts of dates, dealt and named by the best; a later one lends its dates to the first."""
    from gridloom.operators import timelines as T

    k = F.col("id")
    dates = F.when(k % 3 > 0, (k % 3).cast("string"))
    axes = spark.range(9_000).select(F.lit("b").alias("book_id"), F.format_string("%06d", k).alias("axis_id"), k.alias("place"), F.lit(0).alias("sheet_no"), F.lit("s").alias("signature"), dates.alias("dates"), F.lit(None).cast("string").alias("flags"), F.lit(0).alias("n_flags"))
    got = T.linked_timelines(axes, ["book_id"]).groupBy((F.col("axis_id").cast("long") % 3).alias("k"), "timeline_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, "000001", 3000), (1, "000001", 3000), (2, "000002", 3000)]


def test_partitions_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """One join of two sides dealt alike, nothing merged afterwards; known, unknown, repeated and null targets."""
    from gridloom import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    spark.range(100).select((F.col("id") % 25 * 2).alias("l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (0, 1, 2, 2, 3, None)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = entry.queries()["union_empty_targets"](spark, str(tmp_path))
    assert sorted((r["target"] is None, r["target"] or 0, r["kind"]) for r in out.collect()) == [(False, 0, "cell"), (False, 1, "empty"), (False, 2, "cell"), (False, 2, "cell"), (False, 3, "empty"), (True, 0, "empty")]
    assert out.rdd.getNumPartitions() == 10


def test_counting_rows_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    from gridloom import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    k = F.col("id")
    spark.range(80).select(F.floor(k / 4).alias("l_orderkey"), (k % 4 + 1).alias("l_linenumber"), F.lit(1).cast("long").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry.queries()["counting_rows"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(o, 2, 5, 1) for o in range(20)]
    assert out.rdd.getNumPartitions() == 8


def test_traces_broadcast_nothing(spark):
    from gridloom.plans.graph import trace

    edges = spark.createDataFrame([("b", str(k), str(k + 1)) for k in range(9)], "book_id string, source string, target string")
    for direction, want in (("precedents", 9), ("dependents", 0)):
        out = trace(edges, spark.createDataFrame([("b", "0")], "book_id string, origin string"), direction, 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        assert out.count() == min(want, 3) + 1


def test_each_round_of_a_trace_writes_what_it_adds(spark, monkeypatch):
    """Six rounds over a chain write the edges once and six new rows, not one, two, three and so on; the end of a chain ends it."""
    from gridloom import session
    from gridloom.plans.graph import trace

    wrote, checkpointed = [], session.checkpointed
    monkeypatch.setattr(session, "checkpointed", lambda df: wrote.append(df.count()) or checkpointed(df))
    edges = spark.createDataFrame([("b", str(k), str(k + 1)) for k in range(9)], "book_id string, source string, target string")
    start = lambda k: spark.createDataFrame([("b", str(k))], "book_id string, origin string")
    out = trace(edges, start(0), "precedents", 7)
    assert sorted((int(r["node"]), r["depth"]) for r in out.collect()) == [(k, k) for k in range(8)]
    assert sorted(wrote) == [1] * 7 + [9]
    wrote.clear()
    out = trace(edges, start(7), "precedents", 8)
    assert sorted((int(r["node"]), r["depth"]) for r in out.collect()) == [(7, 0), (8, 1), (9, 2)]
    assert sorted(wrote) == [0, 1, 1, 1, 9]


def test_column_roles_look_for_words_once(spark):
    """The words of roles are found before the aggregates, which hold none of their expressions; numbers hold no word."""
    from gridloom.operators.roles import column_roles

    rows = [("s", 0, 1, "Item", None), ("s", 0, 2, "Value", None), *[("s", r, c, str(r) if c == 2 else f"x{r}", float(r) if c == 2 else None) for r in range(1, 5) for c in (1, 2)]]
    out = column_roles(spark.createDataFrame(rows, "k string, row long, col long, text string, number double"), ["k"])
    assert sorted((r["col"], r["caption"], r["role"]) for r in out.collect()) == [(1, "Item", "label"), (2, "Value", "value")]
    assert "наименование показателя" not in out._jdf.queryExecution().optimizedPlan().toString()

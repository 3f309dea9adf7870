"""Period axes from header cells: bands of header rows, one key for each column, runs, relative and vertical axes, markers.

All of it is joins, groups and windows over cells; a fold sees the few rows between two data rows. Relations have
book_id and sheet (KEYS); cells also row, col, shown (text), number (double or null), atom (functions.headers) and
formula_template where formulas matter. Coordinates of vertical axes are swapped on the way in and on the way out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import periods as P
from gridloom.functions.headers import END_LABELS, MARKERS, MONTH_LABELS, QUARTER_LABELS, START_LABELS
from gridloom.operators.facts import dominant_axes
from gridloom.operators.ordered import fill_forward
from gridloom.params import JOIN_GAP, MONTH_STEPS, RUN_LEAST, RUN_LEAST_UNLABELLED, SERIES_NEAR
from gridloom.session import checkpointed

KEYS = ["book_id", "sheet"]
#: Layers of a header row, as bits.
YEAR, DATE, QUARTER, HALF, MONTH, BOUNDS = 1, 2, 4, 8, 16, 32


def header_rows(cells: DataFrame) -> DataFrame:
    """One row for each sheet row: label, layers, and whether it can open a band (starter, banner), names quarters only or distinct years, or ends a band (data)."""
    a = F.col("atom")
    text = F.col("number").isNull() & F.col("shown").isNotNull()
    bare_year = a["kind"].eqNullSafe("full") & F.col("number").isNotNull()
    full, part = a["kind"].eqNullSafe("full"), a["kind"].isin("quarter", "half", "month")
    other = F.col("number").isNotNull() & ~full
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    rows = cells.groupBy(*KEYS, "row").agg(
        F.min_by("shown", F.when(text & a.isNull(), F.col("col"))).alias("label"),
        n(full).alias("full"), n(bare_year).alias("bare"), n(full & a["day"].isNotNull()).alias("dates"), n(full & a["quarter"].isNull() & a["half"].isNull() & a["month"].isNull()).alias("years"),
        n(a["quarter"].isNotNull()).alias("quarters"), n(a["kind"].eqNullSafe("quarter")).alias("tokens"), n(a["half"].isNotNull()).alias("halves"), n(a["month"].isNotNull() & a["day"].isNull()).alias("months"),
        n(other).alias("others"), n(text & a.isNull()).alias("texts"), n(other & F.col("number").between(1, 12) & (F.col("number") == F.floor("number"))).alias("small"),
        F.sort_array(F.collect_list(F.when(bare_year, F.struct("col", a["year"].alias("y")))))["y"].alias("ys"),
        F.min(F.when(bare_year, F.col("col"))).alias("first_year"), F.max(F.when(bare_year, F.col("col"))).alias("last_year"), F.min(F.when(text & a.isNull(), F.col("col"))).alias("first_text"), n(part).alias("parts"),
    )
    low = F.lower(F.trim("label"))
    has = lambda words: F.coalesce(reduce(Column.__or__, [low.contains(w) for w in words]), F.lit(False))
    rows = rows.withColumns({"of_quarters": has(QUARTER_LABELS) & (F.col("small") == F.col("others")) & (F.col("others") >= 2), "of_months": has(MONTH_LABELS) & (F.col("small") == F.col("others")) & (F.col("others") >= 2), "starts": has(START_LABELS), "ends": has(END_LABELS)})
    steps = F.transform(F.sequence(F.lit(1), F.size("ys") - 1), lambda i: F.get("ys", i) - F.get("ys", i - 1))
    steps = F.when(F.size("ys") >= 2, steps).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("steps", steps)
    n_years = F.size("ys")
    # the same years side by side again: n periods of the first p
    copied = lambda p: (n_years % p == 0) & F.forall(F.sequence(F.lit(0), n_years - 1), lambda i: F.get("ys", i) == F.get("ys", i % p)) & F.forall(F.slice("steps", 1, p - 1), lambda s: s > 0)
    copies = (n_years >= 4) & F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(n_years / 2).cast("int"))), copied)
    forward = (n_years >= 2) & (~F.exists("steps", lambda s: s < 0) | copies)
    ruler = (F.size("steps") >= 1) & F.forall("steps", lambda s: s > 0) & (F.size(F.array_distinct("steps")) == 1) & (F.col("last_year") - F.col("first_year") + 1 == F.size("ys"))
    bit = lambda on, b: F.when(on, b).otherwise(0)
    years = (F.col("years") - F.col("bare") >= 1) | ((F.col("bare") > 0) & (F.col("others") == 0) & (forward | (F.col("bare") == 1)))
    out = rows.withColumns(
        {
            "starter": ((F.col("full") >= 2) & ((F.col("bare") < F.col("full")) | (forward & (F.col("others") == 0)))) | ((F.col("full") < 2) & (F.col("tokens") >= RUN_LEAST)),
            "banner": (F.col("bare") >= 1) & (F.col("bare") == F.col("full")) & (F.col("others") == 0) & (F.col("parts") == 0) & ~F.coalesce(F.col("first_text") < F.col("first_year"), F.lit(False)),
            "only_quarters": (F.col("tokens") >= RUN_LEAST) & (F.col("full") == 0),
            "ruler": ruler,
            "layers": bit(years, YEAR) + bit(F.col("dates") >= 1, DATE) + bit((F.col("quarters") >= 2) | F.col("of_quarters"), QUARTER) + bit(F.col("halves") >= 2, HALF) + bit((F.col("months") >= 2) | F.col("of_months"), MONTH) + bit(F.col("starts") | F.col("ends"), BOUNDS),
        }
    )
    counter = (F.col("texts") == 0) & (F.col("full") == 0) & (F.col("parts") == 0)
    data = (F.col("others") > 0) & ~F.col("of_quarters") & ~F.col("of_months") & ~counter & ~F.col("starter")
    out = out.withColumns({"data": data, "skip": counter})
    return out.select(*KEYS, "row", "label", "layers", "starter", "banner", "only_quarters", "ruler", "data", "skip", "of_quarters", "of_months", "starts", "ends")


def header_bands(rows: DataFrame) -> DataFrame:
    """(KEYS, band, row) of header_rows: rows that head the same columns together; band is the first of them.

    A band is opened by a row of periods, or by years right above a row of their parts, and takes the rows below that add
    a layer; a second row of years or dates opens a band of its own, and so do bare quarters under a ruler of years.
    Rows between two data rows are folded in order.
    """
    w = Window.partitionBy(*KEYS).orderBy("row")
    rows = rows.where("not skip").withColumn("island", F.sum(F.when(F.col("data"), 1).otherwise(0)).over(w)).where("layers > 0 or starter or not data")
    fields = ["row", "layers", "starter", "banner", "only_quarters", "ruler", "data"]
    one = rows.groupBy(*KEYS, "island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows")).where(F.exists("rows", lambda r: r["starter"]))
    none = F.lit(None).cast("long")
    start = F.struct(none.alias("band"), F.lit(0).alias("layers"), F.lit(False).alias("quarters"), F.lit(False).alias("ruler"), F.lit(False).alias("waits"), none.alias("last"), F.array().cast("array<struct<band:bigint,row:bigint,starter:boolean>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        both = s["layers"].bitwiseOR(r["layers"])
        again = (s["layers"].bitwiseAND(r["layers"]).bitwiseAND(F.lit(YEAR | DATE)) != 0) & r["starter"] & (both.bitwiseAND(F.lit(BOUNDS)) == 0)
        apart = (s["quarters"] & r["ruler"]) | (s["ruler"] & r["only_quarters"])
        # years that are no header by themselves wait for their parts right below
        parts = (r["row"] - s["last"] <= 2) & (r["layers"].bitwiseAND(F.lit(QUARTER | HALF | MONTH)) != 0)
        joins = s["band"].isNotNull() & (r["layers"] > 0) & ~again & ~apart & (~s["waits"] | parts)
        opens = ~joins & (r["starter"] | r["banner"])
        waits = ~r["starter"]
        band = F.when(joins, s["band"]).when(opens, r["row"].cast("long"))
        state = lambda name, joined, opened: F.when(joins, joined).when(opens, opened).otherwise(start[name]).alias(name)
        out = F.when(band.isNotNull(), F.concat(s["out"], F.array(F.struct(band.alias("band"), r["row"].cast("long").alias("row"), r["starter"].alias("starter"))))).otherwise(s["out"])
        return F.struct(band.alias("band"), state("layers", both, r["layers"]), state("quarters", s["quarters"], r["only_quarters"]), state("ruler", s["ruler"] | r["ruler"], r["ruler"]), state("waits", F.lit(False), waits), r["row"].cast("long").alias("last"), out.alias("out"))

    folded = one.select(*KEYS, F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("b")).select(*KEYS, "b.*")
    return folded.withColumn("head", F.max("starter").over(Window.partitionBy(*KEYS, "band"))).where("head").select(*KEYS, "band", "row")


def composed(cells: DataFrame, bands: DataFrame, rows: DataFrame) -> DataFrame:
    """(KEYS, band, header_row, col, key, kind, variant, text, borrowed, start_date, end_date): the period of each column of a band.

    Parts of one column make a key: a day before a quarter, half, month and year; two years make none. A part without a
    year takes the last year to its left (borrowed). Where rows name both ends of periods the end counts. A merged cell
    counts for all of its columns.
    """
    flags = rows.select(*KEYS, "row", "of_quarters", "of_months", "starts", "ends")
    b = bands.join(flags, [*KEYS, "row"])
    w = Window.partitionBy(*KEYS, "band")
    b = b.withColumns({"header_row": F.max("row").over(w), "both": F.max("starts").over(w) & F.max("ends").over(w)})
    at = cells.join(b, [*KEYS, "row"])
    if "merge_end_col" in cells.columns:
        at = at.withColumn("__to", F.coalesce(F.when(F.col("atom").isNotNull(), F.col("merge_end_col")), F.col("col")))
        at = at.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("__to") - F.col("col")))).withColumn("col", F.col("col") + F.col("own")).drop("__to")
        # a cell of its own counts before one that is spread over it
        at = at.withColumn("__n", F.row_number().over(Window.partitionBy(*KEYS, "band", "row", "col").orderBy("own"))).where("__n = 1").drop("__n", "own")
    small = F.when(F.col("number") == F.floor("number"), F.col("number").cast("int"))
    by = lambda n, label: F.when(F.col(label) & small.between(1, n) & F.col("atom").isNull(), small)
    a = F.col("atom")
    at = at.withColumns({"quarter": F.coalesce(a["quarter"], by(4, "of_quarters")), "month": F.coalesce(F.when(a["day"].isNull(), a["month"]), by(12, "of_months"))})
    at = at.where(F.col("atom").isNotNull() | F.col("quarter").isNotNull() | F.col("month").isNotNull())
    counts = ~(F.col("both") & F.col("starts"))
    first = lambda x, on=None: F.min_by(x, F.when(counts & (x.isNotNull() if on is None else on), F.col("row")))
    date = F.when(a["day"].isNotNull(), a["key"])
    got = at.groupBy(*KEYS, "band", "header_row", "col").agg(
        F.collect_set(F.when(counts, a["year"])).alias("years"), first(a["kind"], a["kind"].isin("total", "stub")).alias("structural"), first(date).alias("date"), first(F.col("quarter")).alias("quarter"),
        first(a["half"]).alias("half"), first(F.col("month")).alias("month"), first(a["key"], a["kind"].eqNullSafe("full")).alias("whole"), first(a["variant"]).alias("variant"),
        F.array_join(F.array_distinct(F.sort_array(F.collect_list(F.when(counts & a.isNotNull(), F.struct("row", "shown"))))["shown"]), " ").alias("text"),
        F.min(F.when(F.col("both") & F.col("starts"), date)).alias("start_date"), F.min(F.when(F.col("both") & F.col("ends"), date)).alias("end_date"),
    )
    got = got.withColumn("own", F.when((F.size("years") == 1) & F.col("structural").isNull(), F.col("years")[0])).withColumn("hint", fill_forward("own", [*KEYS, "band"], ["col"]))
    year = F.coalesce("own", "hint").cast("string")
    part = F.when(F.col("quarter").isNotNull(), F.concat(year, F.lit("Q"), F.col("quarter"))).when(F.col("half").isNotNull(), F.concat(year, F.lit("H"), F.col("half"))).when(F.col("month").isNotNull(), F.concat(year, F.lit("-"), F.lpad(F.col("month").cast("string"), 2, "0")))
    key = F.when(F.size("years") > 1, None).when(F.col("structural").isNotNull(), F.col("structural")).when(F.col("date").isNotNull(), F.col("date")).otherwise(F.coalesce(part, "whole", F.col("own").cast("string")))
    got = got.withColumns({"key": key, "kind": F.coalesce("structural", F.lit("period")), "borrowed": F.col("own").isNull() & F.col("structural").isNull() & F.col("date").isNull()})
    return got.where("key is not null").select(*KEYS, "band", "header_row", "col", "key", "kind", "variant", "text", "borrowed", "start_date", "end_date")


def continues(left: Column, right: Column) -> Column:
    """Whether the right one of two places (periods.period_position) is the period after the left one; days go on after 1, 7 or 14."""
    apart = right["ordinal"] - left["ordinal"]
    return F.coalesce((left["grain"] == right["grain"]) & ((apart == 1) | ((left["grain"] == "day") & apart.isin(7, 14))), F.lit(False))


def key_class(key: Column) -> Column:
    return F.when(key.rlike(r"^\d{4}$"), "year").when(key.rlike(r"^\d{4}-"), "date").when(key.rlike(r"^[YQMP]\d+$"), "relative")


def split_runs(headers: DataFrame, keys: list[str], hidden: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """headers(keys, col, key, variant) with run, the first column of the run that a header is in; runs of one are left out.

    A run ends at a column without a header, unless the columns between are hidden(keys, col) and the periods go on, or at
    most JOIN_GAP of them hold only totals(keys, col) and they do; where years meet dates or relative periods; and where a
    second copy starts: the stretch so far is steady and its opening key comes again, with a stretch of its own after it.
    """
    w = Window.partitionBy(*keys).orderBy("col")
    out = headers if "place" in headers.columns else headers.withColumn("place", P.period_position(F.col("key")))
    out = out.withColumns({"__pc": F.lag("col").over(w), "__pk": F.lag("key").over(w), "__goes_on": F.coalesce(continues(F.lag("place").over(w), F.col("place")), F.lit(False))})
    gap = F.col("col") - F.col("__pc") - 1
    between = out.where("__pc is not null and col - __pc > 1").select(*keys, "col", F.explode(F.sequence(F.col("__pc") + 1, F.col("col") - 1)).alias("c"))
    shut, sums = F.lit(0), F.lit(0)
    for name, some in (("__h", hidden), ("__s", totals)):
        if some is not None:
            n = between.join(some.select(*keys, F.col("col").alias("c")).distinct(), [*keys, "c"]).groupBy(*keys, "col").agg(F.count("*").alias(name))
            out = out.join(n, [*keys, "col"], "left")
            shut, sums = (F.coalesce(name, F.lit(0)), sums) if name == "__h" else (shut, F.coalesce(name, F.lit(0)))
    bridged = (shut == gap) | ((gap <= JOIN_GAP) & (sums > 0) & (sums + shut == gap))
    classes = F.coalesce(key_class(F.col("__pk")) != key_class(F.col("key")), F.lit(False))
    cut = F.col("__pc").isNull() | ((gap > 0) & ~(bridged & F.col("__goes_on"))) | classes
    out = out.withColumn("__island", F.sum(F.when(cut, 1).otherwise(0)).over(w))
    # stretches of an island go on from key to key; its copies are the first stretches, as long as each opens with the same key
    i = Window.partitionBy(*keys, "__island").orderBy("col")
    out = out.withColumn("__stretch", F.sum(F.when(F.col("__goes_on"), 0).otherwise(1)).over(i))
    opens = out.groupBy(*keys, "__island", "__stretch").agg(F.min("col").alias("first"), F.min_by(F.struct("key", F.coalesce("variant", F.lit("")).alias("v")), "col").alias("opening"), F.count("*").alias("n"), *([F.lower(F.min_by("banner", "col")).alias("banner")] if "banner" in headers.columns else []))
    s = Window.partitionBy(*keys, "__island").orderBy("__stretch")
    copy = F.coalesce((F.col("opening") == F.lag("opening").over(s)) & (F.col("n") >= 2) & (F.lag("n").over(s) >= 2), F.lit(False))
    if "banner" in headers.columns:  # halves under two scenarios are one run
        apart = F.col("banner") != F.lag("banner").over(s)
        copy = copy & ~F.coalesce(apart & F.col("banner").isin(*MARKERS) & F.lag("banner").over(s).isin(*MARKERS), F.lit(False))
    opens = opens.withColumn("__copy", copy)
    broken = F.sum(F.when(F.col("__copy") | (F.col("__stretch") == 1), 0).otherwise(1)).over(s)
    opens = opens.withColumn("__run", F.sum(F.when(F.col("__copy") & (broken == 0), 1).otherwise(0)).over(s))
    runs = Window.partitionBy(*keys, "__island", "__run")
    out = out.join(opens.select(*keys, "__island", "__stretch", "__run"), [*keys, "__island", "__stretch"])
    out = out.withColumns({"run": F.min("col").over(runs), "__n": F.count("*").over(runs)}).where("__n >= 2")
    return out.select(*headers.columns, "run")


def marked(periods: DataFrame, keys: list[str]) -> DataFrame:
    """periods(keys, col, key, variant, banner) with the markers that tell equal keys apart appended to them: key@marker.

    Markers of a key count if they differ and stand in blocks (fact fact plan plan) or repeat (fact plan fact plan). Those
    in the header come before those of the banner above; where both count but part the columns differently and no flag row
    (flags, the columns where one changes) confirms one of them, none is written and ambiguous is true.
    """
    flags = F.col("flags") if "flags" in periods.columns else F.array().cast("array<bigint>")
    base = periods.withColumns({"__tail": F.lower(F.coalesce("variant", F.lit(""))), "__banner": F.lower(F.coalesce("banner", F.lit(""))), "__flags": flags})
    w = Window.partitionBy(*keys)
    # a marker that all columns share separates nothing
    base = base.withColumns({c: F.when(F.min(c).over(w) == F.max(c).over(w), "").otherwise(F.col(c)) for c in ("__tail", "__banner")})
    calendar = F.col("key").rlike(r"^\d{4}")
    groups = base.where(calendar).groupBy(*keys, "key").agg(F.sort_array(F.collect_list(F.struct("col", "__tail", "__banner"))).alias("__g")).where(F.size("__g") > 1)

    def counts(tokens: Column) -> Column:
        n = F.size(tokens)
        runs = 1 + F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(tokens, i) != F.get(tokens, i - 1)))
        blocks = runs == F.size(F.array_distinct(tokens))
        cycle = lambda p: (n % p == 0) & (F.size(F.array_distinct(F.slice(tokens, 1, p))) > 1) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get(tokens, i) == F.get(tokens, i % p))
        return (F.size(F.array_distinct(tokens)) > 1) & (blocks | F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))), cycle))

    groups = groups.select(*keys, "key", counts(F.col("__g")["__tail"]).alias("__by_tail"), counts(F.col("__g")["__banner"]).alias("__by_banner"))
    out = base.join(groups, [*keys, "key"], "left")
    out = out.withColumns({"__t": F.when(F.col("__by_tail"), F.col("__tail")), "__b": F.when(F.col("__by_banner"), F.col("__banner"))})
    order = w.orderBy("col")
    edge = lambda c: F.when(F.col(c).isNotNull() & F.lag(c).over(order).isNotNull() & (F.col(c) != F.lag(c).over(order)), F.col("col"))
    out = out.withColumns({"__te": edge("__t"), "__be": edge("__b")})
    out = out.withColumns({"__te": F.array_sort(F.collect_set("__te").over(w)), "__be": F.array_sort(F.collect_set("__be").over(w)), "__has_t": F.max(F.col("__t").isNotNull()).over(w), "__has_b": F.max(F.col("__b").isNotNull()).over(w)})
    conflict = F.col("__has_t") & F.col("__has_b") & (F.col("__te") != F.col("__be"))
    sure = lambda c: (F.size(c) > 0) & (F.size(F.array_except(c, "__flags")) == 0)
    tail, banner = sure("__te") & ~sure("__be"), sure("__be") & ~sure("__te")
    chosen = F.when(~conflict, F.coalesce("__t", "__b")).when(tail, F.col("__t")).when(banner, F.col("__b"))
    out = out.withColumns({"ambiguous": conflict & ~tail & ~banner, "marker": F.nullif(chosen, F.lit(""))})
    return out.withColumn("key", F.when(F.col("marker").isNotNull(), F.concat("key", F.lit("@"), "marker")).otherwise(F.col("key"))).select(*periods.columns, "marker", "ambiguous")


def steady_dates(dates: Column) -> Column:
    """Whether the months between dates in order are all the same step of 1, 3, 6 or 12."""
    months = F.transform(dates, lambda d: F.year(d) * 12 + F.month(d))
    steps = F.transform(F.sequence(F.lit(1), F.size(months) - 1), lambda i: F.get(months, i) - F.get(months, i - 1))
    return (F.size(dates) >= 2) & (F.size(F.array_distinct(steps)) == 1) & F.get(steps, F.lit(0)).isin(*MONTH_STEPS)


def banners(cells: DataFrame, columns: DataFrame, bands: DataFrame) -> DataFrame:
    """columns with banner: the text above a band's first row at or left of a column."""
    tops = bands.groupBy(*KEYS, "band").agg((F.min("row") - 1).alias("row"))
    above = cells.where("shown is not null and number is null").join(tops, [*KEYS, "row"]).select(*KEYS, "band", "col", F.col("shown").alias("__above"))
    first = columns.groupBy(*KEYS, "band").agg(F.min("col").alias("__first"))
    out = columns.join(above.join(first, [*KEYS, "band"]).where("col >= __first").drop("__first"), [*KEYS, "band", "col"], "full")
    out = out.withColumn("banner", fill_forward("__above", [*KEYS, "band"], ["col"])).drop("__above")
    return out.where("key is not null")


def flag_switches(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """(KEYS, band, run, flags): the columns where a row of zeros and ones below a run changes."""
    at = runs.select(*KEYS, "band", "run", "header_row", "col").join(cells.where("number is not null").select(*KEYS, "row", "col", "number"), [*KEYS, "col"]).where("row > header_row")
    w = Window.partitionBy(*KEYS, "band", "run", "row")
    at = at.withColumns({"bits": F.min(F.col("number").isin(0, 1)).over(w), "before": F.lag("number").over(w.orderBy("col"))})
    return at.where("bits and before <> number").groupBy(*KEYS, "band", "run").agg(F.array_sort(F.collect_set("col")).alias("flags"))


def horizontal(cells: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(KEYS, axis_id, header_row, top_row, col, key, text, kind, variant, marker, ambiguous, grain, start_date, end_date) of axes whose periods stand side by side."""
    rows = checkpointed(header_rows(cells))
    bands = checkpointed(header_bands(rows))
    columns = composed(cells, bands, rows).withColumns({"place": P.period_position(F.col("key")), "date": P.key_date(F.col("key"))})
    columns = banners(cells, checkpointed(columns), bands)
    totals = columns.where("kind = 'total'").select(*KEYS, "band", "col")
    shut = None if hidden is None else bands.select(*KEYS, "band").distinct().join(hidden, KEYS)
    runs = checkpointed(split_runs(columns.where("kind <> 'total'"), [*KEYS, "band"], shut, totals))
    of = [*KEYS, "band", "run"]
    n = runs.groupBy(*KEYS, "band").agg(F.count_distinct("run").alias("runs"))
    facts = runs.groupBy(*of).agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "period", F.struct("col", "key"))))["key"].alias("keys"), F.sort_array(F.collect_list(F.when(F.col("kind") == "period", F.struct("col", "date"))))["date"].alias("dates"), F.max("borrowed").alias("any_borrowed"))
    facts = facts.withColumns({"grain": P.infer_grain(F.col("keys")), "steady": steady_dates(F.col("dates"))}).where("steady or not any_borrowed")
    year, d = F.year("date").cast("string"), F.col("date")
    coarse = F.when(F.col("grain") == "year", year).when(F.col("grain") == "half_year", F.concat(year, F.lit("H"), F.ceil(F.month(d) / 6).cast("string"))).when(F.col("grain") == "quarter", F.concat(year, F.lit("Q"), F.quarter(d).cast("string"))).when(F.col("grain") == "month", F.date_format(d, "yyyy-MM"))
    out = runs.join(facts.select(*of, "grain"), of).join(n, [*KEYS, "band"]).withColumn("coarse", F.when(F.col("kind") == "period", coarse))
    one = Window.partitionBy(*of)
    # a coarser key is written only where it keeps all columns apart
    out = out.withColumn("fits", (F.size(F.collect_set("coarse").over(one)) == F.count(F.when(F.col("kind") == "period", 1)).over(one)) & (F.count("coarse").over(one) == F.count(F.when(F.col("kind") == "period", 1)).over(one)))
    out = out.withColumn("key", F.when(F.col("fits"), F.coalesce("coarse", "key")).otherwise(F.col("key")))
    out = out.join(flag_switches(cells, out), of, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<bigint>")))
    out = marked(checkpointed(out), of)
    axis = F.concat("sheet", F.lit("!r"), F.col("header_row").cast("string"), F.when(F.col("runs") > 1, F.concat(F.lit("c"), F.col("run").cast("string"))).otherwise(""))
    return out.select(*KEYS, axis.alias("axis_id"), "header_row", F.col("band").alias("top_row"), "col", "key", "text", "kind", "variant", "marker", "ambiguous", "grain", "start_date", "end_date")


#: Labels of rows that count periods, and the letter of their keys.
RELATIVE = (("year", "Y"), ("год", "Y"), ("month", "M"), ("месяц", "M"), ("quarter", "Q"), ("квартал", "Q"), ("period", "P"), ("период", "P"))


def counting_runs(cells: DataFrame) -> DataFrame:
    """(KEYS, row, first_col, last_col, first_value, n, letter): the longest run of integers that grow by one in adjacent columns of a row, from 0 or 1."""
    whole = cells.where("number = floor(number) and atom is null")
    w = Window.partitionBy(*KEYS, "row", "step").orderBy("col")
    at = whole.withColumn("step", F.col("number") - F.col("col")).withColumn("apart", F.struct("step", F.col("col") - F.row_number().over(w)))
    runs = at.groupBy(*KEYS, "row", "apart").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.min("number").cast("long").alias("first_value"), F.count("*").alias("n"))
    best = runs.groupBy(*KEYS, "row").agg(F.max_by(F.struct("first_col", "last_col", "first_value", "n"), F.struct("n", -F.col("first_col"))).alias("b")).select(*KEYS, "row", "b.*")
    text = cells.where("number is null and shown is not null and atom is null")
    label = text.groupBy(*KEYS, "row").agg(F.min_by("shown", "col").alias("label"))
    low = F.lower(F.trim("label"))
    letter = reduce(lambda x, p: F.when(low.rlike(f"^{p[0]}"), p[1]).otherwise(x), reversed(RELATIVE), F.lit(None).cast("string"))
    return best.where("first_value in (0, 1)").join(label, [*KEYS, "row"], "left").withColumn("letter", letter)


def formula_span(cells: DataFrame) -> DataFrame:
    """(KEYS, cols): the columns of the longest run of equal formula templates in a row of a sheet, RUN_LEAST or more."""
    at = cells.where("formula_template is not null")
    w = Window.partitionBy(*KEYS, "row", "formula_template").orderBy("col")
    runs = at.withColumn("i", F.col("col") - F.row_number().over(w)).groupBy(*KEYS, "row", "formula_template", "i").agg(F.min("col").alias("a"), F.max("col").alias("b"), F.count("*").alias("n")).where(F.col("n") >= RUN_LEAST)
    best = runs.groupBy(*KEYS).agg(F.max_by(F.struct("a", "b"), F.struct("n", -F.col("row"), -F.col("a"))).alias("x"))
    return best.select(*KEYS, F.sequence("x.a", "x.b").alias("cols"))


def same_timeline(a: Column, b: Column) -> Column:
    """Whether two sets of columns are one timeline: both ends within one column, or 0.8 of all columns shared."""
    near = (F.abs(F.array_min(a) - F.array_min(b)) <= 1) & (F.abs(F.array_max(a) - F.array_max(b)) <= 1)
    return near | (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= 0.8)


def relative(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Axes, as of horizontal, from rows that count periods: those with a label from RUN_LEAST on; others from
    RUN_LEAST_UNLABELLED on where formulas run along the same columns and no known axis does."""
    runs = counting_runs(cells).join(known.select(*KEYS, F.explode("rows").alias("row")).distinct(), [*KEYS, "row"], "left_anti")
    runs = runs.withColumn("cols", F.sequence("first_col", "last_col"))
    labelled = runs.where((F.col("letter").isNotNull()) & (F.col("n") >= RUN_LEAST))
    others = runs.where(F.col("letter").isNull() & F.col("label").isNull() & (F.col("n") >= RUN_LEAST_UNLABELLED)).withColumn("letter", F.lit("P"))
    if "formula_template" in cells.columns:
        others = others.join(formula_span(cells).withColumnRenamed("cols", "span"), KEYS).where(same_timeline(F.col("cols"), F.col("span"))).drop("span")
        taken = known.select(*KEYS, F.col("cols").alias("span")).unionByName(labelled.select(*KEYS, F.col("cols").alias("span")))
        rival = others.select(*KEYS, "row", "cols").join(taken, KEYS).where(same_timeline(F.col("cols"), F.col("span"))).select(*KEYS, "row").distinct()
        others = others.join(rival, [*KEYS, "row"], "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("row"))).where("__n = 1").drop("__n")
        labelled = labelled.unionByName(others)
    at = labelled.select(*KEYS, "row", "letter", "first_value", F.posexplode("cols").alias("i", "col"))
    key = F.concat("letter", (F.col("first_value") + F.col("i")).cast("string"))
    null = F.lit(None).cast("string")
    return at.select(*KEYS, F.concat("sheet", F.lit("!r"), F.col("row").cast("string")).alias("axis_id"), F.col("row").alias("header_row"), F.col("row").alias("top_row"), "col", key.alias("key"), (F.col("first_value") + F.col("i")).cast("string").alias("text"), F.lit("relative").alias("kind"), null.alias("variant"), null.alias("marker"), F.lit(False).alias("ambiguous"), null.alias("grain"), null.alias("start_date"), null.alias("end_date"))


def vertical(cells: DataFrame, taken: DataFrame) -> DataFrame:
    """Axes whose periods stand one under another: as of horizontal, but with the period's row in col, and turned.

    RUN_LEAST or more periods of one steady step down a column, outside taken(KEYS, row) header rows, with names of series
    in a row at most SERIES_NEAR above and numbers beside. header_row is the row of the names.
    """
    free = cells.join(taken, [*KEYS, "row"], "left_anti")
    at = free.where(F.col("atom.kind") == "full").select(*KEYS, "row", "col", "shown", F.col("atom.key").alias("key"), P.period_position(F.col("atom.key")).alias("place"), P.key_date(F.col("atom.key")).alias("date"))
    w = Window.partitionBy(*KEYS, "col").orderBy("row")
    at = at.withColumn("run", F.col("row") - F.row_number().over(w))
    of = [*KEYS, "col", "run"]
    runs = at.groupBy(*of).agg(F.min("row").alias("a"), F.max("row").alias("b"), F.sort_array(F.collect_list(F.struct("row", "key", "shown", "place", "date"))).alias("p"))
    place = F.col("p")["place"]
    steps = F.transform(F.sequence(F.lit(1), F.size(place) - 1), lambda i: F.get(place, i)["ordinal"] - F.get(place, i - 1)["ordinal"])
    days = F.get(place, F.lit(0))["grain"] == "day"
    regular = (F.size(F.array_distinct(F.transform(place, lambda x: x["grain"]))) == 1) & F.when(days, steady_dates(F.col("p")["date"])).otherwise((F.size(F.array_distinct(steps)) == 1) & (F.get(steps, F.lit(0)) > 0))
    runs = runs.where(F.size("p") >= RUN_LEAST).where(regular)
    # years among other numbers of the same column are numbers
    beside = cells.select(*KEYS, F.col("row").alias("r"), F.col("col").alias("c"), "number", "shown", "atom", *(["formula_template"] if "formula_template" in cells.columns else []))
    near = runs.join(beside, KEYS)
    inside = near.where((F.col("c") == F.col("col")) & F.col("number").isNotNull() & ((F.col("r") == F.col("a") - 1) | (F.col("r") == F.col("b") + 1))).select(*of).distinct()
    values = near.where((F.col("c") > F.col("col")) & F.col("r").between(F.col("a"), F.col("b")) & F.col("number").isNotNull()).groupBy(*of, "c").agg(F.count("*").alias("n"))
    names = near.where((F.col("c") > F.col("col")) & (F.col("r") < F.col("a")) & (F.col("r") >= F.col("a") - SERIES_NEAR) & F.col("number").isNull() & F.col("shown").isNotNull() & F.col("atom").isNull())
    series = values.join(names.groupBy(*of, "c").agg(F.max("r").alias("name_row")), [*of, "c"])
    good = series.groupBy(*of).agg(F.max("name_row").alias("header_row"))
    runs = runs.join(good, of).join(inside, of, "left_anti")
    null = F.lit(None).cast("string")
    at = runs.select(*KEYS, F.concat("sheet", F.lit("!c"), F.col("col").cast("string"), F.lit("r"), F.col("a").cast("string")).alias("axis_id"), "header_row", F.col("col").alias("top_row"), F.explode("p").alias("p"))
    return at.select(*KEYS, "axis_id", "header_row", "top_row", F.col("p.row").alias("col"), F.col("p.key").alias("key"), F.col("p.shown").alias("text"), F.lit("period").alias("kind"), null.alias("variant"), null.alias("marker"), F.lit(False).alias("ambiguous"), null.alias("grain"), null.alias("start_date"), null.alias("end_date"))


def candidates(cells: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """All axes of horizontal and relative that stay beside the widest of their sheet, and vertical ones, with turned; year rows over finer axes become their group."""
    across = checkpointed(horizontal(cells, hidden))
    known = across.groupBy(*KEYS, "axis_id", "header_row").agg(F.array_sort(F.collect_set("col")).alias("cols"), F.array_distinct(F.array(F.min("top_row"), F.col("header_row"))).alias("rows"))
    across = across.unionByName(relative(cells, known))
    across = checkpointed(folded(checkpointed(across)))
    axes = across.groupBy(*KEYS, "axis_id", "header_row").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    across = across.join(dominant_axes(axes, KEYS).select(*KEYS, "axis_id"), [*KEYS, "axis_id"])
    taken = across.select(*KEYS, F.explode(F.sequence("top_row", "header_row")).alias("row")).distinct()
    down = vertical(cells, taken).withColumn("group_key", F.lit(None).cast("string"))
    return across.withColumn("turned", F.lit(False)).unionByName(down.withColumn("turned", F.lit(True)))


def folded(periods: DataFrame) -> DataFrame:
    """periods with group_key: an axis that repeats years over a finer one of the same columns is that one's group, and no axis."""
    w = Window.partitionBy(*KEYS, "axis_id")
    years = F.count_if(F.col("key").rlike(r"^\d{4}$")).over(w) == F.count("*").over(w)
    repeats = F.size(F.collect_set("key").over(w)) < F.count("*").over(w)
    at = periods.withColumn("__banner", years & repeats)
    top = at.where("__banner").select(*KEYS, F.col("axis_id").alias("__axis"), "col", F.col("key").alias("__year"))
    under = at.where("not __banner").select(*KEYS, "axis_id", "col", F.regexp_extract("key", r"^(\d{4})", 1).alias("own")).join(top, [*KEYS, "col"])
    sizes = at.groupBy(*KEYS, "axis_id").agg(F.count("*").alias("n"))
    met = under.groupBy(*KEYS, "axis_id", "__axis").agg(F.count("*").alias("both"), F.count_if(F.col("own").isin("") | (F.col("own") == F.col("__year"))).alias("agree"))
    met = met.join(sizes, [*KEYS, "axis_id"]).where("both >= 0.8 * n")
    used = met.where("agree > 0").groupBy(*KEYS, "axis_id").agg(F.min("__axis").alias("__axis"))
    gone = met.select(*KEYS, F.col("__axis").alias("axis_id")).distinct()
    group = under.where("own = '' or own = __year").join(used, [*KEYS, "axis_id", "__axis"]).select(*KEYS, "axis_id", "col", F.col("__year").alias("group_key"))
    return at.join(gone, [*KEYS, "axis_id"], "left_anti").join(group, [*KEYS, "axis_id", "col"], "left").drop("__banner")


def body_rows(cells: DataFrame, axes: DataFrame) -> DataFrame:
    """(KEYS, row, axis_id): the axis of axes(KEYS, axis_id, start_row, header_row, cols) that each row below a header belongs to.

    An axis goes on to the header of the next one that covers 0.6 of its columns and is not narrower. A row under several
    axes goes to one that holds all its values, then to the best covered, the lowest and the narrowest.
    """
    a, b = axes.alias("a"), axes.alias("b")
    later = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEYS]).where(F.col("b.start_row") > F.col("a.start_row"))
    later = later.where((F.size(F.array_intersect("a.cols", "b.cols")) >= 0.6 * F.size("a.cols")) & (F.size("b.cols") >= F.size("a.cols")))
    ends = later.groupBy(*[F.col(f"a.{k}").alias(k) for k in KEYS], F.col("a.axis_id").alias("axis_id")).agg(F.min("b.start_row").alias("end_row"))
    spans = axes.join(ends, [*KEYS, "axis_id"], "left")
    rows = cells.where("shown is not null or formula_raw is not null").groupBy(*KEYS, "row").agg(F.collect_set(F.when(F.col("number").isNotNull() | F.col("formula_raw").isNotNull(), F.col("col"))).alias("held"))
    met = rows.join(spans, KEYS).where((F.col("row") > F.col("header_row")) & (F.col("end_row").isNull() | (F.col("row") < F.col("end_row"))))
    covered, outside = F.size(F.array_intersect("held", "cols")), F.size(F.array_except("held", "cols"))
    rank = F.when(F.size("held") == 0, F.struct(F.lit(0).alias("whole"), F.lit(0).alias("fit"), "header_row", F.lit(0).cast("long").alias("narrow"))).otherwise(F.struct(F.when(covered == 0, -1).otherwise((outside == 0).cast("int")).alias("whole"), F.when(covered == 0, -outside).otherwise(covered - outside).alias("fit"), "header_row", (F.array_min("cols") - F.array_max("cols")).alias("narrow")))
    return met.groupBy(*KEYS, "row").agg(F.max_by("axis_id", F.struct(rank, F.hash("axis_id"))).alias("axis_id"))

"""Period keys: positions on a calendar, lags, coarser grains, the grain of a list, formula classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.params import AGGREGATION, CONDITIONAL


def let(value: Column, f) -> Column:
    """f of a value that is computed once (a lambda over an array of one), where f uses it many times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def calendar_key(key: Column) -> Column:
    """A key without its @marker."""
    return F.regexp_replace(key, "@.*$", "")


def _part(key: Column, rx: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(key, rx, group), F.lit("")).cast("int")


def period_position(key: Column) -> Column:
    """struct(grain, ordinal): the place of a key among keys of its grain; null for other keys."""
    return let(calendar_key(key), _position)


def _position(k: Column) -> Column:
    year = _part(k, r"^(\d{4})", 1)
    quarter, half = _part(k, r"^\d{4}Q([1-4])$", 1), _part(k, r"^\d{4}H([12])$", 1)
    month = _part(k, r"^\d{4}-(0[1-9]|1[0-2])$", 1)
    day = F.when(k.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(k, "yyyy-MM-dd"))
    named = F.regexp_extract(k, r"^([YQMP])\d+$", 1)
    number = _part(k, r"^[YQMP](\d+)$", 1)
    words = F.create_map(*[F.lit(x) for x in ("Y", "model_year", "Q", "model_quarter", "M", "model_month", "P", "model_period")])
    at = lambda grain, n: F.struct(F.lit(grain).alias("grain"), n.cast("long").alias("ordinal"))
    return (
        F.when(k.rlike(r"^\d{4}$"), at("year", year))
        .when(half.isNotNull(), at("half_year", year * 2 + half))
        .when(quarter.isNotNull(), at("quarter", year * 4 + quarter))
        .when(month.isNotNull(), at("month", year * 12 + month))
        .when(day.isNotNull(), at("day", F.datediff(day, F.to_date(F.lit("0001-01-01"))) + 1))
        .when(number.isNotNull(), F.struct(words[named].alias("grain"), number.cast("long").alias("ordinal")))
    )


def calendar_lag(source: Column, target: Column) -> Column:
    """same, a signed distance (target less source), or unaligned for other grains and keys without a place."""

    def lag(x: Column) -> Column:
        apart = x["b"]["ordinal"] - x["a"]["ordinal"]
        number = F.when(apart == 0, "same").when(apart > 0, F.concat(F.lit("+"), apart.cast("string"))).otherwise(apart.cast("string"))
        return F.when(x["a"]["grain"] == x["b"]["grain"], number).otherwise("unaligned")

    return let(F.struct(period_position(source).alias("a"), period_position(target).alias("b")), lag)


def key_date(key: Column) -> Column:
    """The first day of a key's period."""
    k = calendar_key(key)
    year = F.regexp_extract(k, r"^(\d{4})", 1)
    month = F.coalesce(_part(k, r"^\d{4}-(\d{2})", 1), _part(k, r"^\d{4}Q([1-4])$", 1) * 3 - 2, _part(k, r"^\d{4}H([12])$", 1) * 6 - 5, F.lit(1))
    day = F.coalesce(_part(k, r"^\d{4}-\d{2}-(\d{2})$", 1), F.lit(1))
    return F.when(k.rlike(r"^\d{4}($|Q|H|-)"), F.try_to_date(F.format_string("%s-%02d-%02d", year, month, day), "yyyy-MM-dd"))


def apply_grain(key: Column, grain: str) -> Column:
    """A key coarsened to year, half_year, quarter or month."""
    d = key_date(key)
    year = F.year(d).cast("string")
    return {
        "year": year,
        "half_year": F.concat(year, F.lit("H"), F.ceil(F.month(d) / 6).cast("string")),
        "quarter": F.concat(year, F.lit("Q"), F.quarter(d).cast("string")),
        "month": F.date_format(d, "yyyy-MM"),
    }[grain]


def infer_grain(keys: Column) -> Column:
    """The grain of an array of keys by the upper median of the steps between their sorted dates."""
    dates = F.array_sort(F.array_distinct(F.filter(F.transform(keys, key_date), lambda d: d.isNotNull())))
    pairs = lambda ds: F.arrays_zip(F.slice(ds, 2, F.size(ds)).alias("b"), F.slice(ds, 1, F.size(ds) - 1).alias("a"))
    step = lambda x: F.struct(F.datediff(x["b"], x["a"]).alias("days"), F.round(F.months_between(x["b"], x["a"])).cast("int").alias("months"))
    quarters = F.exists(keys, lambda k: calendar_key(k).rlike("Q[1-4]$"))

    def of(steps: Column) -> Column:
        days, months = F.array_sort(steps["days"]), F.array_sort(steps["months"])
        middle = F.floor(F.size(steps) / 2).cast("int")
        return let(F.struct(F.get(days, middle).alias("d"), F.get(months, middle).alias("m"), F.array_min(days).alias("low"), F.array_max(days).alias("high"), quarters.alias("q")), grain)

    def grain(x: Column) -> Column:
        d, m = x["d"], x["m"]
        weekly = (x["low"] == 7) & (x["high"] == 7) & ~x["q"]
        return F.when(d.between(5, 9), F.when(weekly, "week")).when(d.between(13, 17), "biweek").when(d.between(25, 35), "month").when(m <= 1, "month").when(m.between(2, 4), "quarter").when(m.between(5, 7), F.when(x["q"], "quarter").otherwise("half_year")).when(m.between(11, 13), "year")

    return let(dates, lambda ds: F.when(F.size(ds) >= 2, let(F.transform(pairs(ds), step), of)))


def period_index(order: Column, axis: Column) -> Column:
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy(axis).orderBy(order)).cast("long")


def lag_bits(lag: Column) -> Column:
    """1 for the period before, 2 for others before, 4 for later ones, 0 otherwise; collected with bit_or."""
    n = F.when(lag.rlike(r"^[+-]?\d+$"), lag.cast("int"))
    return F.coalesce(F.when(n == -1, 1).when(n < 0, 2).when(n > 0, 4), F.lit(0))


def formula_class(formula: Column, has_refs: Column, bits: Column) -> Column:
    """conditional, aggregation, rollforward, cross_period, same_period or hardcoded, in this precedence."""
    text = F.upper(formula)
    names = lambda words: rf"(^|[^A-Z0-9_.])({'|'.join(words)})\("
    rolling = (bits.bitwiseAND(F.lit(1)) == 1) & (bits.bitwiseAND(F.lit(4)) == 0) & (bits.bitwiseAND(F.lit(2)) == 0) & ~text.rlike("[*/]")
    return F.when(text.rlike(names(CONDITIONAL)), "conditional").when(text.rlike(names(AGGREGATION)), "aggregation").when(rolling, "rollforward").when(bits > 0, "cross_period").when(has_refs, "same_period").otherwise("hardcoded")

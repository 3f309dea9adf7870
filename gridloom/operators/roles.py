"""What the columns of a sheet are for: label, value, unit, note, index or unknown, by their contents and header words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import scale_token, unit_kind
from gridloom.functions.headers import period_like
from gridloom.params import NOTE_LEAST, QUALIFIER_LETTERS, QUALIFIERS, ROLE_SHARE, ROLE_WORDS, VALUES_LEAST
from gridloom.session import checkpointed


def header_role(text: Column) -> Column:
    """The role that a caption names: by the whole of it, or by its first word before at most QUALIFIERS short ones."""
    words = F.split(F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{Nd}]+", " ")), " ")
    of = F.create_map(*[F.lit(x) for role, known in ROLE_WORDS.items() for w in known for x in (w, role)])
    rest = F.slice(words, 2, QUALIFIERS + 1)
    short = (F.size(rest) <= QUALIFIERS) & F.forall(rest, lambda w: F.length(w) <= QUALIFIER_LETTERS)
    return F.coalesce(F.try_element_at(of, F.array_join(words, " ")), F.when(short, F.try_element_at(of, F.get(words, F.lit(0)))))


def is_unit(text: Column) -> Column:
    return (F.length(text) <= NOTE_LEAST) & (unit_kind(text).isNotNull() | (scale_token(text) != "unit"))


def column_roles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, caption, role) of cells(keys, row, col, text, number): columns with numbers, captions or words of a role.

    The caption is a column's first text; what stands below decides if ROLE_SHARE of it is of one sort: at least
    VALUES_LEAST numbers, or two units or long notes. A column of numbers under a period is unknown, not value. Units and
    notes yield to a label word. Words decide for the rest, the most frequent first, then the first seen; texts beside
    such words are unknown. One pass gathers counts by column.
    """
    at = cells.where("text is not null")
    # words are of letters alone, and few texts are one: found once
    named = checkpointed(at.where(F.col("text").rlike(r"\p{L}")).select(*keys, "row", "col", header_role(F.col("text")).alias("word")).where("word is not null"))
    words = named.groupBy(*keys, "col", "word").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    hints = words.groupBy(*keys, "col").agg(F.max_by("word", F.struct("n", -F.col("row"))).alias("hint"))
    caption = at.where("number is null").groupBy(*keys, "col").agg(F.min_by("text", "row").alias("caption"), F.min("row").alias("caption_row"))
    at = at.join(caption, [*keys, "col"], "left")
    is_number = F.col("number").isNotNull()
    unit = ~is_number & is_unit(F.col("text"))
    note = ~is_number & ~unit & F.col("text").contains(" ") & (F.length("text") >= NOTE_LEAST)
    body = F.col("row") > F.col("caption_row")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = at.groupBy(*keys, "col").agg(F.first("caption").alias("caption"), F.first("caption_row").alias("caption_row"), n(is_number).alias("numbers"), n(body).alias("below"), n(body & is_number).alias("b_numbers"), n(body & unit).alias("b_units"), n(body & note).alias("b_notes"))
    beside = at.where("number is null").join(named.select(*keys, "row").distinct(), [*keys, "row"], "left_semi").groupBy(*keys, "col").agg(F.max(F.length("text") <= NOTE_LEAST).alias("beside"))
    out = sums.join(hints, [*keys, "col"], "left").join(beside, [*keys, "col"], "left")
    share = lambda c: F.col(c) >= ROLE_SHARE * F.col("below")
    value = F.when(period_like(F.col("caption")), "unknown").otherwise("value")
    labelled = F.coalesce(F.col("hint") == "label", F.lit(False))
    role = (
        F.when(F.col("caption").rlike(r"(?i)^\s*(№(\s*п\s*/\s*п)?|#|no\.?)\s*$"), "index")
        .when((F.col("below") >= 2) & (F.col("b_numbers") >= VALUES_LEAST) & share("b_numbers"), value)
        .when((F.col("b_units") >= 2) & share("b_units") & ~labelled, "unit")
        .when((F.col("b_notes") >= 2) & share("b_notes") & ~labelled, "note")
        .when((F.col("numbers") >= VALUES_LEAST) & ~F.coalesce(F.col("hint").isin("label", "note", "unit"), F.lit(False)), value)
        .otherwise(F.coalesce("hint", F.when(F.col("beside"), "unknown")))
    )
    return out.withColumn("role", role).where("role is not null").select(*keys, "col", "caption", "role")

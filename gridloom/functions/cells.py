"""Column expressions over cells: addresses, numbers, dates, statuses, units. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.params import CURRENCY_SIGNS, GRID_COLUMNS, GRID_ROWS, SCALES, SERIAL_MOST, SERIES_KINDS, STRUCTURAL_KEYS, VALUE_BLOCKS

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def column_letters(n: Column) -> Column:
    """Letters of a 1-based column index; null outside the grid."""
    n = n.cast("int")
    second = F.floor((n - 1) / 26).cast("int")
    first = F.floor((second - 1) / 26).cast("int")
    text = F.concat(F.when(n > 702, F.char(64 + first)).otherwise(""), F.when(n > 26, F.char(65 + F.pmod(second - 1, F.lit(26)))).otherwise(""), F.char(65 + F.pmod(n - 1, F.lit(26))))
    return F.when((n >= 1) & (n <= GRID_COLUMNS), text)


def column_index(letters: Column) -> Column:
    """1-based index of column letters ($ allowed); null outside the grid."""
    bare = F.upper(F.regexp_replace(letters, r"\$", ""))
    n = F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.when(bare.rlike("^[A-Z]{1,3}$") & (n <= GRID_COLUMNS), n)


def address(col: Column, row: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def parse_address(addr: Column) -> Column:
    """struct(col, row) of A1 text; null if it is no address of the grid."""
    bare = F.upper(F.regexp_replace(addr, r"\$", ""))
    col, row = column_index(F.regexp_extract(bare, "^([A-Z]+)", 1)), F.try_to_number(F.regexp_extract(bare, r"([0-9]+)$", 1), F.lit("9999999999")).cast("long")
    return F.when(bare.rlike("^[A-Z]{1,3}[0-9]{1,7}$") & col.isNotNull() & row.between(1, GRID_ROWS), F.struct(col.alias("col"), row.alias("row")))


def is_derived_address(addr: Column, col: Column, row: Column) -> Column:
    return addr == address(col, row)


def value_coordinate(value_col: Column, period_row: Column, period_col: Column, line_row: Column) -> Column:
    """Where a value stands: turned blocks give (value column, period row), others (period column, line row)."""
    turned = value_col.isNotNull() & period_row.isNotNull()
    return F.struct(F.when(turned, value_col).otherwise(period_col).alias("col"), F.when(turned, period_row).otherwise(line_row).alias("row"))


def node_id(sheet: Column, addr: Column) -> Column:
    return F.concat(sheet, F.lit("!"), F.upper(F.regexp_replace(addr, r"\$", "")))


def split_sheet(target: Column) -> Column:
    """struct(sheet, body) of a reference; a quoted sheet doubles its apostrophes."""
    quoted = target.startswith("'")
    sheet = F.when(quoted, F.regexp_replace(F.regexp_extract(target, r"^'((?:[^']|'')*)'!", 1), "''", "'")).otherwise(F.regexp_extract(target, "^([^!]*)!", 1))
    body = F.when(quoted, F.regexp_extract(target, r"^'(?:[^']|'')*'!(.*)$", 1)).otherwise(F.regexp_replace(target, "^[^!]*!", ""))
    return F.struct(F.when(target.contains("!"), sheet).alias("sheet"), body.alias("body"))


def rectangle(body: Column) -> Column:
    """struct(c1, c2, r1, r2) of A1, A1:B2, A:C or 3:5 with any $; whole axes reach the bounds of the grid."""
    bare = F.upper(F.regexp_replace(body, r"\$", ""))
    one, two = F.get(F.split(bare, ":"), F.lit(0)), F.get(F.split(bare, ":"), F.lit(1))
    two = F.coalesce(two, one)
    c1, c2 = column_index(F.regexp_extract(one, "^([A-Z]*)", 1)), column_index(F.regexp_extract(two, "^([A-Z]*)", 1))
    digits = lambda x: F.expr("null") if x is None else F.nullif(F.regexp_extract(x, "([0-9]*)$", 1), F.lit("")).cast("long")
    r1, r2 = digits(one), digits(two)
    ok = bare.rlike("^([A-Z]{1,3}[0-9]{1,7}(:[A-Z]{1,3}[0-9]{1,7})?|[A-Z]{1,3}:[A-Z]{1,3}|[0-9]{1,7}:[0-9]{1,7})$")
    low, high = lambda a, b, end: F.coalesce(F.least(a, b), F.lit(1)), lambda a, b, end: F.coalesce(F.greatest(a, b), F.lit(end))
    return F.when(ok, F.struct(low(c1, c2, 0).cast("long").alias("c1"), high(c1, c2, GRID_COLUMNS).cast("long").alias("c2"), low(r1, r2, 0).cast("long").alias("r1"), high(r1, r2, GRID_ROWS).cast("long").alias("r2")))


def parse_number(text: Column) -> Column:
    """A double; spaces of three kinds go, a comma is a decimal point; inf, nan, underscores and overflow are null."""
    bare = F.regexp_replace(F.regexp_replace(text, "[ \\u00A0\\u202F]", ""), ",", ".")
    number = F.when(bare.rlike(NUMBER), bare.cast("double"))
    return F.when(F.abs(number) <= 1.7976931348623157e308, number)


def value_status(text: Column, applicable: Column) -> Column:
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank & ~applicable, "not_applicable").when(blank, "empty").when(parse_number(text) == 0, "zero_explicit").otherwise("cached")


def scale_factor(token: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])[token].cast("long")


def number_text(x: Column) -> Column:
    """A number as text: whole numbers without a point, others with at most ten decimals and no trailing zeros."""
    near = F.round(x, 0)
    whole = F.abs(x - near) < 1e-9
    return F.when(whole, near.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", ""))


def normalized_number(text: Column, factor: Column) -> Column:
    """The value in base units as a double; a trailing % goes without division."""
    return parse_number(F.regexp_replace(F.trim(text), r"\s*%$", "")) * factor


def normalize_value(text: Column, factor: Column) -> Column:
    return number_text(normalized_number(text, factor))


def is_date_format(fmt: Column) -> Column:
    """Whether a number format shows dates: y or d, or m without h and s, outside quotes, brackets and escapes."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(fmt, r"\\.", ""), r'"[^"]*"', ""), r"\[[^\]]*\]", ""))
    return F.coalesce(bare.rlike("[yd]") | (bare.rlike("m") & ~bare.rlike("[hs]")), F.lit(False)) & (bare != "general")


def serial_to_date(serial: Column, date1904: bool = False) -> Column:
    """The date of a serial number; the 1900 system has no day 60 and counts from a day later before it."""
    day = F.floor(serial).cast("int")
    if date1904:
        return F.when(day.between(0, SERIAL_MOST), F.date_add(F.to_date(F.lit("1904-01-01")), day))
    return F.when(day == 60, F.lit(None).cast("date")).when(day.between(1, 59), F.date_add(F.to_date(F.lit("1899-12-31")), day)).when(day.between(61, SERIAL_MOST), F.date_add(F.to_date(F.lit("1899-12-30")), day))


def date_to_serial(date: Column) -> Column:
    n = F.datediff(date, F.to_date(F.lit("1899-12-30")))
    return F.when(n > 60, n).when(n >= 1, n - 1)


def display_text(value: Column, fmt: Column, date1904: bool = False) -> Column:
    """What a cell shows for header detection: dd.MM.yyyy for serials under a date format; blank is null."""
    shown = F.date_format(serial_to_date(parse_number(value), date1904), "dd.MM.yyyy")
    return F.when(is_date_format(fmt) & shown.isNotNull(), shown).otherwise(F.nullif(F.trim(value), F.lit("")))


def node_type(formula: Column, value: Column) -> Column:
    return F.when(F.coalesce(formula, F.lit("")) != "", "calculated").when(F.coalesce(value, F.lit("")) != "", "input").otherwise("empty")


#: Currency signs and words in the order in which they are tried, as patterns of the shared regex subset.
CURRENCIES = (("£|pounds? sterling", "GBP"), ("€|euros?", "EUR"), ("₽|rub\\.|rubles?|roubles?", "RUB"), ("\\$|dollars?", "USD"), ("¥", "JPY"), ("₸|tenge", "KZT"))
CODES = ("GBP", "EUR", "RUB", "RUR", "USD", "JPY", "CNY", "CHF", "KZT")


def currency_code(text: Column) -> Column:
    """The currency a text names: signs and words first, then a code after a scale letter or alone; RUR is RUB."""
    out = F.lit(None).cast("string")
    for code in reversed(CODES):
        out = F.when(F.lower(text).rlike(f"(^|[^a-z])([kmb]|mn|bn)?{code.lower()}($|[^a-z])"), F.lit("RUB" if code == "RUR" else code)).otherwise(out)
    for rx, code in reversed(CURRENCIES):
        out = F.when(F.lower(text).rlike(rx), F.lit(code)).otherwise(out)
    return out


def scale_token(text: Column) -> Column:
    """bn, m or k as a unit text names it, in that priority; unit otherwise."""
    low = F.lower(text)
    return F.when(low.rlike("(^|[^a-z])(bn|billions?)($|[^a-z])"), "bn").when(low.rlike("(^|[^a-z])(m|mn|mln|millions?)($|[^a-z])"), "m").when(low.rlike("(^|[^a-z])(k|thousands?|'?000s?)($|[^a-z0-9])"), "k").otherwise("unit")


def unit_kind(text: Column) -> Column:
    """ratio, count, rate, date, years or money as a unit text names it."""
    low = F.trim(F.lower(text))
    return F.when(low.rlike("%|percent"), "ratio").when(low.rlike("(^|[^a-z])(years?|yrs?)($|[^a-z])"), "years").when(low.rlike("(^|[^a-z])date($|[^a-z])"), "date").when(low.rlike("(^|[^a-z])(per|rate)($|[^a-z])"), "rate").when(currency_code(text).isNotNull(), "money").when(low.rlike("(^|[^a-z])(count|number|units?|pcs|#)($|[^a-z])"), "count")


def normalize_label(label: Column) -> Column:
    """A label for comparison: lower case, punctuation to spaces, cash flow as one word."""
    low = F.regexp_replace(F.translate(F.lower(label), "ё", "е"), r"[^0-9a-zа-я&%]+", " ")
    return F.trim(F.regexp_replace(low, r"\bcash flow", "cashflow"))


def label_contains(label: Column, needle: str) -> Column:
    """Whether a label holds a trimmed needle, whatever the case; an empty needle holds nowhere."""
    bare = needle.strip().lower()
    return F.coalesce(F.lower(label).contains(bare), F.lit(False)) if bare else F.lit(False)


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\r?\n", " ")


def unit_display(unit: Column, currency: Column, scale: Column, per: Column) -> Column:
    """How a unit is shown: %, years, count, x, date; a scale letter with a currency sign for money, over something for prices."""
    signs = F.create_map(*[F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair])
    money = F.nullif(F.concat(F.coalesce(F.nullif(scale, F.lit("unit")), F.lit("")), F.coalesce(signs[currency], F.lit(""))), F.lit(""))
    plain = F.create_map(*[F.lit(x) for x in ("rate", "%", "years", "years", "count", "count", "ratio", "x", "date", "date")])
    out = F.when(unit == "price", F.concat(F.coalesce(money, F.lit("money")), F.lit("/"), F.coalesce(per, F.lit("unit")))).when(unit == "money", F.coalesce(money, F.lit("money")))
    return out.otherwise(F.coalesce(plain[unit], F.lit("")))


def displayed_number(value: Column, fmt: Column) -> Column:
    """The digits that a simple number format shows (0, 0.00, #,##0.0, 0%); null for other formats and texts."""
    token = F.regexp_replace(F.element_at(F.split(fmt, ";", 2), 1), r'\[[^\]]*\]|"[^"]*"|\\.|[*_]', "")
    number = parse_number(value) * F.when(token.contains("%"), 100).otherwise(1)
    token = F.regexp_replace(token, "[%,]", "")
    decimals = F.length(F.regexp_replace(F.coalesce(F.get(F.split(token, r"\.", 2), F.lit(1)), F.lit("")), "[^0#]", ""))
    whole = [F.format_string(f"%.{d}f", number) for d in range(10)]
    shown = F.get(F.array(*whole), F.least(decimals, F.lit(9)))
    return F.when(number.isNotNull() & token.rlike("[0#]"), shown)


def chart_note(sheet: Column) -> Column:
    """A note for sheets that are copies in charts or dashboards; null for others."""
    return F.when(F.trim(sheet).rlike(r"(?iu)^(charts?|графики|диаграммы?|dashboards?|дашборды?)\s*\d*$"), F.concat(F.lit("Sheet "), sheet, F.lit(" is a chart copy, not a calculation")))


def is_value_block(kind: Column) -> Column:
    """Whether a block publishes value columns and no period axis."""
    return F.coalesce(kind.isin(*VALUE_BLOCKS), F.lit(False))


def is_series_column(kind: Column, period_key: Column) -> Column:
    """Whether a column is a timeline's value column, no total and no stub."""
    return F.coalesce(kind.isin(*SERIES_KINDS) & ~period_key.isin(*STRUCTURAL_KEYS), F.lit(False))

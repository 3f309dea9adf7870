"""Period headers: spellings of calendar periods, English and Russian, as keys.

Grammar in Python for the worker; columns classify their distinct texts once and join the result back.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import ship

#: Stems of month names, by month.
MONTHS = {
    1: ("jan", "янв"), 2: ("feb", "фев"), 3: ("mar", "мар"), 4: ("apr", "апр"), 5: ("may", "май", "мая"), 6: ("jun", "июн"),
    7: ("jul", "июл"), 8: ("aug", "авг"), 9: ("sep", "сен"), 10: ("oct", "окт"), 11: ("nov", "ноя"), 12: ("dec", "дек"),
}
#: Words of headers that are no period but a total or a part of one.
TOTALS = ("total", "итого", "всего")
STUBS = ("stub", "partial", "частичный")
#: Words beside a period that tell its version apart, and words for whole months.
MARKERS = ("actual", "budget", "forecast", "plan", "estimate", "fact", "факт", "план", "прогноз", "бюджет", "оценка", "отчет")
MONTH_NAMES = {
    1: ("january", "январь"), 2: ("february", "февраль", "февр"), 3: ("march", "март"), 4: ("april", "апрель"), 5: ("may", "май"), 6: ("june", "июнь"),
    7: ("july", "июль"), 8: ("august", "август"), 9: ("september", "sept", "сентябрь", "сент"), 10: ("october", "октябрь"), 11: ("november", "ноябрь", "нояб"), 12: ("december", "декабрь"),
}
#: Words in the label of a header row that say what its numbers or dates are.
QUARTER_LABELS = ("quarter", "quarterly", "квартал", "квартальный")
MONTH_LABELS = ("month", "месяц")
START_LABELS = ("period start", "start of period", "начало периода", "начала периода")
END_LABELS = ("period end", "end of period", "конец периода", "конца периода")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4}
_YEAR = r"(?:20\d\d|19\d\d)"
_SHORT = rf"(?:{_YEAR}|\d\d)"


def normalize(text: str) -> str:
    """NFKC, lower case, ё as е, one space between words."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower().replace("ё", "е")).strip(" \t.,:;")


def full(year: str) -> int:
    return int(year) if len(year) == 4 else 2000 + int(year)


def _date(y: int, m: int, d: int) -> str | None:
    try:
        return date(y, m, d).isoformat()
    except ValueError:
        return None


def month_of(word: str) -> int | None:
    return next((m for m, stems in MONTHS.items() if word.startswith(stems)), None)


#: Each spelling with how its key is made, in the order in which they are tried.
FORMS = (
    (re.compile(r"(\d{4})-(\d\d)-(\d\d)"), lambda m: _date(int(m[1]), int(m[2]), int(m[3]))),
    (re.compile(r"(\d{1,2})[./](\d{1,2})[./](\d{4}|\d\d)"), lambda m: _date(full(m[3]), int(m[2]), int(m[1]))),
    (re.compile(r"(\d{4})-(0[1-9]|1[0-2])"), lambda m: f"{m[1]}-{m[2]}"),
    (re.compile(rf"(0?[1-9]|1[0-2])[./]({_YEAR})"), lambda m: f"{m[2]}-{int(m[1]):02d}"),
    (re.compile(rf"([a-zа-я]{{3,9}})[ .'/-]*({_SHORT})"), lambda m: f"{full(m[2])}-{month_of(m[1]):02d}" if month_of(m[1]) else None),
    (re.compile(rf"(?:q([1-4])|([1-4])q)[ '/-]*({_SHORT})"), lambda m: f"{full(m[3])}Q{m[1] or m[2]}"),
    (re.compile(rf"([1-4]|i{{1,3}}|iv)[ -]*(?:кв(?:артал)?\.?)[ .]*({_SHORT})(?: ?г(?:од)?\.?)?"), lambda m: f"{full(m[2])}Q{_ROMAN.get(m[1], m[1])}"),
    (re.compile(rf"кв\.? ?([1-4])[ .]*({_SHORT})"), lambda m: f"{full(m[2])}Q{m[1]}"),
    (re.compile(rf"({_YEAR})[ -]?q([1-4])"), lambda m: f"{m[1]}Q{m[2]}"),
    (re.compile(rf"({_YEAR})[ -]?h([12])"), lambda m: f"{m[1]}H{m[2]}"),
    (re.compile(rf"(?:h([12])|([12])[hп])[ '/-]*({_SHORT})"), lambda m: f"{full(m[3])}H{m[1] or m[2]}"),
    (re.compile(rf"([12]) ?полугодие[ .]*({_SHORT})"), lambda m: f"{full(m[2])}H{m[1]}"),
    (re.compile(rf"fy ?({_SHORT})(?: ?[efpaпфо])?"), lambda m: str(full(m[1]))),
    (re.compile(rf"({_YEAR})(?:\.0)?(?: ?[efpaпфо]| ?г(?:од)?\.?)?"), lambda m: m[1]),
)


def classify_header(text: str | None) -> tuple[str, str] | None:
    """(kind, key) of a header's text: period, total or stub; null for other texts."""
    if not text or len(text) > 64:
        return None
    t = normalize(text)
    if t in TOTALS:
        return "total", "total"
    if t in STUBS:
        return "stub", "stub"
    for rx, make in FORMS:
        if (m := rx.fullmatch(t)) and (key := make(m)):
            return "period", key
    return None


#: A quarter or half of a year that is named elsewhere.
PARTS = (
    (re.compile(r"(?:q ?([1-4])|([1-4]) ?q)"), "quarter"),
    (re.compile(r"(?:quarter ([1-4])|([1-4])(?:st|nd|rd|th) quarter)"), "quarter"),
    (re.compile(r"(?:([1-4]|i{1,3}|iv)[ -]*кв(?:артал)?\.?|кв\.? ?([1-4]))"), "quarter"),
    (re.compile(r"(?:h ?([12])|([12]) ?h)"), "half"),
    (re.compile(r"(?:([12]|i{1,2})[ -]*полугодие|half ([12]))"), "half"),
)
WHOLE_MONTHS = {w: m for names in (MONTHS, MONTH_NAMES) for m, words in names.items() for w in words}
ATOM = "kind string, year int, quarter int, half int, month int, day int, key string, variant string"
_FIELDS = [f.split()[0] for f in ATOM.split(", ")]


def header_atom(text: str | None) -> dict | None:
    """What a header cell says of its column's period: all of it (full), a part whose year stands elsewhere (quarter,
    half, month), total or stub, or only a marker; variant is the marker beside it."""
    if not text or len(text) > 64:
        return None
    whole = normalize(text)
    words = whole.split(" ")
    bare = [w for w in words if w.strip("().,") not in MARKERS]
    variant = " ".join(w.strip("().,") for w in words if w.strip("().,") in MARKERS) or None
    rest = " ".join(bare)
    atom = dict.fromkeys(_FIELDS) | {"variant": variant}
    if not rest:
        return atom | {"kind": "marker"} if variant else None
    if got := classify_header(rest):
        kind, key = got
        if kind != "period":
            return atom | {"kind": kind, "key": key}
        if variant is None and (m := re.search(r"\d ?([efpaпфо])$", rest)):
            atom["variant"] = m[1]
        part = re.fullmatch(r"(\d{4})(?:Q(\d)|H(\d)|-(\d\d)(?:-(\d\d))?)?", key)
        return atom | {"kind": "full", "key": key} | {n: int(x) for n, x in zip(_FIELDS[1:6], part.groups(), strict=True) if x}
    for rx, kind in PARTS:
        if m := rx.fullmatch(rest):
            n = m[1] or m[2]
            return atom | {"kind": kind, kind: _ROMAN.get(n) or int(n)}
    if month := WHOLE_MONTHS.get(rest.rstrip(".")):
        return atom | {"kind": "month", "month": month}
    return None


def with_atoms(df: DataFrame, column: str) -> DataFrame:
    """Adds atom, what header_atom says of a column; each distinct short text with a digit or a known word is read once."""
    ship(df.sparkSession)
    texts = df.where(F.length(column) <= 64).select(column).distinct()
    known = "|".join([*TOTALS, *STUBS, *MARKERS, *(w for m in MONTHS.values() for w in m), "кв", "полугодие"])
    texts = texts.where(F.col(column).rlike(r"\d") | F.lower(column).rlike(known))

    @F.pandas_udf(ATOM)
    def read(s: pd.Series) -> pd.DataFrame:
        got = [header_atom(x) or dict.fromkeys(_FIELDS) for x in s]
        return pd.DataFrame(got, columns=_FIELDS).astype(dict.fromkeys(_FIELDS[1:6], "Int32"))

    found = texts.withColumn("atom", read(column)).where("atom.kind is not null").select(F.col(column).alias("__t"), "atom")
    return df.join(found, F.col(column) == F.col("__t"), "left").drop("__t")


def period_shape(text: Column) -> Column:
    """Whether a short text looks like a period without saying which: several dates, a number before a year, Q or H beside a
    digit, a word for quarters or halves beside a year. Only texts that have no atom are in question."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    dates = F.size(F.regexp_extract_all(low, F.lit(r"\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}-\d\d-\d\d"), F.lit(0))) >= 2
    part = low.rlike(r"(^|\s)[qhн]\s?\d|\d\s?[qhн](\s|$)")
    word = low.rlike(r"(?<!\p{L})(q|h|кв|квартал\p{L}*|полугод\p{L}*)(?!\p{L})") & low.rlike(r"(19|20)\d\d")
    return F.coalesce((F.length(low) <= 40) & (dates | low.rlike(r"^\d{1,2}[./](19|20)\d\d$") | part | word), F.lit(False))


def period_like(text: Column) -> Column:
    """period_shape, or a fiscal year, a span of years or a number of months beside a year."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    span = low.rlike(r"fy ?((19|20)\d\d|\d\d)|(19|20)\d\d ?/ ?\d{2,4}|\d{1,2} ?[mм] ?(19|20)\d\d")
    return period_shape(text) | F.coalesce((F.length(low) <= 40) & span, F.lit(False))

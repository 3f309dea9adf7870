"""Fixed values of the spreadsheet-model semantics: bounds, thresholds and word lists, as data."""

GRID_ROWS, GRID_COLUMNS = 1_048_576, 16_384
EXPAND_CAP, NODE_AREA = 2000, 64
TRACE_DEPTH, TRACE_DEPTH_MOST, TRACE_MEMBERS = 8, 32, 200
ID_CAP = 32
NOISE = 1e-6
MAJORITY = 0.6
TOTAL_ABS, TOTAL_REL = 1e-6, 1e-4
OBSERVATIONS, OBSERVATIONS_MOST = 24, 48
WARNINGS, WARNING_SAMPLES = 50, 3
BAND_GAP = 3
#: Columns of totals between periods, and rows between a vertical axis and the names of its series.
JOIN_GAP, SERIES_NEAR = 2, 5
RUN_LEAST, RUN_LEAST_UNLABELLED = 3, 8
SERIAL_MOST = 2_958_465
SCALES = {"unit": 1, "k": 1_000, "m": 1_000_000, "bn": 1_000_000_000}
#: Function names that carry meaning; no function is evaluated.
CONDITIONAL = ("IF", "IFS", "SWITCH")
AGGREGATION = ("SUM", "SUMPRODUCT", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "COUNTIF", "COUNTIFS", "SUBTOTAL", "AGGREGATE")
DYNAMIC = ("INDIRECT", "OFFSET")
#: Functions whose arguments, from this place on, may be switches, and how many other rows have to read one.
SWITCHES, SWITCH_READERS = {"INDEX": 1, "CHOOSE": 0, "OFFSET": 1}, 2
EDGE_KINDS = ("ref", "range", "cross_sheet", "external", "dynamic")
MONTH_STEPS = (1, 3, 6, 12)
OUTLINE_MOST = 8
VALUE_BLOCKS = ("params", "key_value", "matrix")
SERIES_KINDS, STRUCTURAL_KEYS = ("period", "stub", "relative"), ("total", "stub")
CURRENCY_SIGNS = {"GBP": "£", "USD": "$", "EUR": "€", "RUB": "₽"}
#: Columns of parameter tables: numbers and share that make a column one of values, letters from which a text is a note,
#: words that may follow a caption's first one and their letters.
VALUES_LEAST, ROLE_SHARE, NOTE_LEAST = 3, 0.6, 24
QUALIFIERS, QUALIFIER_LETTERS = 2, 20
#: Captions that name what a column is for.
ROLE_WORDS = {
    "label": ("parameter", "parameters", "item", "check", "assumption", "assumptions", "параметр", "параметры", "параметры проекта", "показатель", "показатели", "статья", "статья затрат", "наименование", "наименование показателя", "допущение", "допущения", "предпосылка", "предпосылки", "проверка", "исходные данные"),
    "value": ("value", "values", "active", "result", "chosen", "значение", "значения", "значение руб", "величина", "результат"),
    "unit": ("unit", "units", "unit of measure", "uom", "ед", "ед изм", "ед измерения", "единица", "единицы", "единица изм", "единица измерения", "единицы измерения", "размерность"),
    "note": ("note", "notes", "comment", "comments", "comment s", "source", "sources", "примечание", "примечания", "комментарий", "комментарии", "источник", "описание", "мероприятие", "мероприятия", "вывод", "выводы"),
}

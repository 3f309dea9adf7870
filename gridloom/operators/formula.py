"""The formula language: tokens, a syntax tree, R1C1 templates, shifts and reference edges.

Parsing is text grammar, so it runs in Python: as a map over Arrow batches of distinct formulas, or as the
table function formula_edges. The grammar is a precedence table; a formula that does not fit it is `unparsed`
and has no edges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.params import DYNAMIC, GRID_COLUMNS, GRID_ROWS, SWITCHES
from gridloom.session import ship

#: Error literals of the language.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA", "#SPILL!", "#CALC!")
#: Decimal mark and argument separator of each locale.
LOCALES = {"en": (".", ","), "ru": (",", ";")}
#: Binding power of infix operators, loosest first.
INFIX = {"&": 1, "=": 2, "<>": 2, "<": 2, ">": 2, "<=": 2, ">=": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}
UNARY, PERCENT = 6, 7

_SHEET = r"(?:'(?:[^']|'')+'|(?:\[\d+\])?[^\W\d][\w.]*|\[\d+\][\w.]*)!"
_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}"
_REFERENCE = re.compile(rf"(?P<sheet>{_SHEET})?(?:(?P<a>{_CELL})(?::(?P<b>{_CELL}))?|(?P<c>\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}})|(?P<r>\$?[0-9]{{1,7}}:\$?[0-9]{{1,7}}))(?![\w.(!])")
_NAME = re.compile(rf"(?:{_SHEET})?[^\W\d]?[\w.\\?]*[^\W\d][\w.\\?]*")


class Unparsed(ValueError):
    """The text is no formula of the grammar."""


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def index(text: str) -> int:
    n = 0
    for c in text.upper():
        n = n * 26 + ord(c) - 64
    return n


def _corner(text: str) -> dict[str, Any]:
    m = re.fullmatch(r"(\$?)([A-Za-z]*)(\$?)([0-9]*)", text)
    col, row = index(m[2]) if m[2] else None, int(m[4]) if m[4] else None
    if col and col > GRID_COLUMNS or row is not None and not 1 <= row <= GRID_ROWS:
        raise Unparsed(text)
    return {"col": col, "row": row, "abs_col": bool(m[1]) if col else None, "abs_row": bool(m[3]) if col else bool(m[1])}


def tokenize(text: str, locale: str = "en") -> list[tuple[str, str]]:
    """(kind, text) of each token; spaces between tokens go."""
    decimal, sep = LOCALES[locale]
    number = re.compile(rf"(?:\d+(?:{re.escape(decimal)}\d*)?|{re.escape(decimal)}\d+)(?:[eE][+-]?\d+)?")
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(text, i)
            if not m:
                raise Unparsed(text)
            out.append(("string", m[1].replace('""', '"')))
            i = m.end()
        elif c == "#":
            e = next((e for e in ERRORS if text.upper().startswith(e, i)), None)
            if not e:
                raise Unparsed(text)
            out.append(("error", e))
            i += len(e)
        elif m := _REFERENCE.match(text, i):
            out.append(("ref", m[0]))
            i = m.end()
        elif m := number.match(text, i):
            out.append(("number", m[0].replace(decimal, ".")))
            i = m.end()
        elif m := _NAME.match(text, i):
            out.append(("name", m[0]))
            i = m.end()
        elif text[i : i + 2] in INFIX:
            out.append(("op", text[i : i + 2]))
            i += 2
        elif c in INFIX or c in "%":
            out.append(("op", c))
            i += 1
        elif c in "(){}":
            out.append((c, c))
            i += 1
        elif c == sep:
            out.append(("sep", c))
            i += 1
        elif c in ";\\":
            out.append(("row", c))
            i += 1
        else:
            raise Unparsed(text)
    return out


class Parser:
    """A precedence climber over tokens."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.i = [*tokens, ("end", "")], 0

    def take(self, kind: str | None = None) -> tuple[str, str]:
        t = self.tokens[self.i]
        if kind and t[0] != kind:
            raise Unparsed(t[1])
        self.i += 1
        return t

    def whole(self) -> dict:
        tree = self.infix(0)
        self.take("end")
        return tree

    def infix(self, floor: int) -> dict:
        left = self.prefix()
        while self.tokens[self.i][0] == "op" and (power := INFIX.get(self.tokens[self.i][1], 0)) > floor:
            op = self.take()[1]
            right = self.infix(power - 1 if op == "^" else power)
            left = {"t": "binary", "op": op, "l": left, "r": right}
        return left

    def prefix(self) -> dict:
        kind, text = self.tokens[self.i]
        if kind == "op" and text in "+-":
            self.take()
            return {"t": "unary", "op": text, "x": self.prefix()}
        out = self.atom()
        while self.tokens[self.i] == ("op", "%"):
            self.take()
            out = {"t": "percent", "x": out}
        return out

    def atom(self) -> dict:
        kind, text = self.take()
        if kind in ("string", "number", "error"):
            return {"t": kind, "v": text}
        if kind == "ref":
            return reference(text)
        if kind == "name":
            if self.tokens[self.i][0] == "(":
                self.take()
                return {"t": "call", "name": re.sub(r"(?i)^(_xlfn\.|_xlws\.)+", "", text).upper(), "args": self.arguments()}
            return {"t": "bool", "v": text.upper()} if text.upper() in ("TRUE", "FALSE") else {"t": "name", "v": text}
        if kind == "(":
            out = self.infix(0)
            self.take(")")
            return out
        if kind == "{":
            rows = [[]]
            while True:
                sign = self.take()[1] if self.tokens[self.i] in (("op", "-"), ("op", "+")) else ""
                k, v = self.take()
                if k not in ("string", "number", "error", "name"):
                    raise Unparsed(v)
                rows[-1].append({"t": k, "v": sign + v})
                k, _ = self.take()
                if k == "}":
                    break
                if k == "row":
                    rows.append([])
                elif k != "sep":
                    raise Unparsed(text)
            if len({len(r) for r in rows}) > 1:
                raise Unparsed("ragged")
            return {"t": "array", "rows": rows}
        raise Unparsed(text)

    def arguments(self) -> list[dict | None]:
        if self.tokens[self.i][0] == ")":
            self.take()
            return []
        out: list[dict | None] = []
        while True:
            out.append(None if self.tokens[self.i][0] in ("sep", ")") else self.infix(0))
            kind, text = self.take()
            if kind == ")":
                return out
            if kind != "sep":
                raise Unparsed(text)


def reference(text: str) -> dict:
    m = _REFERENCE.fullmatch(text)
    sheet = m["sheet"][:-1] if m["sheet"] else None
    if sheet and sheet[0] == "'":
        sheet = sheet[1:-1].replace("''", "'")
    a, b = (m["a"], m["b"]) if m["a"] else (m["c"] or m["r"]).split(":")
    return {"t": "ref", "sheet": sheet, "a": _corner(a), "b": _corner(b) if b else None}


def _r1c1(corner: dict, col: int, row: int) -> str:
    out = ""
    if corner["row"] is not None:
        out += f"R{corner['row']}" if corner["abs_row"] else f"R[{corner['row'] - row}]"
    if corner["col"] is not None:
        out += f"C{corner['col']}" if corner["abs_col"] else f"C[{corner['col'] - col}]"
    return out


def _a1(corner: dict) -> str:
    return ("$" if corner["abs_col"] else "") + (letters(corner["col"]) if corner["col"] else "") + ("$" if corner["abs_row"] else "") + (str(corner["row"]) if corner["row"] is not None else "")


def quoted(sheet: str) -> str:
    return sheet if re.fullmatch(r"[^\W\d][\w.]*", sheet) else "'" + sheet.replace("'", "''") + "'"


def render(tree: dict | None, corner, sep: str = ",") -> tuple[str, int]:
    """(text, binding power) of a tree; corner writes one corner of a reference."""
    if tree is None:
        return "", 9
    kind = tree["t"]
    within = lambda x, floor: (lambda s, p: s if p >= floor else f"({s})")(*render(x, corner, sep))
    if kind == "ref":
        body = corner(tree["a"]) + (":" + corner(tree["b"]) if tree["b"] else "")
        return (quoted(tree["sheet"]) + "!" if tree["sheet"] else "") + body, 9
    if kind == "string":
        return '"' + tree["v"].replace('"', '""') + '"', 9
    if kind == "call":
        return tree["name"] + "(" + sep.join(render(x, corner, sep)[0] for x in tree["args"]) + ")", 9
    if kind == "array":
        return "{" + ";".join(",".join(render(x, corner, sep)[0] for x in r) for r in tree["rows"]) + "}", 9
    if kind == "unary":
        return tree["op"] + within(tree["x"], UNARY), UNARY
    if kind == "percent":
        return within(tree["x"], PERCENT) + "%", PERCENT
    if kind == "binary":
        p = INFIX[tree["op"]]
        left, right = (p + 1, p) if tree["op"] == "^" else (p, p + 1)
        return within(tree["l"], left) + tree["op"] + within(tree["r"], right), p
    return tree["v"], 9


def walk(tree: dict | None, hidden: bool = False) -> Iterator[tuple[dict, bool]]:
    """Every node, with whether a dynamic function hides it."""
    if tree is None:
        return
    yield tree, hidden
    inner = hidden or tree["t"] == "call" and tree["name"] in DYNAMIC
    for x in (tree.get("l"), tree.get("r"), tree.get("x"), *(tree.get("args") or ())):
        if isinstance(x, dict):
            yield from walk(x, inner)


@dataclass
class Parsed:
    tree: dict | None = None
    template: str | None = None
    unparsed: bool = False
    edges: list[dict] = field(default_factory=list)
    switches: list[dict] = field(default_factory=list)


def parse(formula: str, sheet: str, addr: str, locale: str = "en") -> Parsed:
    """The tree, the template and the edges of one cell's formula."""
    try:
        tree = Parser(tokenize(formula.removeprefix("="), locale)).whole()
    except (Unparsed, RecursionError):
        return Parsed(unparsed=True)
    here = _corner(addr.replace("$", ""))
    out = Parsed(tree, "=" + render(tree, lambda c: _r1c1(c, here["col"], here["row"]))[0])
    plain = lambda c: _a1({**c, "abs_col": False, "abs_row": False})
    for node, hidden in walk(tree):
        if node["t"] == "call" and node["name"] in SWITCHES:
            for arg in node["args"][SWITCHES[node["name"]] :]:
                if arg and arg["t"] == "name":
                    out.switches.append({"target": arg["v"], "named": True})
                elif arg and arg["t"] == "ref" and not arg["b"] and (arg["sheet"] or sheet) == sheet:
                    out.switches.append({"target": plain(arg["a"]), "named": False})
        if hidden:
            continue
        if node["t"] == "call" and node["name"] in DYNAMIC:
            out.edges.append({"kind": "dynamic", "target": None, "unresolved": True, "named": False})
        elif node["t"] == "name":
            out.edges.append({"kind": "ref", "target": node["v"], "unresolved": True, "named": True})
        elif node["t"] == "ref":
            of = node["sheet"] or sheet
            body = plain(node["a"]) + (":" + plain(node["b"]) if node["b"] else "")
            kind = "external" if "[" in of else "range" if node["b"] else "cross_sheet" if of != sheet else "ref"
            out.edges.append({"kind": kind, "target": f"{of}!{body}", "unresolved": kind == "external", "named": False})
    return out


def shift(formula: str, dcol: int, drow: int) -> str:
    """A formula moved by columns and rows: relative corners move and stop at the first row and column."""

    def corner(c: dict) -> str:
        moved = dict(c)
        if c["col"] is not None and not c["abs_col"]:
            moved["col"] = max(1, c["col"] + dcol)
        if c["row"] is not None and not c["abs_row"]:
            moved["row"] = max(1, c["row"] + drow)
        return _a1(moved)

    return "=" + render(Parser(tokenize(formula.removeprefix("="))).whole(), corner)[0]


EDGES = "source string, kind string, target string, unresolved boolean, named boolean, ord int"
PARSED = "book_id string, sheet string, addr string, formula_template string, unparsed boolean, ast_json string, edges array<struct<kind:string,target:string,unresolved:boolean,named:boolean>>, switches array<struct<target:string,named:boolean>>"


def parse_cells(cells: DataFrame, locale: str = "en") -> DataFrame:
    """Template, tree, edges and arguments of selecting calls of every cell(book_id, sheet, addr, formula_raw) with a formula."""
    ship(cells.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("target", pa.string()), ("unresolved", pa.bool_()), ("named", pa.bool_())]))
        arg = pa.list_(pa.struct([("target", pa.string()), ("named", pa.bool_())]))
        for b in batches:
            got = [parse(f, s, a, locale) for s, a, f in zip(*(b.column(c).to_pylist() for c in ("sheet", "addr", "formula_raw")), strict=True)]
            yield pa.record_batch([b.column("book_id"), b.column("sheet"), b.column("addr"), pa.array([g.template for g in got], pa.string()), pa.array([g.unparsed for g in got]), pa.array([json.dumps(g.tree) if g.tree else None for g in got], pa.string()), pa.array([g.edges for g in got], kind), pa.array([g.switches for g in got], arg)], names=["book_id", "sheet", "addr", "formula_template", "unparsed", "ast_json", "edges", "switches"])

    return cells.where(F.coalesce("formula_raw", F.lit("")) != "").select("book_id", "sheet", "addr", "formula_raw").mapInArrow(run, PARSED)


def formula_edges(parsed: DataFrame) -> DataFrame:
    """One row for each edge, the first of equal (source, target, kind): book_id, source, kind, target, unresolved, named, ord."""
    rows = parsed.select("book_id", F.concat("sheet", F.lit("!"), "addr").alias("source"), F.posexplode("edges").alias("ord", "e"))
    rows = rows.select("book_id", "source", "e.kind", "e.target", "e.unresolved", "e.named", "ord")
    return rows.groupBy("book_id", "source", "kind", "target").agg(F.first("unresolved").alias("unresolved"), F.first("named").alias("named"), F.min("ord").alias("ord"))


def register(spark: SparkSession) -> None:
    """Registers the table function formula_edges(sheet, addr, formula) for SQL with LATERAL."""
    from pyspark.sql.functions import udtf

    ship(spark)

    @udtf(returnType="kind string, target string, unresolved boolean, named boolean")
    class FormulaEdges:
        def eval(self, sheet: str, addr: str, formula: str):
            if formula:
                for e in parse(formula, sheet, addr).edges:
                    yield e["kind"], e["target"], e["unresolved"], e["named"]

    spark.udtf.register("formula_edges", FormulaEdges)

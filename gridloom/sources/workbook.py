"""Workbooks (.xlsx, .xlsm) as DataFrames of cells, presence runs and workbook facts.

Files come through Spark's own binaryFile reader, so they may lie in any store that Spark reads; each workbook
is parsed by one task with a streaming XML reader, and rows leave in batches. Formulas are never recalculated:
cached_value is the text in the file.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.formula import Unparsed, index, letters, shift
from gridloom.session import ship

CELLS = pa.schema([
    ("book_id", pa.string()), ("ordinal", pa.int64()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("addr", pa.string()), ("formula_raw", pa.string()), ("cached_value", pa.string()), ("hidden", pa.bool_()),
    ("number_format", pa.string()), ("comment", pa.string()), ("shared_si", pa.int64()), ("shared_master", pa.bool_()), ("style_indent", pa.int64()), ("outline_level", pa.int64()), ("col_outline_level", pa.int64()), ("presence", pa.string()),
    ("hidden_row", pa.bool_()), ("hidden_col", pa.bool_()), ("merge_end_row", pa.int64()), ("merge_end_col", pa.int64()),
])
CELLS_DDL = "book_id string, ordinal long, sheet string, row long, col long, addr string, formula_raw string, cached_value string, hidden boolean, number_format string, comment string, shared_si long, shared_master boolean, style_indent long, outline_level long, col_outline_level long, presence string, hidden_row boolean, hidden_col boolean, merge_end_row long, merge_end_col long"
BATCH = 2048
_MERGE = re.compile(rb"""<(?:\w+:)?mergeCell\b[^>]*?\bref=["']([A-Z]+\d+):([A-Z]+)(\d+)["']""")

#: Bounds of a zip that is read (bytes of a part, of all parts, ratios, size under which ratios do not count).
PART_MOST, TOTAL_MOST, RATIO, RATIO_XML, RATIO_FROM = 512 << 20, 2 << 30, 50, 200, 4096
#: Built-in number formats that show dates or percentages.
BUILT_IN = {9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm"}


class BookError(ValueError):
    """A workbook that is not read, with a code."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def job_id(sha: str) -> str:
    return hashlib.sha256(f"context:{sha}".encode()).hexdigest()


def guard(z: zipfile.ZipFile) -> None:
    """Refuses paths that leave the archive, parts and archives that are too large, and suspicious ratios."""
    total = 0
    for i in z.infolist():
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or ":" in i.filename:
            raise BookError("zip_path", i.filename)
        total += i.file_size
        if i.file_size > PART_MOST or total > TOTAL_MOST:
            raise BookError("zip_size", i.filename)
        xml = i.filename.startswith("xl/") and i.filename.endswith(".xml")
        if i.file_size >= RATIO_FROM and not i.filename.startswith("xl/worksheets/") and i.file_size >= (RATIO_XML if xml else RATIO) * max(1, i.compress_size):
            raise BookError("zip_ratio", i.filename)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _events(z: zipfile.ZipFile, name: str, ends: tuple[str, ...]) -> Iterator[ElementTree.Element]:
    """Elements of these names as they end, each cleared afterwards."""
    with z.open(name) as f:
        if b"<!DOCTYPE" in f.peek(4096)[:4096]:
            raise BookError("xml_doctype", name)
        for _, e in ElementTree.iterparse(f):
            if _local(e.tag) in ends:
                yield e
                e.clear()


def _tree(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    data = z.read(name)
    if b"<!DOCTYPE" in data[:4096]:
        raise BookError("xml_doctype", name)
    return ElementTree.fromstring(data)


def _named(root: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if root is None else [e for e in root.iter() if _local(e.tag) == name]


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, name = posixpath.split(part)
    root = _tree(z, f"{folder}/_rels/{name}.rels")
    place = lambda t: t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {e.get("Id"): (e.get("Type", "").rpartition("/")[2], e.get("Target") if e.get("TargetMode") == "External" else place(e.get("Target"))) for e in _named(root, "Relationship")}


def _text(e: ElementTree.Element) -> str:
    """The text of a string item: its own and its runs', without phonetic hints."""
    return "".join(t.text or "" for part in e if _local(part.tag) in ("t", "r") for t in ([part] if _local(part.tag) == "t" else part) if _local(t.tag) == "t")


class Book:
    """One workbook in memory as a zip; sheets are streamed."""

    def __init__(self, content: bytes):
        try:
            self.z = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise BookError("not_a_workbook") from e
        guard(self.z)
        self.id = job_id(hashlib.sha256(content).hexdigest())
        self.root = _tree(self.z, "xl/workbook.xml")
        if self.root is None:
            raise BookError("not_a_workbook")
        self.rels = _relations(self.z, "xl/workbook.xml")
        rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        self.sheets = [(e.get("name"), self.rels[e.get(rid)][1], e.get("state", "visible") != "visible") for e in _named(self.root, "sheet") if e.get(rid) in self.rels and self.rels[e.get(rid)][0] == "worksheet"]
        shared = next((t for k, t in self.rels.values() if k == "sharedStrings"), None)
        self.strings = [_text(e) for e in _events(self.z, shared, ("si",))] if shared else []
        self.styles = self._styles()

    def _styles(self) -> list[tuple[str | None, int]]:
        """(number format, indent) of each cell style."""
        root = _tree(self.z, next((t for k, t in self.rels.values() if k == "styles"), ""))
        own = {int(e.get("numFmtId")): e.get("formatCode") for e in _named(root, "numFmt")}
        out = []
        for xfs in _named(root, "cellXfs"):
            for xf in xfs:
                n = int(xf.get("numFmtId", 0))
                fmt = own.get(n, BUILT_IN.get(n))
                indent = next((int(a.get("indent", 0)) for a in xf if _local(a.tag) == "alignment"), 0)
                out.append((None if fmt in (None, "General") else fmt, indent))
        return out

    def facts(self) -> dict:
        """Facts of the workbook beside its cells."""
        names = [{"name": e.get("name"), "formula": e.text or "", "hidden": e.get("hidden") in ("1", "true"), "sheet": self.sheets[int(e.get("localSheetId"))][0] if e.get("localSheetId") and int(e.get("localSheetId")) < len(self.sheets) else None} for e in _named(self.root, "definedName")]
        calc = next(iter(_named(self.root, "calcPr")), None)
        outer = [t for k, t in self.rels.values() if k == "externalLink"]
        outside = [r[1] for t in outer for r in _relations(self.z, t).values()]
        pr = next(iter(_named(self.root, "workbookPr")), None)
        return {
            "book_id": self.id,
            "sheets": [{"name": n, "hidden": h} for n, _, h in self.sheets],
            "has_vba": "xl/vbaProject.bin" in self.z.namelist(),
            "has_xlm": any(k == "xlMacrosheet" for k, _ in self.rels.values()),
            "externals": outside,
            "iterate": calc is not None and calc.get("iterate") in ("1", "true"),
            "date1904": pr is not None and pr.get("date1904") in ("1", "true"),
            "defined_names": names,
        }

    def cells(self) -> Iterator[tuple]:
        """Rows of CELLS in file order; blank styled cells too (presence styled_blank)."""
        ordinal = 0
        for sheet, part, _ in self.sheets:
            notes, merges = self._comments(part), self._merges(part)
            hidden_cols, col_levels = set(), {}
            masters: dict[int, tuple[str, int, int]] = {}
            row_hidden, row_level, row_n = False, None, 0
            with self.z.open(part) as f:
                if b"<!DOCTYPE" in f.peek(4096)[:4096]:
                    raise BookError("xml_doctype", part)
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    name = _local(e.tag)
                    if event == "start":
                        if name == "row":
                            row_n = int(e.get("r", row_n + 1))
                            row_hidden, row_level = e.get("hidden") in ("1", "true"), int(e.get("outlineLevel", 0)) or None
                        continue
                    if name == "col":
                        span = range(int(e.get("min")), min(int(e.get("max")), 16384) + 1)
                        if e.get("hidden") in ("1", "true"):
                            hidden_cols.update(span)
                        if e.get("outlineLevel"):
                            col_levels |= dict.fromkeys(span, int(e.get("outlineLevel")))
                    elif name == "c":
                        addr = e.get("r")
                        m = re.fullmatch(r"([A-Z]+)(\d+)", addr or "")
                        if m:
                            col, row = index(m[1]), int(m[2])
                            yield (*self._cell(e, ordinal, sheet, row, col, addr, row_hidden or col in hidden_cols, notes.get(addr), masters, row_level, col_levels.get(col)), row_hidden, col in hidden_cols, *merges.get(addr, (None, None)))
                            ordinal += 1
                    elif name == "row":
                        e.clear()

    def _merges(self, part: str) -> dict[str, tuple[int, int]]:
        """The last row and column of each merged range by its first cell; they follow the cells in the file, so it is read ahead."""
        found, rest = {}, b""
        with self.z.open(part) as f:
            while chunk := f.read(1 << 20):
                rest += chunk
                for m in _MERGE.finditer(rest):
                    found[m[1].decode()] = (int(m[3]), index(m[2].decode()))
                rest = rest[-256:]
        return found

    def _comments(self, part: str) -> dict[str, str]:
        out = {}
        for kind, target in _relations(self.z, part).values():
            if kind == "comments":
                for c in _named(_tree(self.z, target), "comment"):
                    out[c.get("ref")] = "".join(t.text or "" for t in _named(c, "t"))
        return out

    def _cell(self, e, ordinal, sheet, row, col, addr, hidden, note, masters, level, col_level) -> tuple:
        kind, value, formula, si, master = e.get("t", "n"), None, None, None, False
        for x in e:
            tag = _local(x.tag)
            if tag == "v":
                value = x.text
            elif tag == "is":
                value = _text(x)
            elif tag == "f":
                formula = x.text
                if x.get("t") == "shared" and x.get("si") is not None:
                    si = int(x.get("si"))
                    if formula:
                        masters[si], master = (formula, col, row), True
                    elif si in masters:
                        of, c0, r0 = masters[si]
                        try:
                            formula = shift(of, col - c0, row - r0)[1:]
                        except Unparsed:
                            formula = of
        if kind == "s" and value is not None and value.isdigit() and int(value) < len(self.strings):
            value = self.strings[int(value)]
        style = int(e.get("s", 0))
        fmt, indent = self.styles[style] if style < len(self.styles) else (None, 0)
        present = "populated" if value not in (None, "") or formula else "styled_blank"
        return (self.id, ordinal, sheet, row, col, addr, "=" + formula if formula else None, value, hidden, fmt, note, si, master, indent, level, col_level, present)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return ship(spark).read.format("binaryFile").load(path).select("path", "content")


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The cells of all workbooks under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held = []
                for row in Book(content.as_py()).cells():
                    held.append(row)
                    if len(held) == BATCH:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return files(spark, path).select("content").mapInArrow(run, CELLS_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CELLS, strict=True)], schema=CELLS)


FACTS = "book_id string, path string, sheets array<struct<name:string,hidden:boolean>>, has_vba boolean, has_xlm boolean, externals array<string>, iterate boolean, date1904 boolean, defined_names array<struct<name:string,formula:string,hidden:boolean,sheet:string>>"


def read_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row of facts for each workbook under a path."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([Book(c).facts() | {"path": p} for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["book_id", "path", "sheets", "has_vba", "has_xlm", "externals", "iterate", "date1904", "defined_names"])

    return files(spark, path).mapInPandas(run, FACTS)


def presence_runs(cells: DataFrame) -> DataFrame:
    """Runs of present cells down a column: populated cells are runs of one, styled blanks are joined."""
    w = Window.partitionBy("book_id", "sheet", "col", "presence").orderBy("row")
    blank = cells.where("presence = 'styled_blank'").withColumn("__i", F.col("row") - F.row_number().over(w))
    runs = blank.groupBy("book_id", "sheet", "col", "presence", "__i").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end")).drop("__i")
    own = cells.where("presence = 'populated'").select("book_id", "sheet", "col", "presence", F.col("row").alias("row_start"), F.col("row").alias("row_end"))
    return runs.unionByName(own)


def order_warnings(cells: DataFrame) -> DataFrame:
    """Cells that do not come after the one before them in their sheet: how many, and the first three."""
    w = Window.partitionBy("book_id", "sheet").orderBy("ordinal")
    place = F.struct("row", "col")
    bad = cells.withColumn("__before", F.lag(place).over(w)).where(place <= F.col("__before"))
    bad = bad.withColumn("__rn", F.row_number().over(w))
    return bad.groupBy("book_id", "sheet").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__rn") <= 3, F.struct("ordinal", "addr"))))["addr"].alias("samples"))


def write_book(sheets: dict[str, dict[str, tuple]], names: dict[str, str] | None = None, iterate: bool = False, merges: dict[str, list[str]] | None = None, hidden: dict[str, list[int]] | None = None) -> bytes:
    """A minimal workbook for tests and examples: sheet -> address -> (value, formula or None); merged ranges and hidden rows of sheets."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{esc(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets))
        defined = "<definedNames>" + "".join(f'<definedName name="{esc(k)}">{esc(v)}</definedName>' for k, v in (names or {}).items()) + "</definedNames>" if names else ""
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets>{defined}<calcPr iterate="{int(iterate)}"/></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (name, cells) in enumerate(sheets.items()):
            merged = "".join(f'<mergeCell ref="{m}"/>' for m in (merges or {}).get(name, []))
            rows: dict[int, list[tuple[int, str, tuple]]] = {}
            for addr, cell in cells.items():
                m = re.fullmatch(r"([A-Z]+)(\d+)", addr)
                rows.setdefault(int(m[2]), []).append((index(m[1]), addr, cell))
            body = ""
            for r in sorted(rows):
                body += f'<row r="{r}"' + (' hidden="1">' if r in (hidden or {}).get(name, []) else ">")
                for c, _, (value, formula) in sorted(rows[r]):
                    f = f"<f>{esc(formula.removeprefix('='))}</f>" if formula else ""
                    if isinstance(value, str):
                        body += f'<c r="{letters(c)}{r}" t="{"str" if f else "inlineStr"}">{f}' + (f"<v>{esc(value)}</v>" if f else f"<is><t>{esc(value)}</t></is>") + "</c>"
                    else:
                        body += f'<c r="{letters(c)}{r}">{f}' + (f"<v>{value}</v>" if value is not None else "") + "</c>"
                body += "</row>"
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData>{f"<mergeCells>{merged}</mergeCells>" if merged else ""}</worksheet>')
    return out.getvalue()

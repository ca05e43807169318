"""Sheets of one file's bytes, with the standard library only: OOXML, OpenDocument, SpreadsheetML 2003, HTML tables, delimited text.

A sheet is (name, visibility, flags, rows); rows are lists of text or None, numbered from 1, gaps included. Formats that
need a library (BIFF .xls, .xlsb) can be added to READERS by name; without one they raise Unsupported, which
callers turn into a row of the report.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import sys
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree as ET


class Unsupported(ValueError):
    pass


class Sheet(NamedTuple):
    name: str
    visibility: str
    rows: list[tuple[int, list[str | None]]]
    has_pivot: bool = False
    has_chart: bool = False
    is_chartsheet: bool = False
    protected: bool = False
    declared: str | None = None


def sniff(data: bytes) -> str:
    """Kind of content by its first bytes."""
    head = data[:4096].lstrip(b"\xef\xbb\xbf").lstrip()
    low = head.lower()
    if not data:
        return "empty"
    if data.startswith(b"PK"):
        names = _names(data)
        return "ods" if "content.xml" in names else "xlsb" if any(n.endswith("workbook.bin") for n in names) else "ooxml"
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        return "biff"
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "text"
    if low.startswith(b"<?xml") and b"urn:schemas-microsoft-com:office:spreadsheet" in low:
        return "spreadsheetml"
    if low.startswith((b"<html", b"<!doctype html", b"<table")) or b"<table" in low:
        return "html"
    return "unknown" if b"\x00" in data[:4096] else "text"


def _names(data: bytes) -> list[str]:
    try:
        return zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile:
        return []


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e18 else repr(x)


def serial_text(x: float, base_1904: bool = False) -> str:
    """A day number as ISO date, with the time where there is one."""
    t = (datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 30)) + timedelta(seconds=round(x * 86400))
    return t.strftime("%Y-%m-%d") if (t.hour, t.minute, t.second) == (0, 0, 0) else t.strftime("%Y-%m-%d %H:%M:%S")


class _Package:
    """An OOXML package: parts, their relationships, shared strings and date styles."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.strings = self._strings()
        self.dates = self._date_styles()

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def related(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (kind, part)."""
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], path)
        return out

    def _strings(self) -> list[str]:
        root = self.xml("xl/sharedStrings.xml")
        # Phonetic runs aren't part of the text.
        return ["".join(t.text or "" for child in si if _local(child.tag) != "rPh" for t in child.iter() if _local(t.tag) == "t") for si in (root if root is not None else ())]

    def _date_styles(self) -> set[int]:
        root = self.xml("xl/styles.xml")
        if root is None:
            return set()
        built_in = {*range(14, 23), *range(45, 48)}
        own = {}
        for f in root.iter():
            if _local(f.tag) == "numFmt":
                code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
                own[int(f.get("numFmtId"))] = bool(re.search("[dyhs]|m{1,4}", code)) and "general" not in code
        xfs = next((x for x in root if _local(x.tag) == "cellXfs"), ())
        return {i for i, x in enumerate(xfs) if own.get(n := int(x.get("numFmtId", 0)), n in built_in)}

    def cell(self, c: ET.Element, base_1904: bool) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
        v = next((x.text for x in c if _local(x.tag) == "v"), None)
        if v is None:
            return None
        if kind == "s":
            return self.strings[int(v)]
        if kind == "b":
            return "TRUE" if v == "1" else "FALSE"
        if kind == "e":
            return "#ERROR"
        if kind in ("str", "d"):
            return v
        return serial_text(float(v), base_1904) if int(c.get("s", 0)) in self.dates else number_text(float(v))

    def rows(self, part: str, base_1904: bool) -> list[tuple[int, list[str | None]]]:
        out, number = [], 0
        for _, row in ET.iterparse(self.zip.open(part)):
            if _local(row.tag) != "row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for c in row:
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                cells += [None] * (at - len(cells))
                cells.append(self.cell(c, base_1904))
            out.append((number, cells))
            row.clear()
        return out


def ooxml(data: bytes) -> Iterator[Sheet]:
    package = _Package(data)
    main = next((p for kind, p in package.related("").values() if kind == "officeDocument"), "xl/workbook.xml")
    book = package.xml(main)
    if book is None:
        raise Unsupported("no workbook in the package")
    base_1904 = any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book)
    parts = package.related(main)
    for sheet in (s for x in book if _local(x.tag) == "sheets" for s in x):
        rel = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
        kind, part = parts[rel]
        near = package.related(part)
        drawn = [k for kind_, p in near.values() if kind_ == "drawing" for k, _ in package.related(p).values()]
        is_chart = kind == "chartsheet"
        raw = package.zip.read(part) if part in package.names else b""
        protected = b"<sheetProtection" in raw
        size = re.search(rb'<dimension[^>]*ref="([^"]*)"', raw)
        yield Sheet(sheet.get("name"), sheet.get("state", "visible"), [] if is_chart else package.rows(part, base_1904), any(k == "pivotTable" for k, _ in near.values()), "chart" in drawn, is_chart, protected, size[1].decode() if size else None)


def spreadsheetml(data: bytes) -> Iterator[Sheet]:
    get = lambda e, name: next((v for k, v in e.attrib.items() if _local(k) == name), None)
    for sheet in (x for x in ET.fromstring(data) if _local(x.tag) == "Worksheet"):
        rows, number = [], 0
        for row in (r for r in sheet.iter() if _local(r.tag) == "Row"):
            number = int(get(row, "Index") or number + 1)
            cells: list[str | None] = []
            for c in (c for c in row if _local(c.tag) == "Cell"):
                at = int(get(c, "Index") or len(cells) + 1) - 1
                cells += [None] * (at - len(cells))
                value = next((d for d in c if _local(d.tag) == "Data"), None)
                text = "".join(value.itertext()) if value is not None else None
                kind = get(value, "Type") if value is not None else None
                if kind == "Number" and text:
                    text = number_text(float(text))
                elif kind == "Boolean":
                    text = "TRUE" if text == "1" else "FALSE"
                elif kind == "DateTime" and text:
                    text = text.removesuffix(".000").removesuffix("T00:00:00").replace("T", " ")
                elif kind == "Error":
                    text = "#ERROR"
                cells.append(text)
                cells += [None] * int(get(c, "MergeAcross") or 0)
            rows.append((number, cells))
        hidden = next((x.text for x in sheet.iter() if _local(x.tag) == "Visible"), None)
        yield Sheet(get(sheet, "Name") or "", {"SheetHidden": "hidden", "SheetVeryHidden": "veryHidden"}.get(hidden, "visible"), rows)


class _Tables(HTMLParser):
    """Rows of every table; a nested table's rows are its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[str]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "cell": None})
            self.done.append(self.open[-1]["rows"])
        elif self.open and tag == "tr":
            self._close()
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            span = dict(attrs).get("colspan") or "1"
            self.open[-1]["cell"] = ([], int(span) if span.isdigit() else 1)
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)

    def _close(self):
        top = self.open[-1]
        if top["cell"]:
            parts, span = top["cell"]
            if not top["rows"]:
                top["rows"].append([])
            text = " ".join("".join(parts).replace("\xa0", " ").split())
            top["rows"][-1] += [text] + [""] * (span - 1)
            top["cell"] = None


def html_tables(data: bytes | str) -> Iterator[Sheet]:
    parser = _Tables()
    parser.feed(data if isinstance(data, str) else decoded(data))
    parser.close()
    for i, rows in enumerate((t for t in parser.done if t), 1):
        yield Sheet(f"Table {i}", "visible", list(enumerate(rows, 1)))


def decoded(data: bytes) -> str:
    """Text by the first encoding that fits: UTF-16 with a mark, UTF-8, Windows-1252, Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    if b"\x00" in data:
        raise Unsupported("binary content")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def separator(sample: str) -> str:
    """The one of , ; tab and | with the most even and then the highest count over the first 20 lines."""
    rows = [x for x in sample.splitlines() if x.strip()][:20]
    best = (0.0, ",")
    for sep in ",;\t|":
        counts = [len(next(csv.reader([x], delimiter=sep), [])) - 1 for x in rows]
        if rows and max(counts) > 0:
            common, n = Counter(c for c in counts).most_common(1)[0]
            score = n / len(rows) * min(c for c in counts if c == common)
            best = max(best, (score, sep), key=lambda x: x[0])
    return best[1]


def records(text: str, sep: str):
    """A csv reader of the text, whose cells may have any length. The limit is the process's, so it is set where it counts."""
    csv.field_size_limit(sys.maxsize)
    return csv.reader(io.StringIO(text, newline=""), delimiter=sep)


def delimited(data: bytes) -> Iterator[Sheet]:
    text = decoded(data)
    yield Sheet("", "visible", [(i, list(row)) for i, row in enumerate(records(text, separator(text[:65536])), 1)])


def ods(data: bytes) -> Iterator[Sheet]:
    """Tables of an OpenDocument spreadsheet. Repeated cells and rows are written out, but for blank ones at the end."""
    get = lambda e, name: next((v for k, v in e.attrib.items() if _local(k) == name), None)
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    hidden = {get(s, "name") for s in root.iter() if _local(s.tag) == "style" for p in s if get(p, "display") == "false" and _local(p.tag) == "table-properties"}

    def value(c: ET.Element) -> str | None:
        kind, lines = get(c, "value-type"), ["".join(p.itertext()) for p in c if _local(p.tag) == "p"]
        if kind in ("float", "currency", "percentage"):
            return number_text(float(get(c, "value")))
        if kind == "date":
            return (get(c, "date-value") or "").removesuffix("T00:00:00").replace("T", " ")
        if kind == "boolean":
            return (get(c, "boolean-value") or "").upper()
        return "\n".join(lines) if lines else None

    for table in (t for t in root.iter() if _local(t.tag) == "table"):
        rows, number = [], 0
        for row in (r for r in table.iter() if _local(r.tag) == "table-row"):
            cells: list[str | None] = []
            blank = 0
            for c in (c for c in row if _local(c.tag) in ("table-cell", "covered-table-cell")):
                times, text = int(get(c, "number-columns-repeated") or 1), value(c)
                if text is None:
                    blank += times
                else:
                    cells += [None] * blank + [text] * times
                    blank = 0
            times = int(get(row, "number-rows-repeated") or 1)
            if cells:
                rows += [(number + i, list(cells)) for i in range(1, times + 1)]
            number += times
        yield Sheet(get(table, "name") or "", "hidden" if get(table, "style-name") in hidden else "visible", rows, protected=get(table, "protected") == "true")


READERS: dict[str, Callable[[bytes], Iterator[Sheet]]] = {"ooxml": ooxml, "ods": ods, "spreadsheetml": spreadsheetml, "html": html_tables, "text": delimited, "empty": lambda data: iter(())}


#: What a file may be if the reader of its own kind can't read it.
FALLBACKS = {"ooxml": ("ods",), "ods": ("ooxml",), "spreadsheetml": ("html", "text"), "html": ("spreadsheetml", "text"), "biff": ("html", "text"), "unknown": ("text",)}


def sheets(data: bytes) -> Iterator[Sheet]:
    """All sheets of a file, whatever its name says, by the first reader that can read it; else one error that names what
    each reader said."""
    kind = sniff(data)
    said = []
    for name in (kind, *FALLBACKS.get(kind, ())):
        if name not in READERS:
            said.append(f"{name} files need a reader that isn't installed")
            continue
        try:
            found = list(READERS[name](data))
        except Exception as e:  # the next reader may do
            said.append(f"{name}: {type(e).__name__}: {e}")
            continue
        if found or name == kind:
            yield from found
            return
        said.append(f"{name}: no table")
    raise Unsupported(" | ".join(said))

"""Spreadsheet files (OOXML) as grids of texts, and grids as such files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file, and largest part in it when unpacked, that one task reads. Larger ones are told, not read.
MOST_BYTES, MOST_UNPACKED = 64 << 20, 512 << 20
GRID = "path string, sheet string, row int, cells array<string>, error string"
# The numbers of built-in formats that show dates or times.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_PLACE = re.compile(r"([A-Z]+)([0-9]+)$")


def _named(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(element: ElementTree.Element) -> str:
    """The text of a string item: all its runs, without phonetic hints."""
    if _named(element.tag) == "rPh":
        return ""
    return (element.text or "" if _named(element.tag) == "t" else "") + "".join(map(_texts, element))


def _shown_dates(styles: ElementTree.Element | None) -> list[bool]:
    """Whether each cell style shows a date: by its built-in number, or by letters of days and times in its pattern."""
    if styles is None:
        return []
    own = {}
    for x in styles.iter():
        if _named(x.tag) == "numFmt":
            own[x.get("numFmtId")] = bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", x.get("formatCode", "")), re.I))
    cells = next((x for x in styles.iter() if _named(x.tag) == "cellXfs"), [])
    return [own.get(x.get("numFmtId"), int(x.get("numFmtId") or 0) in _DATES) for x in cells]


def _number(text: str, is_date: bool, start: datetime) -> str | None:
    try:
        value = float(text)
    except ValueError:
        return None
    if is_date and 0 <= value < 2_958_466:
        at = start + timedelta(seconds=round(value * 86_400))
        if value < 1:
            return f"{at:%H:%M:%S}"
        return f"{at:%Y-%m-%d}" if at.time() == datetime.min.time() else f"{at:%Y-%m-%d %H:%M:%S}"
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def column_of(place: str) -> int:
    n = 0
    for c in place:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells) of a file: every row that the file has, in the sheets' order. Rich text is its runs together, a
    formula its last value, a date ISO, an error or an empty cell null; a link is what its cell shows."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        if any(i.file_size > MOST_UNPACKED for i in book.infolist()):
            raise ValueError("too large when unpacked")
        parts = set(book.namelist())
        parse = lambda name: ElementTree.fromstring(book.read(name)) if name in parts else None
        whole = parse("xl/workbook.xml")
        if whole is None:
            raise ValueError("no workbook")
        inner = lambda name: [] if (found := parse(name)) is None else list(found)
        links = {x.get("Id"): x.get("Target", "") for x in inner("xl/_rels/workbook.xml.rels")}
        shared = [_texts(x) for x in inner("xl/sharedStrings.xml")]
        dates = _shown_dates(parse("xl/styles.xml"))
        old = any(_named(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in whole.iter())
        start = datetime(1904, 1, 1) if old else datetime(1899, 12, 30)
        for sheet in (x for x in whole.iter() if _named(x.tag) == "sheet"):
            target = links.get(next((v for k, v in sheet.attrib.items() if _named(k) == "id" and "}" in k), None), "")
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if name not in parts:
                continue
            with book.open(name) as opened:
                at = -1
                for _, x in ElementTree.iterparse(opened):
                    if _named(x.tag) != "row":
                        continue
                    at = int(x.get("r")) - 1 if (x.get("r") or "").isdigit() else at + 1
                    cells: list[str | None] = []
                    for c in x:
                        place = _PLACE.match(c.get("r") or "")
                        k = column_of(place[1]) if place else len(cells)
                        if k >= 16_384:
                            continue
                        cells += [None] * (k + 1 - len(cells))
                        cells[k] = _cell(c, shared, dates, start)
                    yield sheet.get("name", ""), at, cells
                    x.clear()


def _cell(c: ElementTree.Element, shared: list[str], dates: list[bool], start: datetime) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(_texts(x) for x in c if _named(x.tag) == "is")
    value = next((x.text for x in c if _named(x.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else None
    if kind == "b":
        return "TRUE" if value.strip() in ("1", "true") else "FALSE"
    if kind in ("str", "d"):
        return value
    style = int(c.get("s") or 0)
    return _number(value, style < len(dates) and dates[style], start)


def grids(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sheet, row, cells, error) of files' contents. A file that is no such workbook, or is larger than MOST_BYTES, gives one
    row with an error and no sheet; the others' rows don't depend on it. A file is read by one task, row by row."""
    arrow = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, held = [], []
                at, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    if raw is None:
                        raise ValueError("too large")
                    for sheet, row, cells in rows_of(raw):
                        held.append({"path": at, "sheet": sheet, "row": row, "cells": cells, "error": None})
                        if len(held) == 1_000:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held = []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError) as broken:
                    name = [{"path": at, "sheet": None, "row": None, "cells": None, "error": f"{type(broken).__name__}: {broken}"[:200]}]
                yield pa.RecordBatch.from_pylist(held + name, arrow)

    small = F.when(F.length(F.col(content)) <= MOST_BYTES, F.col(content))
    return files.select(F.col(path).alias("path"), small.alias("content")).mapInArrow(run, GRID)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """grids() of all spreadsheet files below a path; one without a byte gives no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return grids(found.select("path", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content")))


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A file of sheets of texts, each cell as it is; characters that XML can't hold go."""
    spaces = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    quote = lambda t: escape(_BAD.sub("", t), {'"': "&quot;", "\r": "&#13;"})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        put = lambda name, body: book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{body}')
        n = range(1, len(sheets) + 1)
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{types}.worksheet+xml"/>' for k in n)
        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>{over}</Types>')  # fmt: skip
        rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
        put("_rels/.rels", rels.format(f'<Relationship Id="rId1" Type="{kinds}/officeDocument" Target="xl/workbook.xml"/>'))
        put("xl/_rels/workbook.xml.rels", rels.format("".join(f'<Relationship Id="rId{k}" Type="{kinds}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)))
        listed = "".join(f'<sheet name="{quote(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, sheets))
        put("xl/workbook.xml", f"<workbook {spaces}><sheets>{listed}</sheets></workbook>")
        for k, rows in zip(n, sheets.values()):
            body = "".join(
                f'<row r="{i}">' + "".join(f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{quote(c)}</t></is></c>' for j, c in enumerate(row) if c is not None) + "</row>"
                for i, row in enumerate(rows, 1)
            )
            put(f"xl/worksheets/sheet{k}.xml", f"<worksheet {spaces}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def workbooks(rows: DataFrame, group: str) -> DataFrame:
    """(path, content): a workbook for each group of rows (group, sheet, at, cells), its sheets by name and rows by `at`. A group
    is one task's: give it no more rows than a sheet can show."""
    import pandas as pd

    def made(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["sheet", "at"], kind="stable")
        sheets = {name: [list(c) for c in each["cells"]] for name, each in part.groupby("sheet", sort=True)}
        return pd.DataFrame({"path": [str(part[group].iloc[0])], "content": [workbook(sheets)]})

    return rows.select(group, "sheet", "at", "cells").groupBy(group).applyInPandas(made, "path string, content binary")

"""Documents of markup to rows: sections, list items, nested templates, tables with spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import html_text


def sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, level, title, body): one row a heading, with the text up to the next one."""
    parts = F.filter(F.split(html, r"(?i)(?=<h[1-6][ >])"), lambda p: p.rlike("(?is)^<h[1-6][ >]"))
    each = pages.select(key, F.posexplode(parts).alias("place", "part"))
    heading = F.regexp_extract("part", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
    rest = F.regexp_replace("part", r"(?is)^<h[1-6][^>]*>.*?</h[1-6]>", "")
    level = F.regexp_extract("part", r"(?i)^<h([1-6])", 1).cast("int")
    return each.select(key, "place", level.alias("level"), html_text(heading).alias("title"), html_text(rest).alias("body"))


def items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, href, label) of list items that are links."""
    pattern = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    pairs = F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "href"), (2, "label"))))
    return pages.select(key, F.posexplode(pairs).alias("place", "p")).select(key, "place", "p.href", "p.label")


def template_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, depth) of balanced {{ }} templates; unbalanced braces are left alone."""
    stack, found = [], []
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            found.append((start, m.end(), len(stack)))
    return sorted(found)


def template_fields(body: str) -> tuple[str, dict[str, str]]:
    """Name and fields of one template, split at bars outside nested templates and links."""
    depth, parts, at = 0, [], 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", body):
        if m[0] in ("{{", "[["):
            depth += 1
        elif m[0] in ("}}", "]]"):
            depth -= 1
        elif depth == 0:
            parts.append(body[at : m.start()])
            at = m.end()
    parts.append(body[at:])
    fields = {}
    for i, part in enumerate(parts[1:], 1):
        name, eq, value = part.partition("=")
        fields[name.strip() if eq else str(i)] = (value if eq else part).strip()
    return parts[0].strip(), fields


def templates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, depth, name, fields) of every balanced template: nesting isn't regular, so a bounded frame of
    documents at a time goes to Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, body in zip(frame[key], frame[text]):
                for place, (a, b, depth) in enumerate(template_spans(body or "")):
                    name, fields = template_fields(body[a + 2 : b - 2])
                    rows.append((k, place, depth, name, fields))
            yield pd.DataFrame(rows, columns=[key, "place", "depth", "name", "fields"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, place int, depth int, name string, fields map<string,string>")


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, colspan, rowspan) laid out: a spanned place repeats its cell."""
    out: list[dict[int, str]] = []
    open_cells: dict[int, tuple[str, int]] = {}
    for row in rows:
        line = {c: text for c, (text, left) in open_cells.items() if left}
        open_cells = {c: (text, left - 1) for c, (text, left) in open_cells.items() if left > 1}
        c = 0
        for text, colspan, rowspan in row:
            while c in line:
                c += 1
            for i in range(max(1, colspan)):
                line[c + i] = text
                if rowspan > 1:
                    open_cells[c + i] = (text, rowspan - 1)
            c += max(1, colspan)
        out.append(line)
    return [[line[c] for c in sorted(line)] for line in out]


_ROW = re.compile(r"(?is)<tr[^>]*>(.*?)</tr>")
_CELL = re.compile(r"(?is)<t[dh]([^>]*)>(.*?)</t[dh]>")


def tables(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, col, cell) of every table of a page, spans laid out."""

    def span(attributes: str, name: str) -> int:
        m = re.search(rf'{name}\s*=\s*"?(\d+)', attributes, re.I)
        return min(int(m[1]), 1_000) if m else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, body in zip(frame[key], frame[html]):
                for t, m in enumerate(re.finditer(r"(?is)<table[^>]*>(.*?)</table>", body or "")):
                    cells = [[(re.sub(r"<[^>]*>", "", c[1]).strip(), span(c[0], "colspan"), span(c[0], "rowspan")) for c in _CELL.findall(r)] for r in _ROW.findall(m[1])]
                    rows += [(k, t, i, j, cell) for i, line in enumerate(grid(cells)) for j, cell in enumerate(line)]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "col", "cell"])

    return docs.select(F.col(key).cast("long").alias(key), html).mapInPandas(run, f"{key} long, table int, row int, col int, cell string")

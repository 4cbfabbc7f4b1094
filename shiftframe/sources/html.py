"""Fields out of web pages, as column expressions, and the rows of their tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    """The text of the title element; null without one."""
    return F.nullif(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def link_texts(html: Column) -> Column:
    """The opening tags of all links."""
    return F.regexp_extract_all(html, F.lit(r"<a\s[^>]*>"), F.lit(0))


def cells(html: Column) -> Column:
    """The texts of all table cells, tags removed."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))


def links(html: Column) -> Column:
    """(href, text) of all links with both, tags removed from the text."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    href = lambda x: F.regexp_extract(x, r'href="([^"]*)"', 1)
    return F.transform(found, lambda x: F.struct(href(x).alias("href"), F.trim(F.regexp_replace(x, r"<[^>]+>", "")).alias("text")))


class _Tables(HTMLParser):
    """Tables in the order of their opening tags: rows of (text, is header, columns, rows) cells. A cell's text leaves out tables inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[dict] = []  # the tables around, innermost last
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "cell": None})
        elif self.open:
            top = self.open[-1]
            if tag == "tr":
                top["cell"] = None
                top["rows"].append([])
            elif tag in ("td", "th"):
                if not top["rows"]:
                    top["rows"].append([])
                span = lambda name: max(1, min(1000, int(v) if (v := (dict(attrs).get(name) or "1").strip()).isdecimal() else 1))
                top["cell"] = [[], tag == "th", span("colspan"), span("rowspan")]
                top["rows"][-1].append(top["cell"])
            elif tag in ("br", "p", "div", "li") and top["cell"]:
                top["cell"][0].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] and not self.silent:
            self.open[-1]["cell"][0].append(data)


def _grid(rows: list[list[list]]) -> list[tuple[bool, list[str]]]:
    """(all headers, texts) of each row, spanning cells repeated in every place they cover."""
    out, hanging = [], {}  # column: (text, is header, rows left)
    for row in rows:
        cells, placed, k = list(row), {}, 0
        while cells or k in hanging:
            if k in hanging:
                text, header, left = hanging.pop(k)
                placed[k] = text, header
                if left > 1:
                    hanging[k] = text, header, left - 1
                k += 1
                continue
            parts, header, wide, high = cells.pop(0)
            text = " ".join("".join(parts).split())
            for j in range(k, k + wide):
                placed[j] = text, header
                if high > 1:
                    hanging[j] = text, header, high - 1
            k += wide
        for j in [j for j in hanging if j not in placed]:  # beyond the row's own cells
            text, header, left = hanging.pop(j)
            placed[j] = text, header
            if left > 1:
                hanging[j] = text, header, left - 1
        if placed:
            width = max(placed) + 1
            out.append((all(h for _, h in placed.values()), [placed[j][0] if j in placed else "" for j in range(width)]))
    return out


def tables_of(html: str) -> list[list[dict[str, str]]]:
    """The rows of each table by column name: the last of its leading header rows names the columns, or "1", "2" and so on; a repeated name gets its column's number."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    out = []
    for rows in parser.tables:
        grid = _grid(rows)
        heads = next((k for k, (header, _) in enumerate(grid) if not header), len(grid))
        names = grid[heads - 1][1] if heads else []
        width = max((len(texts) for _, texts in grid), default=0)
        names = [n or str(k + 1) for k, n in enumerate([*names, *[""] * (width - len(names))])]
        names = [n if n not in names[:k] else f"{n} {k + 1}" for k, n in enumerate(names)]
        out.append([dict(zip(names, texts, strict=False)) for _, texts in grid[heads:]])
    return out


def table_rows(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, table, row, cells): every row of every table of the pages, cells a map by column name; tables and rows count from 1."""
    kind = dict(pages.dtypes)[id_col]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, tables, rows, cells = [], [], [], []
            for k, html in enumerate(b.column(1)):
                for t, table in enumerate(tables_of(html.as_py() or ""), 1):
                    for r, row in enumerate(table, 1):
                        at.append(k)
                        tables.append(t)
                        rows.append(r)
                        cells.append(list(row.items()))
            kinds = pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip((tables, rows, cells), kinds, strict=True))], [id_col, "table", "row", "cells"])

    return pages.select(id_col, html_col).mapInArrow(read, f"`{id_col}` {kind}, table int, row int, cells map<string, string>")

"""Tables in HTML as grids: row and column spans expanded, in Arrow batches over a text column."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20

_GAP = "[ \t\n\r\f]"
_NAME = r"[a-zA-Z_:][-a-zA-Z0-9_:.]*"
_VALUE = r"""(?:"[^"<>]*"|'[^'<>]*'|[^\s"'`=<>/]+(?!/))"""
_ATTRIBUTE = re.compile(f"({_NAME})(?:=({_VALUE}))?")
#: A plain tag: the slash of an end, name, attributes, the slash of an empty one.
_TAG = re.compile(f"<(?:(/)([a-zA-Z][a-zA-Z0-9]*){_GAP}*|([a-zA-Z][a-zA-Z0-9]*)((?:{_GAP}+{_NAME}(?:={_VALUE})?)*){_GAP}*(/?))>")
#: Elements whose inside is not read as tags.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


class _Reader(HTMLParser):
    """Python's parser, with a short way through pages that hold plain tags alone: one split instead of a scan by tag. Any other page is left to
    Python's parser as a whole, and both give the same calls."""

    def feed(self, data: str) -> None:
        parts = _TAG.split(data)
        if len(parts) // 6 != data.count("<") or self.rawdata:
            return super().feed(data)
        opened = {p: p.lower() for p in set(parts[3::6]) if p}
        if not _RAW.isdisjoint(opened.values()):
            return super().feed(data)
        if parts[0]:
            self.handle_data(unescape(parts[0]))
        for i in range(1, len(parts), 6):
            name = parts[i + 2]
            if name is None:
                self.handle_endtag(parts[i + 1].lower())
            else:
                raw, tag = parts[i + 3], opened[name]
                attrs = [(k.lower(), None if not v else unescape(v[1:-1] if v[0] in "\"'" else v)) for k, v in _ATTRIBUTE.findall(raw)] if raw else []
                (self.handle_startendtag if parts[i + 4] else self.handle_starttag)(tag, attrs)
            text = parts[i + 5]
            if text:
                self.handle_data(unescape(text) if "&" in text else text)


class _Tables(_Reader):
    """Cells (text, rowspan, colspan) of every table, nested tables apart from the ones around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self._open: list[list[list[list]]] = []
        self._cell: list[list | None] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self._open.append([])
            self._cell.append(None)
        elif not self._open:
            return
        elif tag == "tr":
            self._open[-1].append([])
            self._cell[-1] = None
        elif tag in ("td", "th"):
            a = dict(attrs) if attrs else None
            if not self._open[-1]:
                self._open[-1].append([])
            self._cell[-1] = ["", _span(a.get("rowspan")), _span(a.get("colspan"))] if a else ["", 1, 1]
            self._open[-1][-1].append(self._cell[-1])
        elif tag == "br" and self._cell[-1]:
            self._cell[-1][0] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self._open:
            self.tables.append([[tuple(c) for c in row] for row in self._open.pop()])
            self._cell.pop()
        elif tag in ("td", "th") and self._open:
            self._cell[-1] = None

    def handle_data(self, data: str) -> None:
        if self._cell and self._cell[-1] is not None:
            self._cell[-1][0] += data

    def close(self) -> None:
        super().close()
        while self._open:
            self.handle_endtag("table")


def _span(raw: str | None) -> int:
    value = int(raw) if raw is not None and raw.strip().isdigit() else (1 if raw is None else 0)
    if value < 1:
        raise ValueError(f"bad span {raw!r}")
    return value


def expand(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """A reading of rows with spans: a cell is repeated in each place it covers, and rows of blanks go.

    hanging: by column what cells of earlier rows still cover, as (rows left, text). It is used up only where a row
    gets to it, before a cell or, without a gap, behind the last one.
    """
    grid: list[list[str]] = []
    hanging: dict[int, tuple[int, str]] = {}
    for row in rows:
        if not hanging and all(down == across == 1 for _, down, across in row):
            line = [" ".join(text.split()) for text, _, _ in row]
            if any(line):
                grid.append(line)
            continue
        line = []
        new: dict[int, tuple[int, str]] = {}

        def carry(line=line) -> None:
            while len(line) in hanging:
                left, text = hanging.pop(len(line))
                if left > 1:
                    new[len(line)] = (left - 1, text)
                line.append(text)

        for text, down, across in row:
            carry()
            clean = " ".join(text.split())
            if down > 1:
                new |= dict.fromkeys(range(len(line), len(line) + across), (down - 1, clean))
            line += [clean] * across
        carry()
        hanging |= new
        if any(line):
            grid.append(line)
    return grid


def tables(html: str | None) -> list[list[list[str]]]:
    """Every table of a document as a grid of texts; inner tables come before the ones around them."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [expand(t) for t in parser.tables]


def records(grid: list[list[str]]) -> list[dict[str, str]]:
    """Rows below the first as dicts; repeated headers get _1, _2, blank ones are "unknown"."""
    if not grid:
        return []
    seen: dict[str, int] = {}
    names = []
    for raw in grid[0]:
        name = raw or "unknown"
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}_{n}" if n else name)
    return [dict(zip(names, row + [""] * (len(names) - len(row)), strict=False)) for row in grid[1:]]


def _explode(docs: DataFrame, id_col: str, html_col: str, read: Callable[[str | None], list[tuple]], extra: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """(id, table, row, cells, extra columns, error): the rows that `read` gives of each page.

    Pages are read in Arrow batches and given back in slices of about SLICE_BYTES of HTML, so a batch of long pages is never held as rows at once.
    """
    kind = dict(docs.dtypes)[id_col]
    types = {"table": pa.int32(), "row": pa.int32(), "cells": pa.list_(pa.string())} | {c: t for c, (_, t) in extra.items()} | {"error": pa.string()}
    blank = (None,) * (len(types) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)

            def give(at: list[int], rows: list[tuple], ids=ids) -> pa.RecordBatch:
                columns = zip(*rows, strict=True) if rows else [[] for _ in types]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)]], names=[id_col, *types])

            at, rows, size = [], [], 0
            for i, html in enumerate(batch.column(1).to_pylist()):
                try:
                    found = [(*r, None) for r in read(html)]
                except ValueError as e:
                    found = [(*blank, str(e))]
                rows += found
                at += [i] * len(found)
                size += len(html or "")
                if size >= SLICE_BYTES:
                    yield give(at, rows)
                    at, rows, size = [], [], 0
            yield give(at, rows)

    more = "".join(f", {c} {k}" for c, (k, _) in extra.items())
    return docs.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, table int, row int, cells array<string>{more}, error string")


def explode_tables(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table, row, cells): one row a table row, by Arrow batches; a document that can't be read has `error`."""
    return _explode(docs, id_col, html_col, lambda html: [(t, r, cells) for t, grid in enumerate(tables(html)) for r, cells in enumerate(grid)], {})


#: Heads of a table of corrections.
CORRECTION_HEADS = frozenset(("정정항목", "정정전", "정정후"))


_BRACKETS = dict.fromkeys(map(ord, "[]【】「」"))


def compact(text: str) -> str:
    return "".join(text.split()).translate(_BRACKETS)


def _heads_corrections(row: list[str]) -> bool:
    return len(row) >= len(CORRECTION_HEADS) and {compact(c) for c in row} >= CORRECTION_HEADS


class _Titled(_Tables):
    """Tables in document order with the title that stands before each: the text of a span outside of cells, if it is one of `titles` and the first
    such span of the page. A table inside a table knows the one around it."""

    def __init__(self, titles: frozenset[str]) -> None:
        super().__init__()
        self.titles = titles
        self.found: list[dict] = []
        self._stack: list[int] = []
        self._span: list[str] | None = None
        self._seen: set[str] = set()
        self._title: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        if tag == "table":
            self.found.append({"title": self._title, "around": self._stack[-1] if self._stack else None, "rows": []})
            self._stack.append(len(self.found) - 1)
            self._title = None
        elif tag == "span":
            self._span = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self._open:
            self.found[self._stack.pop()]["rows"] = [[tuple(c) for c in row] for row in self._open[-1]]
        elif tag == "span" and self._span is not None:
            text, self._span = " ".join("".join(self._span).split()), None
            if text in self.titles:
                outside = not any(self._cell)
                self._title = text if outside and text not in self._seen else None
                self._seen.add(text)
        super().handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self._span is not None:
            self._span.append(data)
        super().handle_data(data)


def titled_tables(html: str | None, titles: frozenset[str]) -> list[dict]:
    """Every table in document order: title, grid, whether its first row has spans, whether it (or one around it) is a table of corrections."""
    parser = _Titled(titles)
    parser.feed(html or "")
    parser.close()
    for t in parser.found:
        t["grid"] = expand(t["rows"])
        t["spanned"] = any(down > 1 or across > 1 for _, down, across in next(iter(t["rows"]), []))
        t["corrects"] = any(_heads_corrections(row) for row in t["grid"])
        if t["around"] is not None:
            t["corrects"] = t["corrects"] or parser.found[t["around"]]["corrects"] or any(_heads_corrections([c[0] for c in row]) for row in parser.found[t["around"]]["rows"])
    return parser.found


#: The tables of a page as one value: those of explode_titled, with their rows as grids.
TABLES = "array<struct<table:int,title:string,spanned:boolean,corrects:boolean,rows:array<array<string>>>>"


def _nested(pages: list[list[dict]]) -> pa.Array:
    """The tables of each page as TABLES, by offsets over one flat list of cells."""
    cells, in_row, in_table, in_page, told = [], [0], [0], [0], []
    for page in pages:
        for number, t in enumerate(page):
            for line in t["grid"]:
                cells += line
                in_row.append(len(cells))
            in_table.append(len(in_row) - 1)
            told.append((number, t.get("title"), t.get("spanned"), t.get("corrects")))
        in_page.append(len(told))
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    columns = list(zip(*told, strict=True)) or [()] * 4
    flat = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)]
    rows = lists(in_table, lists(in_row, pa.array(cells, pa.string())))
    return lists(in_page, pa.StructArray.from_arrays([*flat, rows], names=["table", "title", "spanned", "corrects", "rows"]))


def read_tables(docs: DataFrame, id_col: str, html_col: str, titles: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to keep, tables, error): one row a document with all its tables; one that can't be read has none and an `error`.

    What is asked of a page can so be answered where it was read, without a shuffle of its rows. With titles, tables stand in document order as in explode_titled,
    else as in explode_tables. Documents are given back in slices of about SLICE_BYTES of HTML.
    """
    kinds, wanted = dict(docs.dtypes), None if titles is None else frozenset(titles)
    read = (lambda html: [{"grid": g} for g in tables(html)]) if wanted is None else (lambda html: titled_tables(html, wanted))
    first = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, found, errors = 0, 0, [], []
            texts = batch.column(len(first)).to_pylist()
            for i, html in enumerate(texts):
                try:
                    found.append(read(html))
                    errors.append(None)
                except ValueError as e:
                    found.append([])
                    errors.append(str(e))
                size += len(html or "")
                if size >= SLICE_BYTES or i == len(texts) - 1:
                    kept = [batch.column(c).slice(begin, i + 1 - begin) for c in range(len(first))]
                    yield pa.RecordBatch.from_arrays([*kept, _nested(found), pa.array(errors, pa.string())], names=[*first, "tables", "error"])
                    begin, size, found, errors = i + 1, 0, [], []

    return docs.select(*first, html_col).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in first], f"tables {TABLES}", "error string"]))


def gather_tables(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, tables) of rows of tables (id, table, row, cells and, if they have them, title, spanned, corrects), as read_tables gives them. One shuffle by document."""
    told = [c if c in rows.columns else None for c in ("title", "spanned", "corrects")]
    known = [F.first(c).alias(c) if c else F.lit(None).cast(k).alias(n) for c, n, k in zip(told, ("title", "spanned", "corrects"), ("string", "boolean", "boolean"), strict=True)]
    each = rows.filter("cells IS NOT NULL").repartition(id_col).groupBy(id_col, "table").agg(F.map_from_entries(F.collect_list(F.struct("row", "cells"))).alias("by"), F.max("row").alias("n"), *known)
    grid = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.col("by")[i])
    return each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("table", "title", "spanned", "corrects", grid.alias("rows")))).alias("tables"))


def explode_titled(docs: DataFrame, id_col: str, html_col: str, titles: tuple[str, ...]) -> DataFrame:
    """(id, table, row, cells, title, spanned, corrects, error): one row a table row, tables numbered in document order."""
    wanted = frozenset(titles)
    read = lambda html: [(i, r, cells, t["title"], t["spanned"], t["corrects"]) for i, t in enumerate(titled_tables(html, wanted)) for r, cells in enumerate(t["grid"])]
    return _explode(docs, id_col, html_col, read, {"title": ("string", pa.string()), "spanned": ("boolean", pa.bool_()), "corrects": ("boolean", pa.bool_())})

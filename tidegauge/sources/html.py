"""Tables of HTML pages as grids, by a stack machine over tag tokens.

Each open table is a frame of the stack with its rows and the cell that is open, so a nested table is a
table of its own and not text of the cell around it. Cells and rows end where the next one begins,
whether their end tags are there or not; ``colspan`` and ``rowspan`` repeat a cell over its places.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Largest spans that the HTML standard allows, and the whitespace it knows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SPACE = " \t\n\f\r"
CELLS = "array<struct<table_no:int,row_no:int,cell_no:int,cell:string>>"


@dataclass
class Cell:
    columns: int
    rows: int
    text: list[str] = field(default_factory=list)


@dataclass
class Frame:
    number: int
    rows: list[list[Cell]] = field(default_factory=list)
    cell: Cell | None = None
    row_open: bool = False


def _span(attributes: list[tuple[str, str | None]], name: str, most: int) -> int:
    value = next((v for k, v in attributes if k == name), None) or ""
    digits = value.strip(SPACE)
    if not digits.isascii() or not digits.isdigit():
        return 1
    return min(int(digits), most)


class Reader(HTMLParser):
    """Collects the tables of one page in the order in which they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)  # entities become characters; comments are no data
        self.stack: list[Frame] = []
        self.tables: list[Frame] = []
        self.hidden = 0  # depth inside script and style

    def handle_starttag(self, tag, attributes):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            frame = Frame(len(self.tables))
            self.tables.append(frame)
            self.stack.append(frame)
        elif self.stack and tag in ("tr", "td", "th"):
            frame = self.stack[-1]
            frame.cell = None
            if tag == "tr" or not frame.row_open:
                frame.rows.append([])
                frame.row_open = True
            if tag != "tr":
                frame.cell = Cell(max(1, _span(attributes, "colspan", MOST_COLUMNS)), _span(attributes, "rowspan", MOST_ROWS))
                frame.rows[-1].append(frame.cell)
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.stack and tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            self.stack[-1].cell = None
            self.stack[-1].row_open &= tag in ("td", "th")
        elif self.stack and tag == "table":
            self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1].cell and not self.hidden:
            self.stack[-1].cell.text.append(data)


def grid(rows: list[list[Cell]]) -> list[tuple[int, int, str]]:
    """``(row, column, text)``: each cell takes the first free column and repeats over its spans, as far
    as there are rows; a ``rowspan`` of 0 reaches to the last one."""
    out, taken = [], {}  # taken: column to (rows left, text) of cells that come from above
    for r, cells in enumerate(rows):
        below, column, waiting = {}, 0, iter(cells)
        cell = next(waiting, None)
        while cell is not None or any(c >= column for c in taken):
            if column in taken:
                left, text = taken[column]
                out.append((r, column, text))
                if left > 1:
                    below[column] = (left - 1, text)
                column += 1
            elif cell is not None:
                text = " ".join("".join(cell.text).split())
                left = cell.rows or len(rows)
                for _ in range(cell.columns):
                    if column in taken:  # spans that overlap: the cell from above stays
                        break
                    out.append((r, column, text))
                    if left > 1:
                        below[column] = (left - 1, text)
                    column += 1
                cell = next(waiting, None)
            else:
                column += 1
        taken = below
    return out


def page_cells(page: str | None) -> list[dict]:
    if not page or "<" not in page:
        return []
    reader = Reader()
    reader.feed(page)
    reader.close()
    return [{"table_no": t.number, "row_no": r, "cell_no": c, "cell": text}
            for t in reader.tables for r, c, text in grid(t.rows)]


def html_grids(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every place of every table's grid: ``(id, table_no, row_no, cell_no, cell)``, zero-based.

    Tables are numbered as they open, nested ones too. White space in a cell is collapsed, entities are
    decoded; comments, scripts and the text of nested tables are no part of a cell. Null pages and
    pages without a table have no rows. Pages are read one by one where they lie, without a shuffle.
    """
    @F.pandas_udf(CELLS)
    def cells(texts: pd.Series) -> pd.Series:
        return texts.map(page_cells, na_action=None)

    found: Column = F.inline(cells(F.col(html_col)))
    return pages.where(F.col(html_col).ilike("%<table%")).select(id_col, found)

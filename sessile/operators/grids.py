"""Tables of articles as grids: row and column spans filled, nested tables apart, and measurement rows by a spec."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most columns and rows that a cell may span in HTML.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
# What a tag may hold is taken without going back: a quote that never closes costs one pass.
_EVENT = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+)(/?)>", re.S)
_SPLIT = re.compile(r"(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?:/?)[A-Za-z][\w:.-]*(?:[^<>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+(?:/?)>)", re.S)
#: Tags that are remembered as they are written; texts repeat them all the time.
MOST_TAGS = 4096
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NUMBER = r"\d+(?:\.\d+)?"


@dataclass
class Grid:
    """One table: its id and caption, how deep it is nested, and its rows of cells."""

    id: str
    depth: int
    caption: str = ""
    rows: list[list[str]] = field(default_factory=list)
    _spans: dict[int, list] = field(default_factory=dict)  # column: rows that are left, text
    _row: list[str] | None = None
    _cell: list[str] | None = None
    _size: tuple[int, int] = (1, 1)

    def start_row(self) -> None:
        self.end_row()
        self._row = []

    def _covered(self) -> None:
        while len(self._row) in self._spans:
            at = len(self._row)
            self._row.append(self._spans[at][1])
            self._spans[at][0] -= 1
            if not self._spans[at][0]:
                del self._spans[at]

    def start_cell(self, columns: int, rows: int) -> None:
        if self._row is None:
            self.start_row()
        self.end_cell()
        self._cell, self._size = [], (min(max(columns, 1), MOST_COLUMNS), MOST_ROWS if rows == 0 else min(max(rows, 1), MOST_ROWS))

    def end_cell(self) -> None:
        if self._cell is None:
            return
        text, self._cell = " ".join("".join(self._cell).split()), None
        for _ in range(self._size[0]):
            self._covered()
            if self._size[1] > 1:
                self._spans[len(self._row)] = [self._size[1] - 1, text]
            self._row.append(text)

    def end_row(self) -> None:
        self.end_cell()
        if self._row is None:
            return
        started = len(self._row)
        self._covered()
        # Spans that begin further to the right than the row's own cells: what lies between is empty.
        while self._spans and max(self._spans) > len(self._row) - 1 and started:
            self._row.append("")
            self._covered()
        if self._row:
            self.rows.append(self._row)
        self._row = None

    def end_group(self) -> None:
        """Spans end with their group of rows."""
        self.end_row()
        self._spans.clear()


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(text)}


def _number(attributes: dict[str, str], name: str) -> int:
    found = re.match(r"\s*(\d{1,9})", attributes.get(name, ""))
    return int(found.group(1)) if found else 1


def _tag(written: str) -> tuple[str | None, str, str, str, str]:
    """CDATA text, `/` of an end tag, name in lower case without its prefix, attributes, and `/` of a tag that stands alone."""
    found = _TAGS.get(written)
    if found is None:
        cdata, end, name, attributes, alone = _EVENT.fullmatch(written).groups()
        found = cdata, end, (name or "").lower().rpartition(":")[2], attributes, alone
        if len(written) <= 256:
            if len(_TAGS) >= MOST_TAGS:
                _TAGS.clear()
            _TAGS[written] = found
    return found


_TAGS: dict[str, tuple[str | None, str, str, str, str]] = {}


def grids(markup: str | None) -> list[Grid]:
    """All tables of a text of markup, in the order in which they begin.

    A caption belongs to the wrapper or table it stands in. The text of a nested table is
    its own and not its cell's. Tags that do not match are skipped; tables, rows and
    cells that are still open end with the text or with what they are in.
    """
    out: list[Grid] = []
    wraps: list[dict] = []
    open_: list[Grid] = []
    caption: list[str] | None = None

    def text(piece: str, raw: bool = False) -> None:
        piece = piece if raw else html.unescape(piece)
        if caption is not None:
            caption.append(piece)
        elif open_ and open_[-1]._cell is not None:
            open_[-1]._cell.append(piece)

    def close(grid: Grid) -> None:
        grid.end_group()
        if wraps and wraps[-1].get("grid") is grid and not grid.caption:
            grid.caption = wraps[-1].get("caption", "")

    pieces = _SPLIT.split(markup or "")
    for at in range(1, len(pieces), 2):
        if pieces[at - 1]:
            text(pieces[at - 1])
        cdata, end, name, attributes, alone = _tag(pieces[at])
        if cdata is not None:
            text(cdata, raw=True)
        if not name:
            continue
        if name == "table-wrap":
            if not end:
                wraps.append({"id": _attributes(attributes).get("id", "")})
            elif wraps:
                wrap = wraps.pop()
                if "grid" in wrap and not wrap["grid"].caption:
                    wrap["grid"].caption = wrap.get("caption", "")
        elif name == "caption":
            if not end and not alone:
                caption = []
            elif caption is not None:
                words, caption = " ".join("".join(caption).split()), None
                if open_ and not (wraps and wraps[-1].get("grid") is None):
                    open_[-1].caption = words
                elif wraps:
                    wraps[-1]["caption"] = words
        elif name == "table":
            if not end and not alone:
                own = _attributes(attributes)
                wrap = wraps[-1] if wraps and "grid" not in wraps[-1] else {}
                grid = Grid(own.get("id") or wrap.get("id", ""), len(open_))
                if wrap:
                    wrap["grid"] = grid
                out.append(grid)
                open_.append(grid)
            elif end and open_:
                close(open_.pop())
        elif open_ and caption is None:
            grid = open_[-1]
            if name == "tr":
                grid.end_row() if end else grid.start_row()
            elif name in ("td", "th"):
                if end:
                    grid.end_cell()
                else:
                    own = _attributes(attributes) if attributes else {}
                    grid.start_cell(_number(own, "colspan") if own else 1, _number(own, "rowspan") if own else 1)
                    if alone:
                        grid.end_cell()
            elif name in ("thead", "tbody", "tfoot"):
                grid.end_group()
            elif name in ("p", "br", "break", "li", "div"):
                text(" ")
        elif name in ("p", "br", "break", "li", "div", "title"):
            text(" ")
    text(pieces[-1])
    while open_:
        close(open_.pop())
    for wrap in wraps:
        if "grid" in wrap and not wrap["grid"].caption:
            wrap["grid"].caption = wrap.get("caption", "")
    return out


def table_grids(docs: DataFrame, first: TableSpec | None = None) -> DataFrame:
    """[S5] (doc_id, table, table_id, caption, depth, row, cells) of all tables in (doc_id, xml), or of each document's first one that fits a spec; null documents have none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, xml in zip(f["doc_id"], f["xml"], strict=True):
                for t, g in enumerate(grids(xml)):
                    if first is None or first.fits(g):
                        rows += [(d, t, g.id, g.caption, g.depth, r, cells) for r, cells in enumerate(g.rows)]
                        if first is not None and g.rows:
                            break
            yield pd.DataFrame(rows, columns=["doc_id", "table", "table_id", "caption", "depth", "row", "cells"])

    return docs.select("doc_id", "xml").mapInPandas(run, f"doc_id {kind}, table int, table_id string, caption string, depth int, row int, cells array<string>")


@dataclass
class Measured:
    """A measured column of a spec: what it measures, and the cells of its value, deviation and count."""

    liquid: str
    value: int
    deviation: int | None = None
    count: int | None = None
    condition: str = ""


@dataclass
class TableSpec:
    """Which table to read, by id or by words of its caption, and how.

    exact or least: cells of a row. skip: header rows. pattern: `plain` (the whole cell is
    a number), `with_deviation` (number, plus-minus, number; or a plain number) or `first` (the
    first number of the cell). strict: a value that does not match stops the query, as
    does a deviation that is asked for. rules: (reason, cell, regular expression) of rows to leave out.
    """

    columns: tuple[Measured, ...]
    table_id: str = ""
    caption: tuple[str, ...] = ()
    skip: int = 1
    exact: int | None = None
    least: int = 1
    label: int = 0
    label_pattern: str = ""
    pattern: str = "plain"
    strict: bool = False
    rules: tuple[tuple[str, int, str], ...] = ()
    constants: tuple[tuple[str, str], ...] = ()

    def fits(self, grid: Grid) -> bool:
        caption = grid.caption.lower()
        return self.table_id in ("", grid.id) and all(word.lower() in caption for word in self.caption)


#: What a value looks like, as the sources print it.
PATTERNS = {"plain": rf"^({_NUMBER})()$", "with_deviation": rf"^({_NUMBER})(?:\s*[±+−-]\s*({_NUMBER}))?$", "first": rf"({_NUMBER})()"}


def _cell(at: int | None) -> Column:
    return F.lit("") if at is None else F.coalesce(F.get("cells", F.lit(at)), F.lit(""))


def _of(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def measurements_of(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """[S5 S5a S5b] Rows of grids to (doc_id, table_id, caption, row, label, liquid, condition, value, deviation, count, reason, constants).

    reason is null where the value stands. Of several tables that fit, each document's
    first one is read.
    """
    fits = F.lit(True)
    if spec.table_id:
        fits &= F.col("table_id") == spec.table_id
    for word in spec.caption:
        fits &= F.lower("caption").contains(word.lower())
    mine = rows.filter(fits)
    first = mine.groupBy("doc_id").agg(F.min("table").alias("table"))
    return _measured(mine.join(first, ["doc_id", "table"], "left_semi"), spec)


def measurements_in(docs: DataFrame, spec: TableSpec) -> DataFrame:
    """[S5 S5a S5b] measurements_of the grids of (doc_id, xml): the first table that fits is told where a document is parsed, so each is parsed once and its rows stay where they are.

    A null doc_id is a document like any other here; measurements_of leaves it out.
    """
    return _measured(table_grids(docs, spec), spec)


def _measured(mine: DataFrame, spec: TableSpec) -> DataFrame:
    mine = mine.filter(F.col("row") >= spec.skip)
    shape = F.size("cells") != spec.exact if spec.exact is not None else F.size("cells") < spec.least
    label = _cell(spec.label)
    row_reason = F.when(shape, "cells").when(label == "", "no_label")
    if spec.label_pattern:
        row_reason = row_reason.when(~label.rlike(spec.label_pattern), "label")
    for reason, at, pattern in spec.rules:
        row_reason = row_reason.when(_cell(at).rlike(pattern), reason)
    wanted = F.explode(F.array(*[F.struct(F.lit(c.liquid).alias("liquid"), F.lit(c.condition).alias("condition"), _cell(c.value).alias("text"), _cell(c.deviation).alias("beside"), F.lit(c.deviation is not None).alias("apart"), _cell(c.count).alias("number")) for c in spec.columns]))
    each = mine.select("doc_id", "table_id", "caption", "row", label.alias("label"), row_reason.alias("row_reason"), wanted.alias("c")).select("*", "c.*")
    pattern = PATTERNS[spec.pattern]
    value = _of(F.col("text"), pattern, 1)
    deviation = F.when(F.col("apart"), _of(F.col("beside"), PATTERNS["first"], 1)).otherwise(_of(F.col("text"), pattern, 2))
    told = F.when(F.col("row_reason").isNotNull(), F.col("row_reason")).when(F.trim("text") == "", "empty").when(value.isNull(), "unparsed").when(F.col("apart") & deviation.isNull(), "deviation")
    out = each.select("doc_id", "table_id", "caption", "row", "label", "liquid", "condition", told.alias("reason"), value.alias("_v"), deviation.alias("_d"), _of(F.col("number"), PATTERNS["first"], 1).alias("_n"), "text")
    if spec.strict:
        wrong = F.col("reason").isin("empty", "unparsed", "deviation")
        out = out.withColumn("reason", F.when(wrong, F.raise_error(F.concat(F.lit("no value in row "), F.col("label"), F.lit(": "), F.col("text")))).otherwise(F.col("reason")))
    kept = F.col("reason").isNull()
    constants = F.create_map(*[F.lit(x) for pair in spec.constants for x in pair]).cast("map<string,string>") if spec.constants else F.create_map().cast("map<string,string>")
    return out.select("doc_id", "table_id", "caption", "row", "label", "liquid", "condition", *[F.when(kept, F.col(f"_{c[0]}")).alias(c) for c in ("value", "deviation", "n_replicates")], "reason", constants.alias("constants"))


def report(found: DataFrame) -> DataFrame:
    """[S5b] (doc_id, n_rows, n_labels, n_liquids, skipped): what was read, and how many cells were left for each reason."""
    kept = F.col("reason").isNull()
    # One pass over what was found: a row for each document and reason, those of what was kept with their names.
    each = found.groupBy("doc_id", "reason").agg(F.count("*").alias("n"), *[F.size(F.collect_set(F.when(kept, F.col(c)))).cast("long").alias(f"n_{c}s") for c in ("label", "liquid")])
    skipped = F.map_from_entries(F.array_sort(F.collect_list(F.when(~kept, F.struct("reason", "n")))))
    told = [F.coalesce(F.sum(F.when(kept, F.col(c))), F.lit(0)).alias(name) for c, name in (("n", "n_rows"), ("n_labels", "n_labels"), ("n_liquids", "n_liquids"))]
    return each.groupBy("doc_id").agg(*told, F.when(F.count("reason") > 0, skipped).alias("skipped"))

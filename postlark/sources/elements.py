"""A page as rows: its elements and the pieces of its text, each with the elements around it. What they mean is for columns to say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr"}
_ENDED_BY = {"li": ("ul", "ol"), "tr": ("table", "tbody", "thead"), "td": ("tr",), "th": ("tr",), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
#: path and marks go from the outermost element inwards, an element's own last; a mark is the tag (main where that is its role), a dot and the class.
PIECES = "page_id long, url string, at int, tag string, attributes map<string,string>, path array<int>, marks array<string>, link string, line int, text string"
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string()]
_KEPT = "array<struct<at:int,tag:string,attributes:map<string,string>,path:array<int>,text:string>>"
_KEPT_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("path", pa.list_(pa.int32())), ("text", pa.string())]))
_ROWS = 20_000  # rows of a batch, about
#: Characters of pages that a partition of their rows holds, about: a task's memory is for these, however many pages there are.
PART_CHARS = 8 << 20


class _Pieces(HTMLParser):
    """Rows of one page. link: the address of the innermost link around a text; line: grows with every edge of a block. kept: tags whose elements and texts get rows, or all."""

    def __init__(self, kept: tuple[str, ...] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.kept = kept
        self.rows: list[tuple] = []
        self.tags: list[str] = []
        self.path: list[int] = []
        self.marks: list[str] = []
        self.links: list[str | None] = [None]
        self.places: dict[str, list[int]] = {}
        self.said: list[str] = []
        self.at = self.line = 0

    def _last(self, *tags: str) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def _close(self, place: int) -> None:
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.places[tag].pop()
            self.path.pop()
            self.marks.pop()
            self.links.pop()
            self.line += tag in BLOCKS

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_text()
        if tag in _ENDED_BY and (place := self._last(tag)) > self._last(*_ENDED_BY[tag]):
            self._close(place)
        if tag in BLOCKS and tag != "tr" and (place := self._last("p")) > self._last("div", "td", "th", "li", "section", "article"):
            self._close(place)
        self.at += 1
        self.line += tag == "br" or tag in BLOCKS
        known = {k: v or "" for k, v in reversed(attrs)}
        mark = f"{'main' if known.get('role') == 'main' else tag}.{' '.join(known.get('class', '').split())}"
        if self.kept is None or tag in self.kept:
            self.rows.append((self.at, tag, list(known.items()), [*self.path, self.at], [*self.marks, mark], self.links[-1], self.line, None))
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.tags))
            self.tags.append(tag)
            self.path.append(self.at)
            self.marks.append(mark)
            self.links.append(known.get("href") or self.links[-1] if tag == "a" else self.links[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.tags) - 1)

    def handle_endtag(self, tag: str) -> None:
        self._end_text()
        if (place := self._last(tag)) >= 0:
            self._close(place)

    def handle_data(self, data: str) -> None:
        if not (self.places.get("script") or self.places.get("style")):
            self.said.append(data)

    def _end_text(self, *_: str) -> None:
        """What was said up to a mark, a sign of its own (<) among it, is one text."""
        if not self.said:
            return
        self.at += 1
        if self.kept is None or any(self.places.get(tag) for tag in self.kept):
            self.rows.append((self.at, None, None, list(self.path), list(self.marks), self.links[-1], self.line, "".join(self.said)))
        self.said.clear()

    handle_comment = handle_decl = handle_pi = unknown_decl = _end_text

    def close(self) -> None:
        super().close()
        self._end_text()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # of no known name: a comment, up to its end
            return self.parse_bogus_comment(i, report)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PIECES.split(", ")]
    held: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names)

    for batch in batches:
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            reader = _Pieces()
            reader.feed(html or "")
            reader.close()
            held += [(page_id, url, *row) for row in reader.rows]
            if len(held) >= _ROWS:
                yield batch_of()
                held.clear()
    if held:
        yield batch_of()


def _kept_rows(kept: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for html in batch.column("html").to_pylist():
            reader = _Pieces(kept)
            reader.feed(html or "")
            reader.close()
            found.append([{"at": at, "tag": tag, "attributes": attributes, "path": path, "text": text} for at, tag, attributes, path, _, _, _, text in reader.rows])
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, _KEPT_TYPE)], ["page_id", "kept"])


def kept_pieces(pages: DataFrame, *tags: str) -> DataFrame:
    """page_id and kept, the elements of these tags and the texts in them in page order: a row for each page, where it is."""
    read = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return read.mapInArrow(partial(_kept_rows, tags), f"page_id long, kept {_KEPT}")


def part_count(pages: DataFrame) -> int | None:
    """How many partitions the rows of pages need, or none if those that Spark makes do.

    Spark makes as many as there are cores, and these grow with the pages; past a part for each core the number follows from the
    length of all pages.
    """
    parts = (pages.agg(F.sum(F.length(F.col("html").cast("string")))).first()[0] or 0) // PART_CHARS + 1
    return int(parts) if parts > pages.sparkSession.sparkContext.defaultParallelism else None


def dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """Each page's rows in one partition of ``parts``."""
    return rows.repartition(parts, "page_id") if parts else rows.repartition("page_id")


def pieces(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of all pages, each page's in one partition: what is then grouped by page and element is not dealt again. parts: part_count, if it is known."""
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return dealt(read.mapInArrow(_rows, PIECES), parts or part_count(pages))


def around(holds: Callable[[Column], Column] | None = None) -> Column:
    """The elements around a piece, outermost first, as structs of node, mark and depth; those for which ``holds``, or all."""
    every = F.transform(F.arrays_zip(F.col("path").alias("node"), F.col("marks").alias("mark")), lambda e, i: F.struct(e["node"].alias("node"), e["mark"].alias("mark"), i.alias("depth")))
    return every if holds is None else F.filter(every, holds)


def tag_of(mark: Column) -> Column:
    return F.substring_index(mark, ".", 1)


def squeezed(text: Column) -> Column:
    """With one space for all white space, and none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def said(at: Column, text: Column) -> Column:
    """An aggregate: the texts of a group in page order, squeezed."""
    parts = F.array_sort(F.collect_list(F.struct(at.alias("at"), text.alias("text"))))
    return squeezed(F.array_join(F.transform(parts, lambda p: p["text"]), " "))

"""Benchmark decontamination by templates.

Words lose case and the signs around them; numbers, names inside a sentence and units after a number
become typed placeholders. Windows of such templates are joined by hash with those of the benchmark.
Matches on one diagonal (the same shift between text and item), and those on all diagonals together, must map
the item's slot values to the text's one to one: then the text holds the item, word for word or with other parameters. With ``copied``,
as in the registered query and the pipeline, windows with the same values on both sides count whatever the
rest of their diagonal does, and only those with changed values must map one to one. A text leaks an item
if windows that cover at least SHARE of the item's windows agree.

A bitmap of fixed size, made from the benchmark's windows, keeps most of the texts' windows from the
shuffle; it only lets through more as the benchmark grows.

An item without a template window (fewer than WINDOW words, or fewer than FIXED words outside slots in each
window) is searched by its own words instead, without slots: in windows of WINDOW words, or as a whole where
it is shorter. Signs of operations and numbers count there, so that 2 + 2 is not 2 - 2.

Defined cases: a null or empty text leaks nothing; an item of one word is leaked by every text with that word;
an item without words is not searched; in other items, windows with fewer than FIXED words outside slots are
not searched; repeated rows leak each;
a null doc_id stays null; item ids are whatever benchmark has; other columns, whatever their names, are
ignored (drop_leaking keeps them); very long texts are read whole; of diagonals with as many windows that of the
smaller shift is taken first; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, bitmap, mix, private, releasing, rolled, text_slices, windows

WINDOW, FIXED = 8, 4
SHARE = 0.5
BITMAP_BITS = 22
UNITS = (
    "kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles foot feet ft inch inches yard yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents pound pounds "
    "percent degrees degree kmh mph w kw kwh v j kj n hz khz mhz ghz kb mb gb tb"
).split()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/-"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;"]] = True
NUMBER, NAME, UNIT = 1, 2, 3
_MARKS = mix(np.arange(4, dtype=np.uint64) + np.uint64(0xC0FFEE))
#: Around a word as it stands: what opens and what closes; other signs are part of it.
_OPENS, _CLOSES = np.zeros(256, bool), np.zeros(256, bool)
_OPENS[[ord(c) for c in "\"'`([{"]] = True
_CLOSES[[ord(c) for c in "\"'`)]}.,;:!?"]] = True
_LENGTHS = mix(np.arange(WINDOW + 1, dtype=np.uint64) + np.uint64(0xBEAD))


def _lower(raw: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters of UTF-8; other letters stay."""
    out = _LOWER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
    out[second] += 0x20
    return out


def _without(raw: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without such bytes before and after them; what is nothing else ends where it starts, or before."""
    first, last = np.flatnonzero(~before[raw]), np.flatnonzero(~after[raw])
    if not len(start) or not len(first) or not len(last):
        return start, start
    start = first[np.minimum(np.searchsorted(first, start), len(first) - 1)]
    return start, last[np.maximum(np.searchsorted(last, end) - 1, 0)] + 1


class Template:
    """The template words of some texts: hash, kind of slot (0: none), text, place in the bytes."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        raw, start, end = w.bytes, w.start.copy(), w.end.copy()
        closes = _END[raw[np.maximum(w.end - 1, 0)]]
        start, end = _without(raw, start, end, _SIGN, _SIGN)
        first = np.ones(len(start), bool)  # of a sentence or a line
        first[1:] = closes[:-1] | (w.text[1:] != w.text[:-1])
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])
        first[1:] |= breaks[w.start[1:]] != breaks[w.end[:-1]]
        there = start < end
        start, end, first, text = start[there], end[there], first[there], w.text[there]
        digits, numeric, upper = (np.concatenate([[0], np.cumsum(t[raw])]) for t in (_DIGIT, _NUMERIC, _UPPER))
        number = (digits[end] > digits[start]) & (numeric[end] - numeric[start] == end - start)
        name = _UPPER[raw[start]] & ~first & (upper[end] - upper[start] == 1) & (end - start > 1)
        w.bytes, w.start, w.end, w.text = _lower(raw), start, end, text
        hashes = w.hashes()
        after_number = np.zeros(len(start), bool)
        after_number[1:] = number[:-1] & (text[1:] == text[:-1])
        unit = after_number & np.isin(hashes, _unit_hashes())
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0)))
        self.hash = np.where(self.kind > 0, _MARKS[self.kind], hashes)
        self.text, self.start, self.end, self.bytes = text, start, end, w.bytes

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of windows with enough fixed words, and their hashes."""
        ok = windows(self.text, WINDOW)
        fixed = np.concatenate([[0], np.cumsum(self.kind == 0)])
        if len(ok):
            ok &= fixed[WINDOW:] - fixed[: len(ok)] >= FIXED
        at = np.flatnonzero(ok)
        return at, mix(rolled(self.hash, WINDOW))[at] if len(at) else np.zeros(0, np.uint64)

    def slots(self, at: int) -> list[str]:
        """Values of the placeholders in the window at a word."""
        return [f"{self.kind[k]}{self.bytes[self.start[k] : self.end[k]].tobytes().decode(errors='replace')}" for k in range(at, at + WINDOW) if self.kind[k]]


class Plain:
    """The words of some texts as they stand, but for case and the marks around them: hash, text."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        raw, start, end = w.bytes, w.start.copy(), w.end.copy()
        start, end = _without(raw, start, end, _OPENS, _CLOSES)
        there = start < end
        w.bytes, w.start, w.end, self.text = _lower(raw), start[there], end[there], w.text[there]
        self.hash = w.hashes()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of n words, and their hashes; windows of other lengths and of templates have others."""
        at = np.flatnonzero(windows(self.text, n))
        return at, mix(rolled(self.hash, n) + _LENGTHS[n])[at] if len(at) else np.zeros(0, np.uint64)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(Words([" ".join(UNITS).encode()]).hashes())
    return _units[0]


def _plain(texts: list[bytes], sizes: list[int] | None, without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """text, place, hash, length of the windows over the words as they stand: of every text, in the given lengths; without those, of the texts named, each in its own."""
    if not (len(without) if sizes is None else sizes):
        return
    p = Plain(texts)
    count = np.bincount(p.text, minlength=len(texts))
    before = np.cumsum(count) - count
    for n in range(1, WINDOW + 1) if sizes is None else sizes:
        at, hashes = p.windows(n)
        if sizes is None:
            own = np.isin(p.text[at], without[np.minimum(count[without], WINDOW) == n])
            at, hashes = at[own], hashes[own]
        if len(at):
            yield p.text[at], at - before[p.text[at]], hashes, n


def _found(batches: Iterator[pa.RecordBatch], bitmap: bytes | None, sizes: list[int] | None) -> Iterator[pa.RecordBatch]:
    """id, key, hash, place, slots, total, size (0: a template) of every window, or of those whose bit is set and plain ones of the given sizes."""
    bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8)).astype(bool)
    for batch in batches:
        ids, keys = batch.column("id").to_pylist(), batch.column("key").to_pylist()
        for a, b, texts in text_slices(batch.column("text")):
            t = Template(texts)
            at, hashes = t.windows()
            total = np.bincount(t.text[at], minlength=b - a)
            before = np.searchsorted(t.text, np.arange(b - a))
            if bits is not None:
                hit = bits[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                at, hashes = at[hit], hashes[hit]
            rows = t.text[at].tolist()
            plain = np.concatenate([[0], np.cumsum(t.kind > 0)])
            slots = [t.slots(k) if n else [] for k, n in zip(at.tolist(), (plain[at + WINDOW] - plain[at]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a + r] for r in rows], pa.int64()), pa.array([keys[a + r] for r in rows], pa.int64()), pa.array(hashes.view(np.int64), pa.int64()),
                    pa.array(at - before[t.text[at]], pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(total[t.text[at]], pa.int64()), pa.array(np.zeros(len(at), np.int64)),
                ],
                _NAMES,
            )
            for text, place, hashes, n in _plain(texts, sizes, np.flatnonzero(total == 0)):
                total_n = np.bincount(text, minlength=b - a)
                if bits is not None:
                    hit = bits[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                    text, place, hashes = text[hit], place[hit], hashes[hit]
                rows = text.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[a + r] for r in rows], pa.int64()), pa.array([keys[a + r] for r in rows], pa.int64()), pa.array(hashes.view(np.int64), pa.int64()),
                        pa.array(place, pa.int64()), pa.array([[]] * len(rows), pa.list_(pa.string())), pa.array(total_n[text], pa.int64()), pa.array(np.full(len(rows), n, np.int64)),
                    ],
                    _NAMES,
                )


_NAMES = ["id", "key", "hash", "place", "slots", "total", "size"]
_ROWS = "id long, key long, hash long, place long, slots array<string>, total long, size long"


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _windows(rows: DataFrame, ident: str, bitmap: bytes | None, sizes: list[int] | None) -> DataFrame:
    return rows.select(F.col(ident).cast("long").alias("id"), text_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: releasing(_found(batches, bitmap, sizes)), _ROWS)


def leaks(docs: DataFrame, benchmark: DataFrame, copied: bool = False) -> DataFrame:
    """doc_id, key, item_id, share of the item's windows, parameters changed in those (0: word for word), for every text and item it leaks.

    copied: windows that agree word for word count even where another slot of their diagonal is not one to one.
    """
    items = _windows(benchmark, "item_id", None, None)
    sizes = sorted(r["size"] for r in items.where("size > 0").select("size").distinct().collect())  # at most WINDOW
    found = _windows(docs, "doc_id", bitmap(items.select("hash").distinct(), BITMAP_BITS), sizes)
    theirs = items.select(F.col("id").alias("item_id"), "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), F.col("total").alias("item_total"))
    ours = found.select(F.col("id").alias("doc_id"), "key", "hash", "place", "slots")
    both = ours.join(theirs, "hash")
    pairs = F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours"))
    same = (F.col("item_slots") == F.col("slots")) if copied else F.lit(False)
    lines = both.groupBy("doc_id", "key", "item_id", "item_total", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        F.collect_set(F.when(same, F.col("item_place"))).alias("copies"), F.collect_set(F.when(~same, F.struct(F.col("item_place").alias("place"), pairs.alias("pairs")))).alias("windows"),
    )

    def one(pairs: Column) -> Column:
        """One to one: as many pairs as values on either side."""
        return (F.size(pairs) == F.size(F.array_distinct(pairs["theirs"]))) & (F.size(pairs) == F.size(F.array_distinct(pairs["ours"])))

    # Diagonals that are one to one, those with the most windows first; of a later one the windows whose pairs go with those taken.
    line = F.struct((-F.size("windows")).alias("order"), "shift", "copies", "windows")
    start = F.struct(F.expr("cast(array() as array<long>)").alias("places"), F.expr("cast(array() as array<struct<theirs:string,ours:string>>)").alias("pairs"))

    def take(taken: Column, x: Column) -> Column:
        fits = F.filter(x["windows"], lambda w: one(F.array_distinct(F.concat(taken["pairs"], w["pairs"]))))
        own = F.array_distinct(F.flatten(x["windows"]["pairs"]))
        both = F.struct(F.concat(taken["places"], fits["place"]).alias("places"), F.array_distinct(F.concat(taken["pairs"], F.flatten(fits["pairs"]))).alias("pairs"))
        return F.when(one(own), both).otherwise(taken)

    grouped = lines.groupBy("doc_id", "key", "item_id", "item_total").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    taken = grouped.withColumn("taken", F.aggregate("lines", start, take))
    good = taken.select("doc_id", "key", "item_id", "item_total", F.size(F.array_distinct(F.concat(F.flatten("lines.copies"), "taken.places"))).alias("n"), F.size(F.filter("taken.pairs", lambda p: ~p["theirs"].eqNullSafe(p["ours"]))).alias("changed"))
    return good.where(F.col("n") >= SHARE * F.col("item_total")).select("doc_id", "key", "item_id", (F.col("n") / F.col("item_total")).alias("share"), "changed")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; all their columns."""
    doc, key = private(docs, "doc", "key")
    bad = leaks(docs, benchmark, copied=True).select(F.col("doc_id").cast("long").alias(doc), F.col("key").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_key() == F.col(key)), "left_anti")

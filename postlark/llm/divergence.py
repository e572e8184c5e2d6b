"""Source divergence audit: how far each source's words are from the other sources of its language, exactly.

Each language keeps the terms of at least LEAST_DOCS of its documents. A group, a source in a language, gives
each kept term p = 1 + floor(10**9 (count + 2) / (N + 2 V)), N its occurrences of kept terms and V their number,
and two groups are compared by f = floor((p - q)**2 / (p + q)) summed over all kept terms.

Counts are kept as run-length columns: the vocabulary is put in an order in which equal counts stand together
(terms of few sources first, then by the source and count that lead them and a hash of all their counts), cut
into blocks of BLOCK terms, and within a block each source's counts are runs. For two sources the ends of their
runs are merged, and f of a stretch counts as often as it is long.

All work is dealt by term, by block or by group; a block's size is fixed, so none grows with its language or
source. The result has a row for each pair of sources of a language, as it has to.

Defined cases: null text, lang and source are ''; rows of one doc_id are documents each; a group without kept terms
is compared like any other, and a language without any has value 0 for all its pairs; equal values rank by item;
very long texts are cut by slices between documents only, so that each is read whole; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import kept as written
from ._text import text_slices

LEAST_DOCS, TOP, BLOCK, SCALE = 10, 10, 4096, 1_000_000_000
#: Rows of counts that a task holds before it hands them on.
HELD_ROWS = 400_000
_SLICE = 4 << 20
_PART = np.zeros(256, bool)
_PART[65:91] = _PART[97:123] = _PART[128:] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def _terms(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts, and the text of each."""
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    part = _PART[raw]
    edge = np.diff(part.view(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths + 1), start, "right")
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[part])])
    return words.dictionary_encode(), owner


def _count(texts: list[bytes], group: pa.DictionaryArray) -> pa.Table:
    """For each group and term: occurrences, and texts with the term."""
    words, owner = _terms(texts)
    n = max(len(words.dictionary), 1)
    code = words.indices.to_numpy().astype(np.int64)
    pairs, times = np.unique(owner * n + code, return_counts=True)  # one for each text and term
    of = group.indices.to_numpy().astype(np.int64)
    keys, back = np.unique(of[pairs // n] * n + pairs % n, return_inverse=True)
    total = np.bincount(back, times, len(keys)).astype(np.int64)
    g = group.dictionary.take(pa.array(keys // n))
    columns = [g.field(0), g.field(1), words.dictionary.take(pa.array(keys % n)).cast(pa.string()), pa.array(total), pa.array(np.bincount(back, minlength=len(keys)))]
    return pa.table(columns, ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition, summed before they are handed on; at most a few HELD_ROWS are held."""
    held: list[pa.Table] = []
    rows = 0

    def summed() -> pa.Table:
        got = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return got.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        for a, b, texts in text_slices(batch.column("text"), _SLICE):
            held.append(_count(texts, _encoded(group[a:b])))
            rows += held[-1].num_rows
            if rows > 2 * HELD_ROWS:
                held = [summed()]
                rows = held[0].num_rows
                if rows > HELD_ROWS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from summed().to_batches()


def _encoded(groups: pa.StructArray) -> pa.DictionaryArray:
    """Structs of two texts by number."""
    left, right = groups.field(0).dictionary_encode(), groups.field(1).dictionary_encode()
    n = max(len(right.dictionary), 1)
    both, back = np.unique(left.indices.to_numpy().astype(np.int64) * n + right.indices.to_numpy(), return_inverse=True)
    values = pa.StructArray.from_arrays([left.dictionary.take(pa.array(both // n)), right.dictionary.take(pa.array(both % n))], ["lang", "source"])
    return pa.DictionaryArray.from_arrays(pa.array(back.astype(np.int32)), values)


def _filled(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row for each source and kept term that it holds: lang, source, term, n; lang_n (in all sources), and the keys that order the vocabulary.

    One shuffle by language and term, of counts that tasks have summed: sums by group, by term and the order's keys need no other.
    """
    part = _filled(docs, "lang", "source", "text").mapInArrow(_counted, _COUNTED).repartition("lang", "term")
    counts = part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = counts.withColumns({
        "lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "holders": F.count("*").over(term), "lead": F.min(F.struct("source", "n")).over(term),
        "mark": F.bit_xor(F.xxhash64("source", "n")).over(term),
    })
    return rows.where(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs")


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every lang and source of docs, with total (N) and vocabulary (V, the language's kept terms), 0 where there are none."""
    groups = _filled(docs, "lang", "source").distinct()
    n = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A term's first source stands for the term.
    v = terms.where(F.col("lead.source") == F.col("source")).groupBy("lang").agg(F.count("*").alias("vocabulary"))
    return groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["total", "vocabulary"])


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 vocabulary)) in whole numbers: three digits at a time, so that nothing overflows below 9 * 10**15."""
    whole = total + 2 * vocabulary
    digits, rest = _quotient(n + 2, whole), (n + 2) % whole
    for _ in range(3):
        digits, rest = digits * 1000 + _quotient(rest * 1000, whole), (rest * 1000) % whole
    return digits + 1


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _shares(n: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """As ``share``."""
    whole = total + 2 * vocabulary
    digits, rest = np.divmod(n + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        digits = digits * 1000 + more
    return digits + 1


def apart(p, q):
    """floor((p - q)**2 / (p + q)); columns or arrays of whole numbers to about 10**9."""
    if isinstance(p, Column):
        return _quotient((p - q) * (p - q), p + q)
    return (p - q) ** 2 // (p + q)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in vocabulary order to run-length columns: one row for each block of terms and source that holds one of them.

    Rows of a term are together and those of a language too; a block ends with its language or its partition.
    """
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    names = ["lang", "block", "size", "source", "starts", "counts"]
    lang, last, at = None, None, -1
    held: dict[str, list[tuple[int, int]]] = {}

    def closed() -> pa.RecordBatch:
        block = (task << 32) + number
        runs = [_runs(held[s], at + 1) for s in held]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(held)), pa.array([block] * len(held), pa.int64()), pa.array([at + 1] * len(held), pa.int32()), pa.array(list(held)), pa.array([r[0] for r in runs], pa.list_(pa.int32())), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], names)

    for batch in batches:
        for x, s, t, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "term", "n")), strict=True):
            if x != lang or t != last:
                if held and (x != lang or at + 1 >= size):
                    yield closed()
                    held, at, number = {}, -1, number + 1
                lang, last, at = x, t, at + 1
            held.setdefault(s, []).append((at, n))
    if held:
        yield closed()


def _runs(places: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal counts starts, and its count; terms that are not listed count 0."""
    row = np.zeros(size, np.int64)
    at, n = np.array(places, np.int64).T
    row[at] = n
    starts = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    return starts, row[starts]


def run_length_columns(terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, block, size (terms of the block), source, starts, counts: the columns of the sources that hold a term of the block."""
    order = ["lang", "holders", "lead", "mark", "term"]
    dealt = terms.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("lang", "source", "term", "n").mapInArrow(partial(_blocks, size=block), "lang string, block long, size int, source string, starts array<int>, counts array<long>")


def _compared(table: pa.Table) -> pa.Table:
    """For each two sources of a block the sum of f: stretches between the merged ends of their runs, times their lengths.

    a is the first of the two by name in every block, in whatever order their rows come, so that a pair has one sum.
    """
    table = table.sort_by("source")
    size = table.column("size")[0].as_py()
    names, starts, counts = (table.column(c).to_pylist() for c in ("source", "starts", "counts"))
    totals, sizes = table.column("total").to_pylist(), table.column("vocabulary").to_pylist()
    columns = []
    for at, n, total, vocabulary in zip(starts, counts, totals, sizes, strict=True):
        at, n = (np.array(x if x else [0], np.int64) for x in (at, n))
        columns.append((at, _shares(n, total, vocabulary) if vocabulary else n))
    out: list[tuple[int, int, int]] = []
    for i, (at, p) in enumerate(columns):
        for j in range(i + 1, len(columns)):
            bt, q = columns[j]
            ends = np.union1d(at, bt)
            f = apart(p[np.searchsorted(at, ends, "right") - 1], q[np.searchsorted(bt, ends, "right") - 1])
            out.append((i, j, int((f * np.diff(ends, append=size)).sum()) if size else 0))
    lang = table.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(out), pa.string()), pa.array([names[i] for i, _, _ in out], pa.string()), pa.array([names[j] for _, j, _ in out], pa.string()), pa.array([v for *_, v in out], pa.int64())], ["lang", "a", "b", "value"])


def pair_divergence(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language, both ways. columns: run_length_columns; totals: group_totals."""
    blocks = columns.select("lang", "block", "size").distinct()
    none = totals.where("vocabulary = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("size")).distinct()
    every = blocks.union(none).join(totals, "lang").join(columns.drop("size"), ["lang", "block", "source"], "left")
    sums = every.groupBy("lang", "block").applyInArrow(_compared, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def term_divergence(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value for terms that a group uses more than its language does."""
    whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    of = terms.select("lang", "source", "term", "n", "lang_n").join(totals.join(whole, "lang"), ["lang", "source"])
    p = of.withColumns({"p": share(F.col("n"), F.col("total"), F.col("vocabulary")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))})
    return p.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs, and each group's ``top`` terms."""
    terms = written(kept_terms(docs, least_docs), "kept-terms")
    totals = written(group_totals(docs, terms), "group-totals")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    pairs = pair_divergence(written(run_length_columns(terms), "run-length-columns"), totals)
    return ranked(pairs, "pair").union(ranked(term_divergence(terms, totals), "term").where(F.col("rank") <= top))

"""Language of a text by interpolated Kneser-Ney models over characters, one for each language of the labels.

A text is its letters, lower-cased, with one space for whatever stands between them and four in front. Tasks count
windows of ORDER characters over all texts that may be learned from; shorter windows count, as Kneser and Ney have it,
by how many characters stand before them. A window w after context h has
    p(w | h) = max(c(hw) - D, 0) / c(h) + rest(h) p(w | h without its first character),
D from the windows seen once and twice. What a language keeps of each length are the windows with at least
1 / (WINDOWS / languages) of its counts, so all languages together hold at most WINDOWS of a length however large the
corpus is; what is left out goes to rest(h), which keeps the sum at one. A model is sorted arrays of window hashes with
first terms, and of context hashes with rests; it is what the driver gathers and every task gets.

The language with the lowest cross-entropy by character wins. One in EIGHTH learnable documents is not counted and
calibrates: a logistic curve over the lead on the second language gives the score, the chance that the choice is
right, and a normal spread of cross-entropies by length gives the limit beyond which a text is rejected.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a null lang teaches nothing; a null doc_id is
neither held out nor learned from; equal cross-entropies go to the first language by name; repeated rows count as
often as they stand; very long texts are read whole; other columns are ignored; without any learnable text all rows
are ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reports import median_by_class
from ._text import kept as written
from ._text import mix, releasing, slices

ORDER = 5
#: Windows of each length that the model holds, at most, for all languages together.
WINDOWS = 1 << 20
EIGHTH = 8
NONE = "und"
#: Share of calibrating texts beyond the limit.
BEYOND = 0.001
_SLICE = 2 << 20
_HELD_ROWS = 400_000
#: Bytes of windows that a worker keeps with their probabilities.
_KNOWN_BYTES = 64 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _calibrating(doc_id: Column) -> Column:
    return F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 4) % EIGHTH == 0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points that are read of some texts, and the text of each."""
    front = " " * (ORDER - 1)
    ready = [f"{front}{t.lower()} " for t in texts]
    raw = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, ready), np.int64, len(ready))
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a letter is the space
    first = np.cumsum(lengths) - lengths
    for k in range(ORDER - 1):
        keep[first + k] = True
    return np.where(letter, raw, 32)[keep], np.repeat(np.arange(len(texts)), lengths)[keep]


def window_hash(points: np.ndarray) -> np.ndarray:
    """64 bits for each row of code points."""
    out = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        out = out * _BASE + points[:, k].astype(np.uint64) + np.uint64(1)
    return mix(out)


def _windows(texts: list[str], salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ORDER characters: the text of each, its number among the distinct ones, those as code points and their hashes. salt: a number for each text that tells its windows from others'."""
    points, owner = characters(texts)
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[ORDER - 1 :])
    key = np.zeros(n, np.uint64)
    for k in range(ORDER):
        key = key * _BASE + points[k : n + k].astype(np.uint64) + np.uint64(1)
    key = mix(key[at])
    if salt is not None:
        key ^= salt[owner[at]]
    found = pa.array(key).dictionary_encode()
    number, hashes = found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()
    place = np.zeros(len(hashes), np.int64)
    place[number[::-1]] = at[::-1]  # where each is first
    return owner[at], number, points[place[:, None] + np.arange(ORDER)], hashes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a partition by language; summed before they are handed on."""
    held: list[pa.Table] = []
    rows = 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "gram"]).aggregate([("n", "sum")]).select(["lang", "gram", "n_sum"]).rename_columns(["lang", "gram", "n"])

    for batch in releasing(batches):
        for a, b, texts in _texts(batch.column("text")):
            langs = batch.column("lang")[a:b].dictionary_encode()
            code = langs.indices.to_numpy().astype(np.int64)
            owner, number, grams, _ = _windows(texts, mix(code.astype(np.uint64) + np.uint64(1)))
            times = np.bincount(number, minlength=len(grams))
            of = np.zeros(len(grams), np.int64)
            of[number] = code[owner]
            names = np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel()
            held.append(pa.table([langs.dictionary.take(pa.array(of)), pa.array(names.tolist(), pa.string()), pa.array(times)], ["lang", "gram", "n"]))
            rows += held[-1].num_rows
            if rows > 2 * _HELD_ROWS:
                held = [summed()]
                rows = held[0].num_rows
                if rows > _HELD_ROWS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from summed().to_batches()


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows of about a slice of text each, those of one range held at a time."""
    sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
    for a, b in slices([range(n) for n in sizes], _SLICE):
        yield a, b, [t or "" for t in column[a:b].to_pylist()]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram to its hash."""
    for batch in batches:
        grams = batch.column("gram").to_pylist()
        hashes = np.zeros(len(grams), np.uint64)
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        for n in np.unique(sizes):
            of = np.flatnonzero(sizes == n)
            points = np.frombuffer("".join(grams[i] for i in of).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(of), n) if n else np.zeros((len(of), 0), np.uint32)
            hashes[of] = window_hash(points)
        rest = [c for c in batch.schema.names if c != "gram"]
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *(batch.column(c) for c in rest)], ["hash", *rest])


@dataclass
class Model:
    """first[l][k], rest[l][k]: sorted hashes and values of windows and contexts of k + 1 and k characters."""

    langs: list[str]
    first: list[list[tuple[np.ndarray, np.ndarray]]]
    rest: list[list[tuple[np.ndarray, np.ndarray]]]
    letters: int = 1
    curve: tuple[float, float] = (0.0, 0.0)
    spread: list[tuple[float, float, float]] = field(default_factory=list)  # mean, and variance as a + b / length, by language
    limit: float = np.inf

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Of each window's last character after the others, a column for each language."""
        n = grams.shape[1]
        windows = [window_hash(grams[:, n - k - 1 :]) for k in range(n)]
        contexts = [window_hash(grams[:, n - k - 1 : n - 1]) for k in range(n)]
        out = np.empty((len(grams), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            p = np.full(len(grams), 1.0 / (self.letters + 1))
            for k in range(n):
                p = _lookup(*self.first[i][k], windows[k], 0.0) + _lookup(*self.rest[i][k], contexts[k], 1.0) * p
            out[:, i] = np.log(np.maximum(p, 1e-12))
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


class Scorer:
    """Cross-entropies under a model; windows met before keep their probabilities, up to _KNOWN_BYTES."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)), np.float32)

    def _log_p(self, grams: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = self.keys[at] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        if not new.any():
            return self.values[at]
        if self.values.nbytes + self.keys.nbytes > _KNOWN_BYTES:
            self._forget()
            new = np.ones(len(hashes), bool)
        keys, values = np.concatenate([self.keys, hashes[new]]), np.concatenate([self.values, self.model.log_p(grams[new])])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        return self.values[np.searchsorted(self.keys, hashes)]

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and its mean -log p by language (rows of texts)."""
        owner, number, grams, hashes = _windows(texts)
        n = np.bincount(owner, minlength=len(texts))
        table = self._log_p(grams, hashes)
        sums = np.stack([np.bincount(owner, table[:, i][number], len(texts)) for i in range(table.shape[1])], 1)
        return n, -sums / np.maximum(n, 1)[:, None]


def window_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of docs with a lang."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def window_levels(counts: DataFrame) -> DataFrame:
    """k, lang, gram, n: the counts, and for each shorter length how many distinct windows that are one longer end in a window."""
    level, out = counts, counts.select(F.lit(ORDER).alias("k"), "lang", "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        out = out.union(level.select(F.lit(k).alias("k"), "lang", "gram", "n"))
    return out


def terms(levels: DataFrame, per: DataFrame, least: float) -> DataFrame:
    """k, lang, part, gram, value: first terms of the kept windows (part 0) and rests of their contexts (part 1). per: k, lang, all, off."""
    kept = F.when(F.col("n") >= F.col("all") * least, F.struct("gram", (F.col("n") - F.col("off")).alias("over")))
    rows = levels.join(per.select("k", "lang", "all", "off"), ["k", "lang"]).select("k", "lang", F.expr("substring(gram, 1, k - 1)").alias("context"), "n", kept.alias("kept"))
    by = rows.groupBy("k", "lang", "context").agg(F.sum("n").alias("total"), F.sum("kept.over").alias("over"), F.collect_list("kept").alias("kept")).where(F.size("kept") > 0)
    first = F.transform("kept", lambda w: F.struct(F.lit(0).alias("part"), w["gram"].alias("gram"), (w["over"] / F.col("total")).alias("value")))
    rest = F.struct(F.lit(1).alias("part"), F.col("context").alias("gram"), (1 - F.col("over") / F.col("total")).alias("value"))
    return by.select("k", "lang", F.inline(F.concat(first, F.array(rest))))


def fit(docs: DataFrame) -> Model:
    """The model of all learnable texts, with its curve and limit. docs: doc_id, text, lang."""
    learnable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = written(window_counts(learnable.where(~_calibrating(F.col("doc_id")))), "windows")
    levels = written(window_levels(counts), "window-levels")
    off = F.coalesce(F.try_divide(F.col("once"), F.col("once") + 2 * F.col("twice")), F.lit(0.5))
    per = levels.groupBy("k", "lang").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    per = per.withColumn("off", F.greatest(F.lit(0.1), F.least(F.lit(0.9), off)))
    langs = sorted(r["lang"] for r in per.where("k = 1").select("lang").collect())
    if not langs:
        return Model([], [], [])
    rows = terms(levels, per, len(langs) / WINDOWS).select("gram", "lang", "k", "part", "value")
    got = rows.mapInArrow(_hashed, "hash long, lang string, k int, part int, value double").toArrow()
    columns = {c: got.column(c).to_numpy() for c in ("hash", "k", "part", "value")}
    code = np.searchsorted(np.array(langs), got.column("lang").to_numpy(zero_copy_only=False).astype(str))

    def arrays(i: int, k: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        of = np.flatnonzero((code == i) & (columns["k"] == k + 1) & (columns["part"] == part))
        keys = columns["hash"][of].view(np.uint64)
        order = np.argsort(keys)
        return keys[order], columns["value"][of][order]

    letters = len(np.unique(columns["hash"][(columns["k"] == 1) & (columns["part"] == 0)]))
    model = Model(langs, *([[arrays(i, k, part) for k in range(ORDER)] for i in range(len(langs))] for part in (0, 1)), letters=letters)
    _calibrate(model, learnable.where(_calibrating(F.col("doc_id"))))
    return model


def _calibrate(model: Model, docs: DataFrame) -> None:
    """Curve, spreads and limit from all of docs, by aggregates over their cross-entropies; the driver gets sums, a row for each language, and the share BEYOND of rows that the limit is between."""
    spark = docs.sparkSession
    rows = written(_entropies(docs.where("text is not null"), model, "lang string").where("n > 0"), "calibration")
    points = rows.select(F.log1p(F.least(F.col("lead") * F.col("n"), F.lit(1e6))).alias("x"), (F.col("best") == F.col("lang")).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), float(w[0]) * x + float(w[1])))))
        v = p * (1 - p) + 1e-9
        sums = [s or 0.0 for s in points.agg(F.sum(x * (p - y)), F.sum(p - y), F.sum(x * x * v), F.sum(x * v), F.sum(v)).first()]
        # Two made-up rows without a lead, one of them wrong, keep the curve finite.
        even = 1 / (1 + np.exp(-np.clip(w[1], -30, 30)))
        gradient = np.array([sums[0], sums[1] + 2 * even - 1])
        curvature = np.array([[sums[2], sums[3]], [sums[3], sums[4] + 2 * (even * (1 - even) + 1e-9)]])
        step = np.linalg.solve(curvature + 1e-3 * np.eye(2), gradient + 1e-3 * w)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-10:
            break
    model.curve = (float(max(w[0], 0.0)), float(w[1]))
    own = rows.where("best = lang").select("lang", "entropy", (1 / F.col("n")).alias("inverse"), F.least("n", F.lit(1000)).alias("weight"))
    means = own.groupBy("lang").agg(F.count("*").alias("there"), (F.sum(F.col("entropy") * F.col("weight")) / F.sum("weight")).alias("mean")).where("there >= 3")
    square = own.join(F.broadcast(means), "lang").withColumn("square", F.pow(F.col("entropy") - F.col("mean"), F.lit(2)))
    slope = F.greatest(F.covar_samp("inverse", "square") / F.greatest(F.var_samp("inverse"), F.lit(1e-12)), F.lit(0.0))
    slopes = square.groupBy("lang").agg(F.first("mean").alias("mean"), slope.alias("slope"))
    flat = square.join(F.broadcast(slopes.select("lang", "slope")), "lang").select("lang", (F.col("square") - F.col("slope") * F.col("inverse")).alias("flat"))
    found = {r["lang"]: r for r in slopes.join(median_by_class(flat, "lang", "flat").withColumnRenamed("kind", "lang"), "lang").collect()}
    model.spread = [(found[x]["mean"], max(found[x]["median_score"], 1e-4), found[x]["slope"]) if x in found else (0.0, np.inf, 0.0) for x in model.langs]
    spread = spark.createDataFrame([(lang, *map(float, s)) for lang, s in zip(model.langs, model.spread, strict=True)], "best string, mean double, base double, slope double")
    far = rows.join(F.broadcast(spread), "best").select(((F.col("entropy") - F.col("mean")) / F.sqrt(F.col("base") + F.col("slope") / F.col("n"))).alias("far"))
    there = far.count()
    at = (1 - BEYOND) * (there - 1)
    top = [r["far"] for r in far.orderBy(F.desc("far")).limit(there - int(at)).collect()] if there else []
    model.limit = max(4.0, float(top[-1] + (at - int(at)) * (top[max(len(top) - 2, 0)] - top[-1]))) if top else np.inf


def _deviation(model: Model, n: np.ndarray, entropy: np.ndarray, best: np.ndarray) -> np.ndarray:
    """How many spreads a text's cross-entropy is above its language's mean."""
    spread = np.array(model.spread).reshape(-1, 3)[best]
    return (entropy - spread[:, 0]) / np.sqrt(spread[:, 1] + spread[:, 2] / np.maximum(n, 1))


def _scored(batches: Iterator[pa.RecordBatch], model, also: list[str]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model.value)
    m = scorer.model
    for batch in releasing(batches):
        for a, b, texts in _texts(batch.column("text")):
            n, h = scorer.cross_entropy(texts)
            best = h.argmin(1)
            lowest = h[np.arange(len(h)), best]
            if len(m.langs) > 1:
                lead = np.partition(h, 1, 1)[:, 1] - lowest
            else:
                lead = np.full(len(h), np.inf)
            score = 1 / (1 + np.exp(-np.clip(m.curve[0] * np.log1p(np.minimum(lead * n, 1e6)) + m.curve[1], -30, 30)))
            far = _deviation(m, n, lowest, best) > m.limit if m.spread else np.zeros(len(h), bool)
            none = n == 0
            names = np.array([*m.langs, NONE], object)[np.where(none, len(m.langs), best)]
            out = [pa.array(names.tolist(), pa.string()), pa.array(n.astype(np.int64)), pa.array(np.where(none, 0.0, lowest)), pa.array(np.where(none, 0.0, np.minimum(lead, 1e6))), pa.array(np.where(none, 0.0, score)), pa.array(none | far)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in also), *out], [*also, "best", "n", "entropy", "lead", "score", "rejected"])


def _entropies(docs: DataFrame, model: Model, also: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in also.split(", ")]
    rows = docs.select(*(F.col(n).cast(c.split()[1]).alias(n) for n, c in zip(names, also.split(", "), strict=True)), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scored, model=sent, also=names), f"{also}, best string, n long, entropy double, lead double, score double, rejected boolean")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats a character), chars (that were read) and rejected, for every row; no shuffle."""
    if not model.langs:
        none = F.lit(0.0)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(NONE).alias("lang_pred"), none.alias("score"), none.alias("cross_entropy"), F.lit(0).cast("long").alias("chars"), F.lit(True).alias("rejected"))
    got = _entropies(docs, model, "doc_id long")
    return got.select("doc_id", F.col("best").alias("lang_pred"), "score", F.col("entropy").alias("cross_entropy"), F.col("n").alias("chars"), "rejected")


def language(docs: DataFrame) -> DataFrame:
    """fit on what may be learned from, then identify all rows: doc_id, held_out, lang_pred, score, cross_entropy, chars, rejected."""
    got = identify(docs, fit(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "chars", "rejected")

"""Quality by hierarchical empirical Bayes: a text's own evidence on top of what its site is like.

A logistic classifier on measures of the text gives each document's log odds against the overall rate.
Labelled documents, counted by site and by part of a site, give each a posterior rate: a site's rate is
shrunk toward the overall one, a part's toward its site's, the more so the fewer labels it has. How
strongly is found from the spread of the rates themselves (method of moments). The score is the logistic
of evidence plus the posterior's log odds.

Sites are hosts and parts are first steps of paths where the site column holds addresses; elsewhere a site is
its value and a second column (lang, on the given tables) stands in for the path.

Defined cases: a null or empty text has its own measures (no words) and is scored by them; a null site or
part is a site or part of its own; labels without a document, and null labels, count nowhere; a document
labelled twice counts once, as its higher label; without both labels the score is the overall rate's and
all rows are kept; very long texts are measured whole; a score of exactly THRESHOLD keeps; repeated rows are
scored each; other columns stay, whatever their names, but for those that the results replace; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import kept as written
from ._text import private, releasing, text_slices
from .repetition import AGAIN, TOP, measure

#: Labelled texts that the classifier is fitted on, at most; posteriors count all labels.
TRAIN_ROWS = 16_000
#: Parts of sites whose posteriors are broadcast, at most; more are joined by a shuffle.
BROADCAST_PARTS = 20_000
THRESHOLD = 0.5
FEATURES = ["words", "word_length", "symbols", "dup_lines", "dup_line_chars", "repeats", *(f"top_{n}" for n in TOP), *(f"again_{n}" for n in AGAIN), "upper", "digits", "bars", "ends"]
_UPPER, _DIGIT, _LETTER = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = _LETTER[65:91] = _LETTER[97:123] = True


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    m = measure(texts)
    words = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    letters = np.array([max(int(_LETTER[b].sum()), 1) for b in raw])
    columns = [
        np.log1p(m["n_words"]),
        m["word_chars"] / words,
        np.minimum(m["n_symbols"] / words, 3),
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        m["dup_line_chars"] / chars,
        m["n_repeat_words"] / words,
        *(m[f"top_{n}"] for n in TOP),
        *(m[f"again_{n}"] for n in AGAIN),
        np.array([int(_UPPER[b].sum()) for b in raw]) / letters,
        np.array([int(_DIGIT[b].sum()) for b in raw]) / chars,
        np.array([t.count(b" | ") for t in texts]) / words,
        np.array([t.count(b".") for t in texts]) / words,
    ]
    return np.stack(columns, 1) if len(texts) else np.zeros((0, len(FEATURES)))


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Against the overall rate."""
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


def _fit(rows: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> Classifier:
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    x = np.c_[np.clip((rows - mean) / scale, -8, 8), np.ones(len(rows))]
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    prior = float(np.log(y.mean() / (1 - y.mean())))
    w = np.zeros(x.shape[1])
    w[-1] = prior

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * w * w).sum() / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        rate = 1.0
        while rate > 1e-5 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]) - prior)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in releasing(batches):
        for a, b, texts in text_slices(batch.column("text")):
            rows = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("quality")[a:b], pa.array(rows.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "row"])


def _labels(labels: DataFrame) -> DataFrame:
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier | None:
    """From at most ``rows`` labelled texts, chosen by a hash of doc_id; None without both labels."""
    usable = _labels(labels)
    there = usable.count()
    if there > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(0.97 * rows / there * 1_000_003))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(usable), "doc_id").select("doc_id", "text", "quality")
    # A doc_id with several rows counts once, by its least ones: as many rows come to the driver as labels were chosen.
    got = train.mapInArrow(_train_rows, "doc_id long, quality int, row array<double>").groupBy("doc_id", "quality").agg(F.min("row").alias("row")).toPandas()
    y = got["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return _fit(np.array(got["row"].tolist()), y)


def _key(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("\0"))


def _address(site: str) -> Column:
    """Without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.col(site).cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")


def site_of(site: str) -> Column:
    """The host, or whatever stands before the first slash."""
    return _key(F.split(_address(site), "/")[0])


def part_of(site: str, part: str) -> Column:
    """The first step of the path; another column stands in where the site names no path."""
    step = F.split(_address(site), "/")
    return F.coalesce(F.concat(F.lit("/"), F.nullif(F.try_element_at(step, F.lit(2)), F.lit(""))), _key(F.col(part)))


def _strength(counts: DataFrame, rate: Column, good: Column, n: Column) -> float:
    """Labels that the upper level's rate is worth, from the spread of the rates around it."""
    seen = good / n
    got = counts.where(n > 0).agg(F.sum(n * (seen - rate) * (seen - rate)).alias("spread"), F.sum(rate * (1 - rate)).alias("noise"), F.sum(n).alias("n"), F.sum(n * rate * (1 - rate)).alias("within")).first()
    if not got["n"] or not got["within"]:
        return 1e4
    between = (got["spread"] - got["noise"]) / got["n"]  # of the rates, without what chance alone would give
    return float(min(max(got["within"] / got["n"] / between - 1, 2.0), 1e4)) if between > 0 else 1e4


def site_posteriors(docs: DataFrame, labels: DataFrame, site: str = "source", part: str = "lang") -> tuple[DataFrame, float]:
    """__site, __part, n_labels, site_rate, part_rate for every host and path with documents; and the overall rate.

    Where the site has no path the column part stands in for it. A part without labels takes its site's rate, a site without labels the overall one.
    """
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site_of(site).alias("__site"), part_of(site, part).alias("__part"))
    parts = placed.join(_labels(labels), "doc_id", "left").groupBy("__site", "__part").agg(F.count("quality").alias("n_labels"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))
    parts = written(parts, "parts")
    total = parts.agg(F.sum("n_labels").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total["good"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    sites = parts.groupBy("__site").agg(F.sum("n_labels").alias("site_n"), F.sum("good").alias("site_good"))
    m = _strength(sites, F.lit(overall), F.col("site_good"), F.col("site_n"))
    sites = sites.withColumn("site_rate", (F.col("site_good") + m * overall) / (F.col("site_n") + m)).select("__site", "site_rate")
    both = parts.join(sites, "__site")
    m = _strength(both, F.col("site_rate"), F.col("good"), F.col("n_labels"))
    rate = (F.col("good") + m * F.col("site_rate")) / (F.col("n_labels") + m)
    return written(both.select("__site", "__part", "n_labels", "site_rate", rate.alias("part_rate")), "posteriors"), overall


RESULTS = ["evidence", "site_rate", "part_rate", "quality_score", "kept"]


def _scored(docs: DataFrame, labels: DataFrame, site: str, part: str) -> tuple[DataFrame, list[str]]:
    """docs with RESULTS under names of their own, and these."""
    model = fit_classifier(docs, labels)
    posteriors, overall = site_posteriors(docs, labels, site, part)
    if model is None:
        evidence = F.lit(0.0)
    else:

        @F.arrow_udf("double")
        def log_odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in releasing(batches):
                yield pa.array(np.concatenate([np.zeros(0), *(model.log_odds(features(texts)) for _, _, texts in text_slices(column))]))

        evidence = log_odds(F.col("text").cast("string"))
    few = posteriors.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    names = private(docs, *RESULTS, "site", "part", "of_site", "of_part")
    evidence_, site_rate, part_rate, quality, kept, s, p, of_site, of_part = names
    rates = posteriors.select(F.col("__site").alias(of_site), F.col("__part").alias(of_part), F.col("site_rate").alias(site_rate), F.col("part_rate").alias(part_rate))
    keyed = docs.withColumns({s: site_of(site), p: part_of(site, part), evidence_: evidence})
    joined = keyed.join(F.broadcast(rates) if few else rates, (F.col(s) == F.col(of_site)) & (F.col(p) == F.col(of_part)), "left")
    rate = F.least(F.greatest(F.coalesce(part_rate, F.lit(overall)), F.lit(1e-4)), F.lit(1 - 1e-4))
    scored = joined.withColumn(quality, 1 / (1 + F.exp(-(F.col(evidence_) + F.log(rate / (1 - rate))))))
    return scored.withColumn(kept, F.lit(True) if model is None else F.col(quality) >= THRESHOLD).drop(s, p, of_site, of_part), names[: len(RESULTS)]


def score(docs: DataFrame, labels: DataFrame, site: str = "source", part: str = "lang") -> DataFrame:
    """docs with evidence, site_rate, part_rate, quality_score and kept; columns of these names in docs are replaced."""
    scored, names = _scored(docs, labels, site, part)
    others = [c for c in docs.columns if c.lower() not in RESULTS]
    return scored.select(*others, *(F.col(n).alias(r) for n, r in zip(names, RESULTS, strict=True)))


def accepted(docs: DataFrame, labels: DataFrame, site: str = "source", part: str = "lang") -> DataFrame:
    """The rows of docs that the score keeps, with their own columns."""
    scored, names = _scored(docs, labels, site, part)
    return scored.where(F.col(names[-1])).select(*docs.columns)

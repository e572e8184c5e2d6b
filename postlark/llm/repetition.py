"""Quality rules: how much of a text repeats itself.

Word windows of several lengths are compared by rolling 64-bit hashes in numpy. For each length the
characters of words inside windows that occur twice or more are measured, or, for short lengths,
the characters that the most frequent window takes; lines that equal an earlier line are measured too.

Defined cases: a null or empty text has no words and fails the base rule; rows with the same doc_id
are judged each on its own, repeated rows each alike; a null doc_id stays null; very long texts are
measured whole; of windows that are as frequent, that which takes the most characters counts; a measure
at its limit passes; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, mix, rolled, text_slices, windows

#: Share of word characters that the most frequent window of n words may take.
TOP = {2: 0.25, 3: 0.25, 4: 0.25}
#: Share of word characters inside windows of n words that occur again.
AGAIN = {5: 0.30, 7: 0.25, 10: 0.20}
DUP_LINE_SHARE, DUP_LINE_CHARS = 0.30, 0.20
#: Fewer equal lines than this do not count: a short text may well say one line twice.
DUP_LINES = 3
SYMBOLS_PER_WORD = 0.10
MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = [
    *[(x, "long") for x in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words")],
    *[(f"top_{n}", "double") for n in TOP],
    *[(f"again_{n}", "double") for n in AGAIN],
]


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and the latter's characters."""
    seen, n, dup, chars = set(), 0, 0, 0
    for line in text.decode().split("\n"):
        if not line.strip("\x20\t\n\x0b\x0c\r"):
            continue
        n += 1
        if line in seen:
            dup += 1
            chars += len(line)
        else:
            seen.add(line)
    return n, dup, chars


def _covered(again: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the marked windows."""
    depth = np.zeros(size + 1, np.int32)
    depth[: len(again)] += again
    depth[n : n + len(again)] -= again
    return np.cumsum(depth[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of MEASURES for some texts."""
    w, n_texts = Words(texts), len(texts)
    hashes, chars = w.hashes(), w.chars()
    total = np.bincount(w.text, chars, n_texts)
    symbols = np.flatnonzero(_SYMBOL[w.bytes])
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 3)
    out = {
        "n_words": w.n_words,
        "word_chars": total.astype(np.int64),
        "n_symbols": np.bincount(np.searchsorted(w.text_start, symbols, "right") - 1, minlength=n_texts),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "dup_line_chars": lines[:, 2],
    }
    safe = np.maximum(total, 1)
    salt = mix(w.text.astype(np.uint64) + np.uint64(1))
    before, upto = None, np.concatenate([[0], np.cumsum(chars)])
    for n in sorted({3, *TOP, *AGAIN}):
        gram = rolled(hashes, n, before)
        before = (n, gram)
        ok = np.flatnonzero(windows(w.text, n))
        key = mix(gram[ok]) ^ salt[ok]
        order = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.diff(key[order], append=~key[order[-1:]]))
        runs = np.diff(ends, prepend=-1)
        again = np.zeros(max(len(w.start) - n + 1, 0), bool)
        again[ok[order]] = np.repeat(runs > 1, runs)
        words = _covered(again, n, len(w.start)) if again.any() else np.zeros(len(w.start), bool)
        if n == 3:
            out["n_repeat_words"] = np.bincount(w.text[words], minlength=n_texts)
        if n in TOP:
            first = ok[order[ends - runs + 1]] if len(ends) else ends
            took = np.where(runs > 1, runs * (upto[first + n] - upto[first]), 0)
            most = np.zeros(n_texts)
            np.maximum.at(most, w.text[first], took)
            out[f"top_{n}"] = np.minimum(most / safe, 1.0)
        if n in AGAIN:
            out[f"again_{n}"] = np.bincount(w.text[words], chars[words], n_texts) / safe
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"long": pa.int64(), "double": pa.float64()}
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text")):
            got = measure(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(got[k].astype("int64" if t == "long" else "float64"), types[t]) for k, t in MEASURES)], ["doc_id", *(k for k, _ in MEASURES)])


def repetition(docs: DataFrame) -> DataFrame:
    """The measures of every text, one row for each row of docs; one pass without a shuffle."""
    schema = "doc_id long, " + ", ".join(f"{k} {t}" for k, t in MEASURES)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measured, schema)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """repetition() with base_failed and kept.

    kept is false where the base rule fails, where repeated windows or lines take more than their
    share of the characters, or where there are too many symbols for the words.
    """
    m = repetition(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = [F.col(f"top_{n}") > most for n, most in TOP.items()] + [F.col(f"again_{n}") > most for n, most in AGAIN.items()]
    bad += [
        (F.col("n_dup_lines") >= DUP_LINES) & ((F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_lines")) | (F.col("dup_line_chars") > DUP_LINE_CHARS * F.col("word_chars"))),
        F.col("n_symbols") > SYMBOLS_PER_WORD * F.col("n_words"),
    ]
    judged = bad[0]
    for x in bad[1:]:
        judged = judged | x
    return m.withColumns({"base_failed": failed, "kept": ~failed & ~judged})

"""Repeated passages: words inside windows that an earlier document already has are removed.

Consecutive windows of a text that share a minimiser (the least hash of a few words in them) travel as
one packed string to the minimiser's bucket. There all windows are told apart by sorting: the first
document of each window keeps it, later ones lose the words it covers. Equal strings of a task meet
before they travel: only the one of the smallest doc_id does, the others are decided at once, so a
passage that very many documents share reaches its bucket once for each task's chunk, not for each document.

What is to be removed comes back with a hash of its words, so that it only hits rows which have those words
there: rows that share a doc_id, or have none, are told apart by their texts.

Defined cases: a null or empty text has no words; rows with the same doc_id never remove each other's
words; a null doc_id comes after all others; texts shorter than a window stay whole; very long texts are
taken whole; repeated rows lose the same words each; other columns, whatever their names, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, mix, rolled, text_slices, texts_of, windows

WINDOW = 13
MINIMISER = 3
#: Windows in one string, at most; a longer run goes on in the next one, to the same bucket.
STRING_WINDOWS = 512
#: Bytes of strings that a task holds before it packs them.
CHUNK_BYTES = 24 << 20
LAST = (1 << 63) - 1
#: Columns before the strings of a packed row, one after the other; doc holds differences, its rows ascend.
_COLUMNS = {"doc": "<i8", "text": "<i8", "first": "<i4", "windows": "<u2", "bytes": "<i4", "check": "<i8"}
PACKED = "bucket int, size long, data binary"


def text_key(doc: int, text: bytes) -> int:
    """Narrows down the rows of one doc_id when results come back: 16 bits for the few that share one, 63 for those without one."""
    return xxhash.xxh3_64_intdigest(text) & (LAST if doc == LAST else 0xFFFF)


def words_check(words: bytes | list[bytes]) -> int:
    """A signed 64-bit hash of some words, whatever stands between them."""
    words = words if isinstance(words, list) else words.split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _pack(heads: list[tuple[int, ...]], bodies: list[bytes]) -> bytes:
    """Each column byte by byte of its numbers, as their upper bytes are mostly alike; then the strings."""
    order = sorted(range(len(heads)), key=heads.__getitem__)
    columns = [np.array(c, k) for c, k in zip(zip(*(heads[i] for i in order), strict=True), _COLUMNS.values(), strict=True)]
    columns[0] = np.diff(columns[0], prepend=np.int64(0))
    planes = (c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(heads).to_bytes(8, "little") + b"".join(planes) + b"".join(bodies[i] for i in order)


def _unpack(raw: bytes) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The columns, and the strings of rows that have one."""
    n, at, head = int.from_bytes(raw[:8], "little"), 8, {}
    for name, kind in _COLUMNS.items():
        planes = np.frombuffer(raw, np.uint8, n * np.dtype(kind).itemsize, at).reshape(-1, n)
        head[name] = np.ascontiguousarray(planes.T).view(kind)[:, 0]
        at += planes.nbytes
    head["doc"] = np.cumsum(head["doc"])
    ends = (at + np.cumsum(head["bytes"])).tolist()
    return head, [raw[e - k : e] for e, k in zip(ends, head["bytes"].tolist(), strict=True) if k]


def super_windows(hashes: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a minimiser: first word, number of windows, minimiser."""
    ok = windows(text, window)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, size, want = mix(rolled(hashes, MINIMISER)), 1, window - MINIMISER + 1
    while size < want:
        step = min(size, want - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    least = least[: len(ok)]
    new = np.ones(len(ok), bool)
    new[1:] = (least[1:] != least[:-1]) | ~ok[:-1] | (text[1 : len(ok)] != text[: len(ok) - 1])
    place = np.arange(len(ok))
    begun = np.maximum.accumulate(np.where(new, place, 0))
    new |= (place - begun) % STRING_WINDOWS == 0
    firsts = np.flatnonzero(new & ok)
    ends = np.append(np.flatnonzero(new | ~ok), len(ok))
    counts = ends[np.searchsorted(ends, firsts, "right")] - firsts
    return firsts, counts, least[firsts]


class _Chunk:
    """Strings of a task until they are packed."""

    def __init__(self, buckets: int):
        self.buckets, self.bytes = buckets, 0
        #: For each string the smallest document that has it, and that document's places of it.
        self.best: dict[bytes, tuple[int, list[tuple[int, int, int, int]]]] = {}
        self.decided: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int, key: int, first: int, count: int, minimiser: int, body: bytes) -> None:
        place, have = (key, first, count, minimiser), self.best.get(body)
        self.bytes += 120
        if have is None:
            self.bytes += len(body)
            self.best[body] = (doc, [place])
        elif have[0] == doc:
            have[1].append(place)
        elif have[0] < doc:
            self.decided.append((doc, key, first, count, words_check(body)))
        else:
            self.decided += ((have[0], *p[:3], words_check(body)) for p in have[1])
            self.best[body] = (doc, [place])

    def packed(self) -> pa.RecordBatch:
        rows = defaultdict(lambda: ([], []))
        for body, (doc, places) in self.best.items():
            for key, first, count, minimiser in places:
                heads, bodies = rows[minimiser % self.buckets]
                heads.append((doc, key, first, count, len(body), 0))
                bodies.append(body)
        for doc, key, first, count, check in self.decided:  # nothing left to compare: dealt out evenly
            heads, bodies = rows[(doc ^ key) % self.buckets]
            heads.append((doc, key, first, count, 0, check))
            bodies.append(b"")
        codec, out = pa.Codec("zstd", 3), []
        for bucket, (heads, bodies) in rows.items():
            raw = _pack(heads, bodies)
            out.append((bucket, len(raw), codec.compress(raw, asbytes=True)))
        self.__init__(self.buckets)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "size", "data"])


def _strings(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    chunk = _Chunk(buckets)
    for batch in batches:
        ids = [LAST if x is None else x for x in batch.column("doc_id").to_pylist()]
        for a, b, texts in text_slices(batch.column("text")):
            w = Words(texts)
            firsts, counts, least = super_windows(w.hashes(), w.text, window)
            if not len(firsts):
                continue
            keys = [text_key(i, t) for i, t in zip(ids[a:b], texts, strict=True)]
            held = w.bytes.tobytes()
            row = w.text[firsts].tolist()
            before = np.cumsum(w.n_words) - w.n_words
            inside = (firsts - before[w.text[firsts]]).tolist()
            for r, f, n, m, s, e in zip(row, inside, counts.tolist(), least.tolist(), w.start[firsts].tolist(), w.end[firsts + counts + window - 2].tolist(), strict=True):
                chunk.add(ids[a + r], keys[r], f, n, m, held[s:e])
            if chunk.bytes >= CHUNK_BYTES:
                yield chunk.packed()
    if chunk.bytes:
        yield chunk.packed()


def _same(words: np.ndarray, at: np.ndarray, to: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows are word for word those at to."""
    out = np.ones(len(at), bool)
    for k in range(window):
        out &= words[at + k] == words[to + k]
    return out


def later_windows(docs: np.ndarray, bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Over strings of documents: runs of windows that a document before their own has.

    Each run's string, its first word there, the word after it, and the text from the one to the other.
    """
    w = Words(bodies)
    hashes = w.hashes()
    at = np.flatnonzero(windows(w.text, window))
    gram, doc = mix(rolled(hashes, window))[at], docs[w.text[at]]
    order = np.lexsort((doc, gram))
    gram, doc, at = gram[order], doc[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = gram[1:] != gram[:-1]
    run = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else at
    same = _same(hashes, at, at[run], window)
    late = (doc > doc[run]) & same
    for k in np.flatnonzero(~same):  # other words under one hash: looked at among themselves
        mates = np.flatnonzero((run == run[k]) & _same(hashes, at, np.full(len(at), at[k]), window))
        late[k] = doc[k] > doc[mates].min()
    at = np.sort(at[late])
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(w.text[at]) != 0)
    first = at[new]
    last = at[np.append(new[1:], True)] + window - 1 if len(at) else at
    held, before = w.bytes.tobytes(), np.cumsum(w.n_words) - w.n_words
    cut = [held[a:b] for a, b in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)]
    return w.text[first], first - before[w.text[first]], last + 1 - before[w.text[first]], cut


def _bucket(table: pa.Table, window: int) -> pa.Table:
    """doc, text, the words from start to stop (exclusive) to be removed, and their check."""
    codec, heads, bodies = pa.Codec("zstd"), [], []
    for size, data in zip(table.column("size").to_pylist(), table.column("data").to_pylist(), strict=True):
        head, strings = _unpack(codec.decompress(data, size, asbytes=True))
        heads.append(head)
        bodies += strings
    head = {k: np.concatenate([h[k] for h in heads]).astype(np.int64) for k in _COLUMNS}
    decided, open_ = ({k: v[pick] for k, v in head.items()} for pick in (head["bytes"] == 0, head["bytes"] > 0))
    out = [(decided["doc"], decided["text"], decided["first"], decided["first"] + decided["windows"] + window - 1, decided["check"])]
    if len(bodies):
        string, start, stop, cut = later_windows(open_["doc"], bodies, window)
        first = open_["first"][string]
        out.append((open_["doc"][string], open_["text"][string], first + start, first + stop, np.fromiter(map(words_check, cut), np.int64, len(cut))))
    doc, text, start, stop, check = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    return pa.table({"doc": doc, "text": text, "start": start.astype(np.int32), "stop": stop.astype(np.int32), "check": check})


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        ranges = batch.column("ranges")
        for text, cut in zip(texts_of(batch.column("text")), (r.as_py() for r in ranges), strict=True):
            words = text.split()
            n = len(words)
            cut = [c for c in cut or () if c["stop"] <= n and words_check(words[c["start"] : c["stop"]]) == c["check"]]
            if cut:
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, [c["start"] for c in cut], 1)
                np.add.at(gone, [c["stop"] for c in cut], -1)
                words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
            left = b" ".join(words)
            rows.append((n, n - len(words), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
        arrays = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays, names = [*arrays, pa.array([r[3] for r in rows], pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """doc, text (its key), start, stop, check: words that windows of earlier documents cover, in pieces that may overlap, and their hash.

    buckets: into how many the strings are dealt; by default eight for each shuffle partition, so that
    a bucket stays small as partitions are added for larger inputs.
    """
    buckets = buckets or max(256, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    strings = texts.mapInArrow(partial(_strings, window=window, buckets=buckets), PACKED)

    def bucket(table: pa.Table) -> pa.Table:
        return _bucket(table, window)

    return strings.groupBy("bucket").applyInArrow(bucket, "doc long, text long, start int, stop int, check long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column("doc").to_pylist()
        keys = [text_key(d, t) for d, t in zip(docs, texts_of(batch.column("text")), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the words left, for every row of docs."""
    cut = repeated_ranges(docs, window).groupBy(F.col("doc").alias("cut_doc"), F.col("text").alias("cut_key")).agg(F.collect_set(F.struct("start", "stop", "check")).alias("ranges"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.mapInArrow(_keyed, "doc long, doc_id long, text string, key long")
    both = texts.join(cut, (F.col("doc") == F.col("cut_doc")) & (F.col("key") == F.col("cut_key")), "left").select("doc_id", "text", "ranges")
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return both.mapInArrow(partial(_kept, with_text=with_text), columns)

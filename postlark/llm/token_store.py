"""Token ids in a packed file: patched frame of reference.

A segment holds the ids of whole documents, in blocks of BLOCK ids. Each block stores its least id
and the differences to it, packed at the width that a percentile of them needs; differences that are
wider keep their low bits in the block and their high bits in a list of exceptions. An index gives
each block's first byte, so a block can be read alone.

Layout, little-endian: "PFB1", uint32 ids, uint32 blocks, uint32 exceptions; then per block: least
id (uint32), first byte in the body (uint32), first exception (uint32), width (uint8); exception
positions (uint32), exception high parts (uint32); body.

Segments are written by Spark's Parquet writer as one binary value each, beside their doc_ids and
lengths: any Hadoop file system takes them, and a lost or repeated task leaves no half file.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first; rows with the
same doc_id follow each other by text, repeated rows too; very long texts are encoded whole, in parts, and may be
longer than a segment is meant to be; other columns, whatever their names, are dropped; an empty table gives an empty store.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pieces import BLANK, DIGIT, END, HARD, Interned, distinct, kinds, lowered, parts
from ._text import releasing, shared_folder, text_slices, worker_cache

BLOCK = 256
#: Share of a block's differences that fit its width.
WITHIN = 0.92
SEGMENT_IDS = 1 << 19
#: Pieces that a worker keeps with their ids.
KEPT_PIECES = 300_000
SLICE_BYTES = 2 << 20
#: Fixed values of the vocabulary file whose rules _Encoder follows by bytes; with other rules it encodes whole texts.
PLAIN_RULES = ["NFC", "Replace", "Lowercase"]
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How the vocabulary's special tokens begin.
SPECIAL = b"<|"
MAGIC = b"PFB1"


def _width(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))) + 1, 0).astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The image of some ids below 2**31."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = full[n - 1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(1) if blocks else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    at = min(int(np.ceil(WITHIN * BLOCK)), BLOCK) - 1
    width = _width(np.partition(diff, at, 1)[:, at]) if blocks else np.zeros(0, np.uint8)
    high = diff >> width[:, None].astype(np.uint32)
    where = np.flatnonzero(high)
    first_exception = np.searchsorted(where, np.arange(blocks) * BLOCK)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = diff[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)
        if w % 8 == 0:
            packed = packed[:, :, : w // 8].reshape(len(rows), -1)
        else:
            packed = np.packbits(np.unpackbits(packed, axis=2, count=int(w), bitorder="little").reshape(len(rows), -1), 1, "little")
        body[start[rows][:, None] + np.arange(packed.shape[1])] = packed
    head = np.array([n, blocks, len(where)], "<u4")
    parts = [low.astype("<u4"), start.astype("<u4"), first_exception.astype("<u4"), width, where.astype("<u4"), high.ravel()[where].astype("<u4"), body]
    return MAGIC + head.tobytes() + b"".join(x.tobytes() for x in parts)


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; all by default), by the index of block starts."""
    if image[:4] != MAGIC:
        raise ValueError("not a packed segment")
    n, blocks, exceptions = np.frombuffer(image, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    low, start, first_exception, width = take("<u4", blocks), take("<u4", blocks), take("<u4", blocks), take("u1", blocks)
    where, high = take("<u4", exceptions), take("<u4", exceptions)
    body = np.frombuffer(image, np.uint8, offset=at)
    last = blocks if last is None else min(last, blocks)
    out = np.zeros((last - first, BLOCK), np.uint32)
    wide = width[first:last]
    for w in np.unique(wide[wide > 0]).tolist():
        rows = np.flatnonzero(wide == w)
        packed = body[start[first:last][rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
        if w % 8:
            packed = np.packbits(np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w), axis=2, bitorder="little")
        low_bytes = packed.reshape(len(rows), BLOCK, -1)
        wide_bytes = np.zeros((len(rows), BLOCK, 4), np.uint8)
        wide_bytes[:, :, : low_bytes.shape[2]] = low_bytes
        out[rows] = wide_bytes.view("<u4")[:, :, 0]
    a = first_exception[first] if first < blocks else exceptions
    b = first_exception[last] if last < blocks else exceptions
    flat = out.reshape(-1)
    here = where[a:b].astype(np.int64) - first * BLOCK
    flat[here] |= high[a:b] << wide[here // BLOCK].astype(np.uint32)
    out += low[first:last, None]
    return flat[: min(n, last * BLOCK) - first * BLOCK]


class _Encoder:
    """Ids of the pieces that this worker has met, up to a bound.

    The vocabulary's rules take off case and blanks, then cut by its own pattern: letters, single digits,
    signs. Words in plain letters, digits and signs are cut so by their bytes; what stands between blanks
    and holds anything else goes to the tokenizer whole. New words go to the tokenizer's model many at a
    time, blanks between them: the token that ends each word tells them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        split, end = spec["pre_tokenizer"]["pretokenizers"][0], spec["model"]["end_of_word_suffix"]
        self.plain = bool(end) and split["pattern"].get("Regex") == PLAIN_SPLIT and [n["type"] for n in spec["normalizer"]["normalizers"]] == PLAIN_RULES
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # The vocabulary writes bytes as characters: printable ones as themselves, others from 256 on in their order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = np.arange(256, dtype="<u4")
        self.shown[hidden] = 256 + np.arange(len(hidden))
        self.shown[32] = 32
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if end and t.endswith(end)]] = True
        self.known = Interned(KEPT_PIECES)

    def _add_words(self, words: list[bytes]) -> None:
        """Pieces without blanks that the rules leave as they are."""
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            ids = np.array(self.model.encode_batch_fast([self.shown[np.frombuffer(b" ".join(some), np.uint8)].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                raise ValueError("the tokenizer does not end each word with one token")
            self.known.add(some, ids, np.diff(cuts, prepend=0))

    def _add_units(self, units: list[bytes]) -> None:
        for k in range(0, len(units), 20_000):
            some = units[k : k + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in some], add_special_tokens=False)]
            self.known.add(some, np.array([i for x in ids for i in x], np.int32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and how many each has."""
        known = self.known
        known.trim()
        if not self.plain:
            some = [t.decode() for t in texts]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
        raw, kind = kinds(texts, SPECIAL)
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == END)
        use = kind != BLANK
        kind, start = kind[use], np.flatnonzero(new[use])
        number, pieces = distinct(lowered(raw[use], kind), start)
        if b"\n" not in known.number:  # an END
            known.add([b"\n"], np.zeros(0, np.int32), np.zeros(1, np.int64))
        if fresh := known.missing(pieces):
            hard = {pieces[i] for i in np.unique(number[kind[start] == HARD]).tolist()}
            self._add_words([p for p in fresh if p not in hard])
            self._add_units([p for p in fresh if p in hard])
        ids, size = known.gather(known.numbers(pieces)[number])
        total = np.cumsum(size)[kind[start] == END]
        return ids, np.diff(total, prepend=0)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text and end_id, one text after the other, and how many each has."""
        count, found = np.ones(len(texts), np.int64), []
        for some, owner in parts(texts):
            ids, size = self._part(some)
            np.add.at(count, owner, size)
            found.append(ids)
        ends = np.cumsum(count) - 1
        out = np.full(int(count.sum()), end_id, np.int32)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = np.concatenate(found) if found else np.zeros(0, np.int32)
        return out, count


@worker_cache
def _encoder(path: str) -> _Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    return _Encoder(path)


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, part = _encoder(path), TaskContext.get().partitionId()
    done, number, held = 0, 0, 0
    docs: list[pa.Array] = []
    counts: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def segment() -> pa.RecordBatch:
        nonlocal done, number, held
        image = pack(np.concatenate(ids).view(np.uint32))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(docs), pa.array(np.concatenate(counts)))]
        columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([done], pa.int64()), pa.array([held], pa.int64()), *lists, pa.array([image], pa.binary())]
        done, number, held = done + held, number + 1, 0
        for x in (docs, counts, ids):
            x.clear()
        return pa.RecordBatch.from_arrays(columns, ["part", "number", "part_start", "n_ids", "doc_ids", "lengths", "image"])

    for batch in batches:
        for a, b, texts in text_slices(batch.column("text"), SLICE_BYTES):
            got, count = encoder.encode(texts, end_id)
            docs.append(batch.column("doc_id")[a:b])
            counts.append(count)
            ids.append(got)
            held += len(got)
            if held >= SEGMENT_IDS:
                yield segment()
    if docs:
        yield segment()


def _written(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    return releasing(_segments(batches, path, end_id), _encoder)


SEGMENT = "part int, number int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, image binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes the texts with a tokenizer file and writes them to path in ascending doc_id order.

    The texts are dealt out by ranges of doc_id, once; each task writes its segments one by one.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_written, path=tokenizer, end_id=end_id), SEGMENT).write.mode("errorifexists").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, starts = unpack(row["image"]).astype("<u4"), [0, *np.cumsum(row["lengths"]).tolist()]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, starts[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["start"] + a for a in starts[:-1]], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64()), lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for out in _documents(batches):
        yield out.select(["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    The segments' places follow from their parts' totals: one row for each part, summed up in one
    window and joined back.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("before"))
    # As many parts as the write had tasks, of two numbers each.
    placed = segments.join(F.broadcast(parts), F.col("part") == F.col("p")).select("doc_ids", "lengths", "image", (F.col("before") + F.col("part_start")).alias("start"))
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.mapInArrow(_documents, columns + ", ids array<int>") if with_ids else placed.mapInArrow(_digests, columns)


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """write_tokens into a new shared folder, then read_tokens without the ids."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, with_ids=False)

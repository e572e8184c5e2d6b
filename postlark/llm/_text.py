"""Word positions and rolling hashes over UTF-8 bytes, shared by the text operators.

A word is a maximal run of bytes other than space and \\t..\\r. All separators are ASCII, so
words of a text are the same in bytes and in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text whose words are looked at together; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as each slice needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads nearby ones apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a batch's rows of about ``most`` bytes, and their texts; those of one range are held at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield a, b, texts_of(column[a:b])
        a = b


class Words:
    """The words of some texts: where each starts and ends, its text's number, a 64-bit hash."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        gap = SEPARATOR[self.bytes]
        edge = np.diff(gap, prepend=True)
        self.start = np.flatnonzero(edge & ~gap)
        self.end = np.flatnonzero(edge & gap)
        if gap[0]:
            self.end = self.end[self.end > 0]
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.n_words = np.bincount(self.text, minlength=len(texts))

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        seen = np.concatenate([[0], np.cumsum((self.bytes & 0xC0) != 0x80)])
        return seen[self.end] - seen[self.start]

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        first = 0
        while first < len(out):  # blocks cut between words, so that one long text takes no more room
            at = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.end, at + SLICE_BYTES, "right")))
            s, e = self.start[first:last] - at, self.end[first:last] - at
            n = int(e[-1])
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.bytes[at : at + n]] * powers(_BASE, n), out=run[1:])
            out[first:last] = mix((run[e] - run[s]) * powers(_INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
            first = last
        return out


def rolled(words: np.ndarray, n: int, before: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Hash of the n words from each word on. before: the hashes of a smaller length, to go on from."""
    have, out = before or (0, np.zeros(len(words) + 1, np.uint64))
    for k in range(have, n):
        step = np.uint64(pow(_BASE, k, 1 << 64))
        out = out[: len(words) - k] + words[k:] * step
    return out


def windows(text: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each word on are of one text; as long as ``rolled`` is."""
    return text[: len(text) - n + 1] == text[n - 1 :] if len(text) >= n else np.zeros(0, bool)


def private(df, *names: str) -> list[str]:
    """Column names for these that df has not, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        free = f"__{name}"
        while free.lower() in have:
            free += "_"
        have.add(free.lower())
        out.append(free)
    return out


def shared_folder(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one of this machine (local mode)."""
    import tempfile
    import uuid

    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df, name: str):
    """df, written to the shared folder and read again: its lineage is cut and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(hashes, bits: int) -> bytes:
    """Which upper bits of column hash occur: 2**bits bits, however many rows there are, so it may go to every task."""
    from pyspark.sql import functions as F

    slot = f"shiftrightunsigned(hash, {64 - bits})"
    words = hashes.select(F.expr(f"cast({slot} div 32 as int)").alias("word"), F.expr(f"shiftleft(1L, cast({slot} % 32 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little")).tobytes()


_caches: list = []


def worker_cache(make):
    """Keeps the last thing made, for the life of a worker or until ``releasing`` a partition that does not keep it.

    ``releasing`` has to be called in a function of a module: a lambda would bring a copy of the cache along.
    """
    held: dict = {}

    def get(*key):
        if key not in held:
            held.clear()
            held[key] = make(*key)
        return held[key]

    get.clear = held.clear
    _caches.append(get)
    return get


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers are used again by later stages, which would find it taken."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def releasing(batches, *keep):
    """The same batches, without other operators' caches in this worker; release() before and when they end. keep: the partition's own caches."""
    if others := [c for c in _caches if c not in keep]:
        for c in others:
            c.clear()
        release()
    try:
        yield from batches
    finally:
        release()

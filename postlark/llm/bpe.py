"""Byte-level BPE by rank files: encoding and decoding as DuckDB queries inside each partition.

Encoding: a text is cut into the public pattern's pieces; each new piece becomes token-position rows that
a recursive query joins with the merge table, contracting each word's leftmost pair of least rank until no
pair has a rank. Two rules make rounds fewer and leave the ids as they are. A pair is contracted in the same
round as well if no token of a lesser or equal rank holds the two bytes on its left edge or those on its right
edge: nothing that comes first can take its halves. And bytes that follow each other in no token part a piece
into words, as no contraction crosses them. In pieces of over LONG_PIECE bytes, all places of a word's least
pair go at once, but where the made token can join at a lesser rank. A query goes ROUNDS rounds deep; what is
open then goes on in the next one. Pieces are kept with their ids for the life of a worker, up to a bound.
Decoding: token rows join the vocabulary, an ordered aggregation strings their bytes together.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each;
very long texts are encoded in parts that no piece crosses; other columns, whatever their names, are dropped;
an empty table gives an empty result. Of ties in rank the leftmost pair goes first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import BLANK, END, HARD, Interned, distinct, kinds, parts
from ._text import releasing, slices, text_slices, worker_cache

LONG_PIECE = 64
#: Pieces that a worker keeps.
KEPT_PIECES = 150_000
#: Bytes of pieces contracted by one query, and its rounds.
QUERY_BYTES, ROUNDS = 100_000, 64
ENCODE_BYTES, DECODE_TOKENS = 1 << 20, 60_000
#: The public pattern, whose cuts follow from kinds of bytes wherever they are plain.
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A row's place holds its word's number and, in the low bits, its position; edge: the least token over its left edge, NEVER at a word's start.
NEVER = 1 << 30


def _contract_sql(bits: int, long: bool) -> str:
    mask = (1 << bits) - 1
    if long:
        source = "(SELECT *, row_number() OVER v AS nr, lag(tok) OVER v AS before FROM step WHERE round BETWEEN 0 AND {r} WINDOW v AS (ORDER BY place))"
        nth = "nr - max(CASE WHEN edge = {n} OR tok <> before THEN nr END) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS nth,"
        least = "spot = least OR rank = least >> {b} AND NOT alone AND (tok <> next_tok OR nth % 2 = 0)"
    else:
        nth, source, least = "", "step WHERE round BETWEEN 0 AND {r}", "spot = least"
    return f"""
WITH RECURSIVE step(place, tok, edge, round) AS (
    SELECT place, tok, edge, 0::INTEGER FROM start_rows
  UNION ALL (
    WITH pairs AS (
      SELECT place, tok, edge, round, {nth} lead(tok) OVER w AS next_tok, coalesce(lead(edge) OVER w, {NEVER}) AS next_edge, coalesce(lead(edge, 2) OVER w, {NEVER}) AS far_edge
      FROM {source} WINDOW w AS (ORDER BY place)
    ), ranked AS MATERIALIZED (
      SELECT pairs.*, rank, alone, (rank::BIGINT << {bits}) | (place & {mask}) AS spot FROM pairs LEFT JOIN merges ON pair = (tok::BIGINT << 32) | next_tok AND next_edge < {NEVER}
    ), best AS MATERIALIZED (SELECT place >> {bits} AS word, min(spot) AS least FROM ranked WHERE rank IS NOT NULL GROUP BY word
    ), chosen AS (SELECT ranked.*, coalesce(rank < edge AND rank < far_edge OR {least}, false) AS joins, word IS NOT NULL AS open FROM ranked LEFT JOIN best ON place >> {bits} = word)
    SELECT place, CASE WHEN joins THEN rank ELSE tok END, edge, CASE WHEN open THEN round + 1 ELSE -1 END
    FROM (SELECT *, lag(joins) OVER (ORDER BY place) AS gone FROM chosen) WHERE NOT coalesce(gone, false)
  )
)
SELECT place, tok, edge, round FROM step WHERE round < 0 OR round = {ROUNDS} ORDER BY place
""".replace("{n}", str(NEVER)).replace("{r}", str(ROUNDS - 1)).replace("{b}", str(bits))


#: Of short pieces, and of long ones.
_CONTRACT = {12: _contract_sql(12, False), 30: _contract_sql(30, True)}

_DECODE = """
SELECT row, string_agg(bytes, '') AS bytes FROM (SELECT row, bytes FROM tokens JOIN vocabulary ON tok = id ORDER BY pos) GROUP BY row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One rank file in this worker: its tables in DuckDB, and the pieces seen."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.plain = pattern == PLAIN_PATTERN
        self.ranks = read_ranks(path)
        self.known = Interned(KEPT_PIECES)
        halves = np.array([(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks], np.int64)
        left, right, rank = halves.T if len(halves) else np.zeros((3, 0), np.int64)
        # Tokens that join at a lesser rank than their own: after each, the least pair is another.
        early = np.concatenate([left[rank < left], right[rank < right]])
        self.over = np.full(1 << 16, NEVER, np.int32)  # for two bytes, the least token that they follow each other in
        for t, i in self.ranks.items():
            for a, b in zip(t, t[1:], strict=False):
                self.over[a << 8 | b] = min(self.over[a << 8 | b], i)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '192MB'; SET preserve_insertion_order = true; SET temp_directory = ''")
        self._table("merges", pair=(left << 32) | right, rank=rank.astype(np.int32), alone=np.isin(rank, early))
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), bytes=[t.decode("latin-1") for t in self.ranks])

    def _table(self, name: str, **columns) -> None:
        self.db.register("rows_of", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_of")
        self.db.unregister("rows_of")

    def _contract(self, pieces: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        edge = np.full(len(raw), NEVER, np.int32)
        edge[1:] = self.over[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        edge[np.cumsum(lengths) - lengths] = NEVER
        new = edge == NEVER
        first = np.flatnonzero(new)
        word = np.cumsum(new) - 1
        place = (word << bits) + np.arange(len(raw)) - first[word]
        rows = pa.table({"place": place, "tok": self.of_byte[raw], "edge": edge})
        done: list[pa.Table] = []
        while rows.num_rows:
            self.db.register("start_rows", rows)
            if rows.num_rows > QUERY_BYTES:  # one very long piece: as much room as it takes
                self.db.execute(f"SET memory_limit = '{192 + rows.num_rows * 2 // 1000}MB'")
            got = self.db.sql(_CONTRACT[bits]).to_arrow_table()
            over = got.column("round").to_numpy() < 0
            done.append(got.filter(pa.array(over)))
            rows = got.filter(pa.array(~over)).select(["place", "tok", "edge"])
        self.db.unregister("start_rows")
        place, tok = (np.concatenate([t.column(c).to_numpy() for t in done]) for c in ("place", "tok"))
        if len(done) > 1:
            order = np.argsort(place)
            place, tok = place[order], tok[order]
        piece = np.repeat(np.arange(len(pieces)), lengths)[first]  # of each word
        return tok.astype(np.int32), np.bincount(piece[place >> bits], minlength=len(pieces))

    def _add(self, pieces: list[bytes]) -> None:
        """Ids of new pieces of the pattern, all different."""
        whole = [p for p in pieces if p in self.ranks]
        self.known.add(whole, np.fromiter(map(self.ranks.__getitem__, whole), np.int32, len(whole)), np.ones(len(whole), np.int64))
        for bits, some in ((12, [p for p in pieces if len(p) <= LONG_PIECE and p not in self.ranks]), (30, [p for p in pieces if len(p) > LONG_PIECE and p not in self.ranks])):
            for a, b in slices(some, QUERY_BYTES):
                self.known.add(some[a:b], *self._contract(some[a:b], bits))

    def _add_units(self, units: list[bytes]) -> None:
        """Units that the pattern has to split; their pieces are added where they are new."""
        split = [[p.encode() for p in self.split(u.decode())] for u in units]
        self._add(self.known.missing(dict.fromkeys(chain.from_iterable(split))))
        units, split = zip(*((u, s) for u, s in zip(units, split, strict=True) if u not in self.known.number), strict=True) if any(u not in self.known.number for u in units) else ((), ())
        flat = np.fromiter(map(self.known.number.__getitem__, chain.from_iterable(split)), np.int64)
        ids, size = self.known.gather(flat)
        owner = np.repeat(np.arange(len(units)), [len(s) for s in split])
        self.known.add(list(units), ids, np.bincount(owner, size, len(units)).astype(np.int64))

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """By the pattern alone."""
        split = [[p.encode() for p in self.split(t.decode())] for t in texts]
        self._add(self.known.missing(dict.fromkeys(chain.from_iterable(split))))
        ids, size = self.known.gather(np.fromiter(map(self.known.number.__getitem__, chain.from_iterable(split)), np.int64))
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        return ids, np.bincount(owner, size, len(texts)).astype(np.int64)

    def _part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and how many each has.

        A blank before other signs belongs to them. Of several blanks all but the last are one piece, and the
        last one is its own where it is no space.
        """
        self.known.trim()
        if not self.plain:
            return self._whole(texts)
        raw, kind = kinds(texts)
        blank, end = kind == BLANK, kind == END
        before = np.append(np.uint8(END), kind[:-1])
        after = np.append(kind[1:], np.uint8(END))
        space = np.append(False, raw[:-1] == 32) & (before == BLANK)
        new = np.where(blank, (before != BLANK) | (after != BLANK) & (after != END), (kind != before) & ~space) | end
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(raw)) - 1
        number, pieces = distinct(raw, start)
        hard = np.unique(number[kind[last] == HARD]).tolist()
        if any((u := pieces[i].decode().removeprefix(" "))[0].isspace() or u[-1].isspace() for i in hard):
            return self._around_blanks(texts, raw, kind, start, number, pieces, hard)
        if fresh := self.known.missing(pieces):
            units = {pieces[i] for i in hard}
            self._add([p for p in fresh if p not in units])
            self._add_units([p for p in fresh if p in units])
        numbers = self.known.numbers(pieces)[number]
        ends = np.flatnonzero(kind[start] == END)
        own = np.ones(len(start), bool)
        own[ends] = False
        ids, size = self.known.gather(numbers[own])
        upto = np.append(0, np.cumsum(size))[ends - np.arange(len(ends))]
        return ids, np.diff(upto, prepend=0)

    def _around_blanks(self, texts, raw, kind, start, number, pieces, hard) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which blanks other than ASCII ones stand at a unit's edge, and may be one piece with those outside it, are split whole."""
        odd = [i for i in hard if (u := pieces[i].decode().removeprefix(" "))[0].isspace() or u[-1].isspace()]
        text = np.searchsorted(np.flatnonzero(kind == END), start[np.isin(number, odd)])
        whole = np.unique(text).tolist()
        others = sorted(set(range(len(texts))) - set(whole))
        count, rows = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)] * len(texts)
        for some, encode in ((whole, self._whole), (others, self._part)):
            if some:
                ids, size = encode([texts[i] for i in some])
                count[some] = size
                for i, x in zip(some, np.split(ids, np.cumsum(size)[:-1]), strict=True):
                    rows[i] = x
        return np.concatenate(rows), count

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each has."""
        count, found = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        for some, owner in parts(texts, ENCODE_BYTES):
            ids, size = self._part(some)
            np.add.at(count, owner, size)
            found.append(ids)
        return np.concatenate(found), count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes of each row's ids, of rows that follow each other."""
        row = np.repeat(np.arange(len(count), dtype=np.int32), count)
        pieces: list[list[bytes]] = [[] for _ in range(len(count))]
        for a in range(0, len(ids), DECODE_TOKENS):
            b = a + DECODE_TOKENS
            self.db.register("tokens", pa.table({"row": row[a:b], "pos": np.arange(len(ids[a:b]), dtype=np.int32), "tok": ids[a:b]}))
            got = self.db.sql(_DECODE).to_arrow_table()
            for r, x in zip(got.column("row").to_pylist(), got.column("bytes").to_pylist(), strict=True):
                pieces[r].append(x.encode("latin-1"))
        return [b"".join(p) for p in pieces]


@worker_cache
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(ids))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text"), ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:-1]), _lists(*codec.encode(texts))], [*batch.schema.names[:-1], "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        lists = batch.column("ids")
        out = codec.decode(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its text, as an array; no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_encoded, path=path, pattern=pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = PLAIN_PATTERN) -> DataFrame:
    """encoded (doc_id, ids) with the bytes that the ids stand for, in decoded."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path, pattern=pattern), "doc_id long, ids array<int>, decoded binary")


def _both(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    return releasing(_decoded(_encoded(batches, path, pattern), path, pattern), _codec)


def _checked(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text"), ENCODE_BYTES):
            ids, count = codec.encode(texts)
            exact = [x == y for x, y in zip(codec.decode(ids, count), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], _lists(ids, count), pa.array(exact, pa.bool_())], ["doc_id", "ids", "exact"])


def _trips(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Each partition makes its own codec: among stages of other operators, workers that wait hold none."""
    return releasing(_checked(batches, path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, the ids of its text, and whether they decode to it; texts and decoded bytes stay in the worker."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(partial(_trips, path=path, pattern=pattern), "doc_id long, ids array<int>, exact boolean")


def encode_decode(docs: DataFrame, path: str, pattern: str, with_text: bool = False) -> DataFrame:
    """encode, then decode of the ids, in one worker instead of two: doc_id, ids, decoded and, if asked for, the text."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    columns = "doc_id long, ids array<int>, decoded binary"
    if with_text:  # _encoded hands on all columns but the last
        texts, columns = texts.withColumn("t", F.col("text")).select("doc_id", "text", "t").toDF("doc_id", "kept_text", "text"), "doc_id long, kept_text string, ids array<int>, decoded binary"
    out = texts.mapInArrow(partial(_both, path=path, pattern=pattern), columns)
    return out.withColumnRenamed("kept_text", "text") if with_text else out

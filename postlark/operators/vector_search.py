"""Pairs of near vectors among many: exactly in blocks, by bands of signs, and by an inverted file.

All three end in ``compare``: rows and queries meet in buckets, a bucket with many of either side is dealt into parts, and
a task multiplies at most PART_ROWS rows with PART_QUERIES queries of a bucket at a time. The exact search has one bucket, the
banded one a bucket for each table and key, the inverted file one for each list.

Vectors that are null, hold no number or have no length have no distance to any other and are left out. Distances are
1 - cosine in double; equal distances rank by row id. Rows of the same id each count as a row of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm

PART_ROWS, PART_QUERIES = 8_192, 2_048
#: Rows that the lists' centres are fitted on, and that probes are chosen on, at most; and lists, at most.
SAMPLE_ROWS, SAMPLE_QUERIES, MOST_LISTS = 20_000, 200, 4_096
#: Tables of bands, at most: each holds every row once.
MOST_TABLES = 48
_ANGLES = 20_000  # pairs of random directions that a choice of bands is tried on


def _ready(df: DataFrame, name: str, vector: str, out: str) -> DataFrame:
    """id (under the name out) and v, without what has no direction."""
    rows = df.select(F.col(name).alias(out), F.col(vector).alias("v"))
    size = norm(F.col("v"))
    return rows.where(F.col("v").isNotNull() & (size > 0) & ~F.isnan(size))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, a row each."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(whole), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _best(keys: tuple, rows: pa.Table, queries: pa.Table, k: int | None, most: float | None) -> pa.Table:
    """Of each bucket of a group: each query's k nearest rows, or those no farther than ``most``."""
    names = ["query_id", "row_id", "distance"]
    r_ids, q_ids = rows.column("row_id").combine_chunks(), queries.column("query_id").combine_chunks()
    out: list[pa.Table] = []
    if rows.num_rows and queries.num_rows:
        r_bucket, q_bucket = rows.column("bucket").to_numpy(), queries.column("bucket").to_numpy()
        r_order, q_order = np.argsort(r_bucket, kind="stable"), np.argsort(q_bucket, kind="stable")
        r_all, q_all = _matrix(rows.column("v")), _matrix(queries.column("v"))
        rb, qb = r_bucket[r_order], q_bucket[q_order]
        for b in np.intersect1d(rb, qb):
            r = r_order[np.searchsorted(rb, b) : np.searchsorted(rb, b, "right")]
            q = q_order[np.searchsorted(qb, b) : np.searchsorted(qb, b, "right")]
            x = r_all[r]
            for a in range(0, len(q), 256):
                some = q[a : a + 256]
                rough = 1 - q_all[some] @ x.T
                if k is None:
                    i, j = np.nonzero(rough <= most + 1e-9)
                else:
                    limit = np.partition(rough, k - 1, 1)[:, k - 1 : k] if len(r) > k else np.full((len(some), 1), np.inf)
                    i, j = np.nonzero(rough <= limit + 1e-9)
                exact = 1 - np.einsum("ij,ij->i", q_all[some[i]], x[j])
                if k is None:
                    keep = exact <= most
                    i, j, exact = i[keep], j[keep], exact[keep]
                out.append(pa.table([q_ids.take(pa.array(some[i])), r_ids.take(pa.array(r[j])), pa.array(exact)], names))
    if out:
        return pa.concat_tables(out)
    return pa.table([q_ids.slice(0, 0), r_ids.slice(0, 0), pa.array([], pa.float64())], names)


def bucket_sizes(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """bucket, and how many rows and queries meet in it; buckets without both are left out."""
    r, q = (df.groupBy("bucket").agg(F.count("*").alias(n)) for df, n in ((rows, "rows"), (queries, "queries")))
    return r.join(q.hint("shuffle_hash"), "bucket")


def compare(rows: DataFrame, queries: DataFrame, k: int | None = None, most: float | None = None, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """query_id, row_id, distance of pairs within a bucket: k nearest for each query, part and bucket, or all within ``most``.

    rows: bucket, row_id, v; queries: bucket, query_id, v; without buckets all meet all. Buckets with more than part_rows
    rows or part_queries queries are dealt by hash, each part of one side to each of the other; small buckets share groups.
    """
    parts = lambda n, most_: F.greatest(F.lit(1), F.ceil(n / most_)).cast("int")
    total = rows.count()
    slots = max(1, -(-total // part_rows))
    if "bucket" in rows.columns:
        sizes = bucket_sizes(rows, queries).select("bucket", parts(F.col("rows"), part_rows).alias("r_parts"), parts(F.col("queries"), part_queries).alias("q_parts"))
        # How large rows and queries are Spark cannot tell before they are made: neither is to be sent to all tasks.
        sized = lambda df: df.join(sizes.hint("shuffle_hash"), "bucket")
    else:
        r_parts, q_parts = slots, max(1, -(-queries.count() // part_queries))
        sized = lambda df: df.withColumns({"bucket": F.lit(0).cast("long"), "r_parts": F.lit(r_parts), "q_parts": F.lit(q_parts)})

    def dealt(df: DataFrame, name: str, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        both = sized(df).withColumn(own_part, F.pmod(F.xxhash64(name, "v"), F.col(own)).cast("int"))
        both = both.withColumn(other_part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return both.select(F.pmod(F.xxhash64("bucket"), F.lit(slots)).cast("int").alias("slot"), "r_part", "q_part", "bucket", name, "v")

    r = dealt(rows, "row_id", "r_parts", "q_parts", "r_part", "q_part")
    q = dealt(queries, "query_id", "q_parts", "r_parts", "q_part", "r_part")
    kinds = {c: t for c, t in [*rows.dtypes, *queries.dtypes] if c in ("row_id", "query_id")}
    keys = ["slot", "r_part", "q_part"]
    schema = f"query_id {kinds['query_id']}, row_id {kinds['row_id']}, distance double"
    return r.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(partial(_best, k=k, most=most), schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_in_blocks(rows: DataFrame, queries: DataFrame, k: int, row_id: str, query_id: str, vector: str, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """query_id, row_id, distance, rank of each query's k nearest rows, exactly: every part of the rows meets every part of the queries."""
    r, q = _ready(rows, row_id, vector, "row_id"), _ready(queries, query_id, vector, "query_id")
    return _ranked(compare(r, q, k=k, part_rows=part_rows, part_queries=part_queries), k)


def within_distance(rows: DataFrame, queries: DataFrame, most: float, row_id: str, query_id: str, vector: str, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """query_id, row_id, distance of all pairs no farther apart than ``most``, exactly, in the same parts."""
    r, q = _ready(rows, row_id, vector, "row_id"), _ready(queries, query_id, vector, "query_id")
    return compare(r, q, most=most, part_rows=part_rows, part_queries=part_queries)


# Bands of signs ---------------------------------------------------------------------------------------------------


def _flips(bits: int, wide: int = 2) -> np.ndarray:
    """Which bits a probe turns over: none, each one, each two, as rows of zeros and ones."""
    rows = [np.zeros(bits, np.int8)]
    for i in range(bits):
        one = np.zeros(bits, np.int8)
        one[i] = 1
        rows.append(one)
        for j in range(i + 1, bits) if wide > 1 else ():
            two = one.copy()
            two[j] = 1
            rows.append(two)
    return np.array(rows)


def band_plan(most: float, recall: float = 0.95, seed: int = 7) -> tuple[int, int, int]:
    """bits, tables and probes with which a pair as far apart as ``most`` meets with chance ``recall``, comparing as few others as can be.

    Tried on random pairs at that very distance, as all that matters of two directions is their angle: a bit is the side of
    a random plane, and a query probes, in each table, the keys that turn over the bits it is least sure of. With more
    than MOST_TABLES tables a choice is out; if all are, there is no pruning to be had, and ValueError says so.
    """
    angle = np.arccos(np.clip(1 - most, -1, 1))
    rng = np.random.default_rng(seed)
    best: tuple[float, int, int, int] | None = None
    for bits in range(4, 21, 2):
        x, z = rng.standard_normal((2, _ANGLES, bits))
        turned = ((x > 0) != (np.cos(angle) * x + np.sin(angle) * z > 0)).astype(np.int8)
        flips = _flips(bits)
        cost = (x * x) @ flips.T.astype(float)  # how unsure the bits that a probe turns over are
        few = turned.sum(1) <= 2
        own = np.einsum("ij,ij->i", x * x, turned.astype(float))
        rank = np.where(few, (cost < own[:, None] - 1e-12).sum(1), len(flips))
        for probes in (p for p in (1, 2, 4, 8, 16, 32, 64, 128) if p <= len(flips)):
            hit = float((rank < probes).mean())
            tables = 1 if hit >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - hit))) if hit > 0 else MOST_TABLES + 1
            share = tables * probes / 2**bits
            price = share + 4e-4 * tables + 5e-6 * tables * probes  # pairs compared, and copies of rows and of queries
            if tables <= MOST_TABLES and share < 0.5 and (best is None or price < best[0]):
                best = (price, bits, tables, probes)
    if best is None:
        raise ValueError(f"no bands tell pairs within {most} from others; use within_distance")
    return best[1:]


def _keys(batches: Iterator[pa.RecordBatch], name: str, bits: int, tables: int, probes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each table and probed key."""
    weights = (1 << np.arange(bits)).astype(np.int64)
    flips = _flips(bits)
    change = flips.astype(np.int64) @ weights
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            x = _matrix(part.column("v"))
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], bits))
                side = x @ planes
                key = (side > 0).astype(np.int64) @ weights
                if probes > 1:
                    cost = (side * side) @ flips.T.astype(float)
                    taken = np.argpartition(cost, probes - 1, 1)[:, :probes]
                    key = (key[:, None] ^ change[taken]).ravel()
                of = np.repeat(np.arange(len(x)), probes)
                bucket = key + (np.int64(t) << np.int64(bits))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column(name).take(pa.array(of)), part.column("v").take(pa.array(of))], ["bucket", name, "v"])


def banded(rows: DataFrame, name: str, bits: int, tables: int, probes: int = 1, seed: int = 7) -> DataFrame:
    """bucket, id and v: each row in a bucket of each table, in ``probes`` of them if it is a query."""
    kinds = dict(rows.dtypes)
    return rows.select(name, "v").mapInArrow(partial(_keys, name=name, bits=bits, tables=tables, probes=probes, seed=seed), f"bucket long, {name} {kinds[name]}, v {kinds['v']}")


def _packed(batches: Iterator[pa.RecordBatch], name: str, bits: int, tables: int, probes: int, seed: int, split: int) -> Iterator[pa.RecordBatch]:
    """A row for each vector and block that it has keys in: its keys there, and its direction in bytes.

    A block is a table's keys that begin with the same ``split`` bits. codes: the direction in whole steps of ``step``; off: how
    far, in length, it is from the direction itself.
    """
    weights = (1 << np.arange(bits)).astype(np.int64)
    flips = _flips(bits)
    change = flips.astype(np.int64) @ weights
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            x = _matrix(part.column("v"))
            step = np.abs(x).max(1) / 127
            codes = np.rint(x / step[:, None]).astype(np.int8)
            off = np.linalg.norm(x - codes * step[:, None], axis=1)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], bits))
                side = x @ planes
                key = ((side > 0).astype(np.int64) @ weights)[:, None]
                if probes > 1:
                    key = key ^ change[np.argpartition((side * side) @ flips.T.astype(float), probes - 1, 1)[:, :probes]]
                key = np.sort(key, 1)
                block = key >> (bits - split)
                first = np.diff(block, axis=1, prepend=-1) != 0
                at = np.flatnonzero(first)
                of = at // key.shape[1]
                keys = pa.ListArray.from_arrays(pa.array(np.append(at, key.size).astype(np.int32)), pa.array(key.ravel().astype(np.int32)))
                columns = [pa.array((np.int64(t) << np.int64(bits)) + block.ravel()[at]), part.column(name).take(pa.array(of)), keys, packed.take(pa.array(of)), pa.array(step[of]), pa.array(off[of])]
                yield pa.RecordBatch.from_arrays(columns, ["block", name, "keys", "codes", "step", "off"])


def _may_be_near(keys: tuple, rows: pa.Table, queries: pa.Table, most: float) -> pa.Table:
    """Pairs of a group that share a key and whose directions in bytes leave it open that they are within ``most``."""
    names = ["query_id", "row_id"]
    r_ids, q_ids = rows.column("row_id").combine_chunks(), queries.column("query_id").combine_chunks()
    out: list[pa.Table] = []

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, the row of each; directions as sent, and how far off they are."""
        lists = table.column("keys").combine_chunks()
        of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        key = lists.flatten().to_numpy() + (table.column("block").to_numpy()[of] << np.int64(32))
        order = np.argsort(key, kind="stable")
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(len(lists), -1)
        return key[order], of[order], codes * table.column("step").to_numpy()[:, None], table.column("off").to_numpy()

    if rows.num_rows and queries.num_rows:
        (rk, r_of, x, r_off), (qk, q_of, y, q_off) = read(rows), read(queries)
        for k in np.intersect1d(rk, qk):
            r = r_of[np.searchsorted(rk, k) : np.searchsorted(rk, k, "right")]
            q = q_of[np.searchsorted(qk, k) : np.searchsorted(qk, k, "right")]
            for a in range(0, len(q), 256):
                some = q[a : a + 256]
                # Of directions e and f off, the product is at most e + f + e f off.
                e, f = q_off[some][:, None], r_off[r][None]
                i, j = np.nonzero(1 - y[some] @ x[r].T <= most + e + f + e * f + 1e-9)
                out.append(pa.table([q_ids.take(pa.array(some[i])), r_ids.take(pa.array(r[j]))], names))
    if out:
        found = pa.concat_tables(out)
        return found.group_by(names).aggregate([])
    return pa.table([q_ids.slice(0, 0), r_ids.slice(0, 0)], names)


def band_candidates(rows: DataFrame, queries: DataFrame, most: float, recall: float = 0.95, seed: int = 7, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """query_id, row_id of the pairs that meet in a band and may be within ``most``, each once.

    What is sent are directions in bytes, a row's once for each table, a query's once for each block of a table. Blocks
    hold about part_rows rows; larger ones, as those of copies, are dealt by hash, each part of one side to each of the other.
    """
    bits, tables, probes = band_plan(most, recall)
    split = min(bits, max(0, int(np.ceil(np.log2(max(rows.count(), 1) / part_rows)))))

    def packed(df: DataFrame, name: str, probes_: int) -> DataFrame:
        kind = dict(df.dtypes)[name]
        schema = f"block long, {name} {kind}, keys array<int>, codes binary, step double, off double"
        return df.select(name, "v").mapInArrow(partial(_packed, name=name, bits=bits, tables=tables, probes=probes_, seed=seed, split=split), schema)

    r, q = packed(rows, "row_id", 1), packed(queries, "query_id", probes)
    counted = lambda df, n: df.groupBy("block").agg(F.count("*").alias(n))
    parts = lambda n, most_: F.greatest(F.lit(1), F.ceil(n / most_)).cast("int")
    sizes = counted(r, "rows").join(counted(q, "queries"), "block").select("block", parts(F.col("rows"), 2 * part_rows).alias("r_parts"), parts(F.col("queries"), 2 * part_queries).alias("q_parts"))

    def dealt(df: DataFrame, name: str, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        # A row for each block: a small part of the vectors' number, so it goes to all tasks and the vectors are not dealt for it.
        both = df.join(F.broadcast(sizes), "block").withColumn(own_part, F.pmod(F.xxhash64(name, "codes"), F.col(own)).cast("int"))
        both = both.withColumn(other_part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return both.select("block", "r_part", "q_part", name, "keys", "codes", "step", "off")

    keys = ["block", "r_part", "q_part"]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, row_id {dict(rows.dtypes)['row_id']}"
    met = dealt(r, "row_id", "r_parts", "q_parts", "r_part", "q_part").groupBy(*keys).cogroup(dealt(q, "query_id", "q_parts", "r_parts", "q_part", "r_part").groupBy(*keys))
    return met.applyInArrow(partial(_may_be_near, most=most), schema).distinct()


def _exactly(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            distance = 1 - np.einsum("ij,ij->i", _matrix(part.column("q")), _matrix(part.column("v")))
            near = pa.array(distance <= most)
            yield pa.RecordBatch.from_arrays([part.column("query_id").filter(near), part.column("row_id").filter(near), pa.array(distance).filter(near)], ["query_id", "row_id", "distance"])


def band_join(rows: DataFrame, queries: DataFrame, most: float, row_id: str, query_id: str, vector: str, recall: float = 0.95, seed: int = 7, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """As ``within_distance``, but a pair at the very distance ``most`` is found with chance ``recall`` only, nearer ones with more.

    Distances are exact; a pair that meets in several tables is one row. No row has more copies than tables, no query more
    than tables times probes, and hot keys are dealt into parts.
    """
    r, q = _ready(rows, row_id, vector, "row_id"), _ready(queries, query_id, vector, "query_id")
    pairs = band_candidates(r, q, most, recall, seed, part_rows, part_queries)
    q, r = q.select(F.col("query_id").alias("__query"), F.col("v").alias("q")), r.select(F.col("row_id").alias("__row"), "v")
    both = pairs.join(q, F.col("query_id").eqNullSafe(F.col("__query"))).join(r, F.col("row_id").eqNullSafe(F.col("__row"))).select("query_id", "row_id", "q", "v")
    kinds = dict(both.dtypes)
    found = both.mapInArrow(partial(_exactly, most=most), f"query_id {kinds['query_id']}, row_id {kinds['row_id']}, distance double")
    return found.groupBy("query_id", "row_id").agg(F.min("distance").alias("distance"))


def compared_share(rows: DataFrame, queries: DataFrame, most: float, row_id: str, query_id: str, vector: str, recall: float = 0.95, seed: int = 7) -> float:
    """What share of all pairs ``band_join`` compares, those met in several tables counted each time."""
    bits, tables, probes = band_plan(most, recall)
    r, q = _ready(rows, row_id, vector, "row_id"), _ready(queries, query_id, vector, "query_id")
    met = bucket_sizes(banded(r, "row_id", bits, tables, seed=seed), banded(q, "query_id", bits, tables, probes, seed)).agg(F.sum(F.col("rows") * F.col("queries")).alias("n")).first()["n"] or 0
    return met / max(r.count() * q.count(), 1)


# Inverted file ----------------------------------------------------------------------------------------------------


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Unit vectors of at most about ``most`` rows, chosen by a hash of the vector."""
    there = rows.count()
    some = rows if there <= most else rows.where(F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < int(0.97 * most / there * 1_000_003))
    got = some.select("v").toArrow().column("v")
    return _matrix(got) if len(got) else np.zeros((0, 1))


def centres(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Directions of ``lists`` clusters of unit vectors (k-means by cosine); empty ones restart at the worst placed rows."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ c.T
        of, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=len(c)) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """Lists to look into so that, among the sample, ``recall`` of the k nearest of some of its vectors are in them."""
    q = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    of = (sample @ c.T).argmax(1)
    true = np.argpartition(-(q @ sample.T), min(k, len(sample)) - 1, 1)[:, :k]
    place = (-(q @ c.T)).argsort(1).argsort(1)  # of each list among those by nearness
    wanted = np.take_along_axis(place, of[true], 1).ravel()
    return int(np.sort(wanted)[min(len(wanted) - 1, int(np.ceil(recall * len(wanted))) - 1)]) + 1


def _listed(batches: Iterator[pa.RecordBatch], name: str, c, probes: int) -> Iterator[pa.RecordBatch]:
    """The lists nearest to each vector, with its angle to their centres."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            near = _matrix(part.column("v")) @ c.value.T
            taken = np.argpartition(-near, probes - 1, 1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
            of = np.repeat(np.arange(len(near)), taken.shape[1])
            angle = np.arccos(np.clip(near[of, taken.ravel()], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(taken.ravel().astype(np.int64)), part.column(name).take(pa.array(of)), part.column("v").take(pa.array(of)), pa.array(angle)], ["bucket", name, "v", "angle"])


def _in_lists(rows: DataFrame, name: str, c, probes: int) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.select(name, "v").mapInArrow(partial(_listed, name=name, c=c, probes=probes), f"bucket long, {name} {kinds[name]}, v {kinds['v']}, angle double")


class InvertedFile:
    """Lists of rows by their nearest centre. Every row is in one list; the centres come from at most SAMPLE_ROWS rows.

    path: where the lists are written, by list, to be read by later searches; without it they are made anew by each.
    """

    def __init__(self, rows: DataFrame, row_id: str, vector: str, lists: int | None = None, path: str | None = None, seed: int = 7):
        spark = rows.sparkSession
        self.rows = _ready(rows, row_id, vector, "row_id")
        self.sample = _sample(self.rows, SAMPLE_ROWS)
        wanted = lists or round(max(self.rows.count(), 1) ** 0.5)
        self.centres = centres(self.sample, max(1, min(wanted, MOST_LISTS, len(self.sample))), seed=seed) if len(self.sample) else np.zeros((0, 1))
        self._sent = spark.sparkContext.broadcast(self.centres)
        self.lists = _in_lists(self.rows, "row_id", self._sent, 1) if len(self.centres) else self.rows.select(F.lit(0).cast("long").alias("bucket"), "row_id", "v", F.lit(0.0).alias("angle"))
        if path:
            self.lists.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            self.lists = spark.read.parquet(path).withColumn("bucket", F.col("bucket").cast("long"))

    def search(self, queries: DataFrame, k: int, query_id: str, vector: str, recall: float = 0.95, exact: bool = False, probes: int | None = None, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
        """query_id, row_id, distance, rank of each query's k nearest rows in the lists nearest to it.

        How many lists is found on the sample, from ``recall``. exact: then also in every list that may hold a nearer row:
        one whose centre's angle, less the list's widest angle, is no more than the k-th row's.
        """
        q = _ready(queries, query_id, vector, "query_id")
        rows = self.lists.select("bucket", "row_id", "v")
        if not len(self.centres):
            return q.crossJoin(rows).select("query_id", "row_id", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
        n = min(probes or probes_for(self.sample, self.centres, k, recall), len(self.centres))
        asked = _in_lists(q, "query_id", self._sent, n)
        found = _ranked(compare(rows, asked.select("bucket", "query_id", "v"), k=k, part_rows=part_rows, part_queries=part_queries), k)
        if not exact or n == len(self.centres):
            return found
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        reach = F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("far"))))).otherwise(F.lit(np.pi))
        wide = self.lists.groupBy("bucket").agg(F.max("angle").alias("wide"))  # a row for each list
        all_ = _in_lists(q, "query_id", self._sent, len(self.centres)).join(wide, "bucket").join(kth.select("query_id", reach.alias("reach")), "query_id", "left")
        may = all_.where(F.col("reach").isNull() | (F.col("angle") - F.col("wide") <= F.col("reach") + 1e-7))
        more = may.join(asked.select("bucket", "query_id"), ["bucket", "query_id"], "left_anti").select("bucket", "query_id", "v")
        rest = compare(rows, more, k=k, part_rows=part_rows, part_queries=part_queries)
        return _ranked(found.drop("rank").union(rest), k)

"""Arrays of floats as vectors. Native expressions, but for products with fixed vectors; sums run in array order, in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 for a vector of length zero."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def calibrate(raw: Column, floor: float, ceiling: float) -> Column:
    """raw on a line from floor (0) to ceiling (1), no further; as it is where they leave no room."""
    x = (raw - floor) / (ceiling - floor) if ceiling > floor else raw
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalized(a: Column) -> Column:
    # The length is computed once for a vector; written into the inner expression it would be for each of its places.
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))), F.lit(0))


def _products(a: pa.Array, fixed: list[np.ndarray | None], rows_at_once: int = 1024) -> pa.Array:
    """Rows are the places of a list of vectors; sums run along them one place at a time, as those of dot do."""
    sizes = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    first = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    flat = a.flatten()
    values, missing = flat.to_numpy(zero_copy_only=False).astype(np.float64), flat.is_null().to_numpy(zero_copy_only=False)
    out, none = np.zeros((len(a), len(fixed))), np.ones((len(a), len(fixed)), bool)
    for n in np.unique(sizes[sizes >= 0]):
        those = [j for j, y in enumerate(fixed) if y is not None and len(y) == n]
        every = np.flatnonzero(sizes == n)
        for rows in np.split(every, range(rows_at_once, len(every), rows_at_once)) if those else ():
            at = first[rows] + np.arange(n)[:, None]
            x, length = values[at], np.zeros(len(rows))
            for place in x:
                length += place * place
            length = np.sqrt(length)
            x = x / np.where(length == 0, 1.0, length)
            sums, ys = np.zeros((len(those), len(rows))), np.array([fixed[j] for j in those]).T
            for y, place in zip(ys, x, strict=True):
                sums += y[:, None] * place
            out[np.ix_(rows, those)] = sums.T
            none[np.ix_(rows, those)] = missing[at].any(0)[:, None]
    ends = np.arange(len(a) + 1, dtype=np.int32) * len(fixed)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel(), mask=none.ravel()))


def products(a: Column, fixed: list[list[float | None] | None]) -> Column:
    """array of dot(normalized(a), y) for each of a few fixed vectors, the same to the bit: by Arrow batches, a vector is read once for all of them.

    Null where one of both is, or has a null place, or their lengths differ.
    """
    ys = [None if y is None or None in y else np.array(y, np.float64) for y in fixed]

    def of(x: pa.Array) -> pa.Array:
        return _products(x, ys)

    return F.arrow_udf(of, "array<double>")(a)


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and the mean of its vectors, of length one; a single vector stays as it is."""
    places = rows.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    pooled = places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("all"), F.max("n").alias("n"))
    mean = F.col("all.x")
    return pooled.select(key, F.when(F.col("n") > 1, normalized(mean)).otherwise(mean).alias(vector))


def hashed_terms(text: Column, size: int = 384) -> Column:
    """A vector of word counts by hash, of length one: an embedding that needs no model."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")

    def counted(slots: Column) -> Column:
        """Sorted slots between marks: how many of each there are is the distance of the marks."""
        marks = F.sequence(F.lit(0), F.lit(size))
        every = F.array_sort(F.concat(F.transform(slots, lambda s: s * 2 + 1), F.transform(marks, lambda m: m * 2)))
        ends = F.filter(F.transform(every, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["x"] % 2 == 0)["i"]
        return F.zip_with(F.slice(ends, F.lit(2), F.lit(size)), F.slice(ends, F.lit(1), F.lit(size)), lambda b, a: (b - a - 1).cast("double"))

    # In an array of one, so that the words are split, hashed and counted once.
    counts = F.get(F.transform(F.array(F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(size)))), counted), F.lit(0))
    return F.get(F.transform(F.array(counts), lambda c: F.transform(normalized(c), lambda x: x.cast("float"))), F.lit(0))


#: Queries that are sent to every task, at most.
MOST_QUERIES = 1_000


def nearest(rows: DataFrame, queries: DataFrame, k: int, row_id: str, query_id: str, vector: str) -> DataFrame:
    """For each query its k nearest rows by distance, ties by row_id. queries: at most MOST_QUERIES; for more there is vector_search."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: use vector_search.nearest_in_blocks")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("__q"))
    pairs = rows.crossJoin(F.broadcast(q)).select("query_id", F.col(row_id).alias("row_id"), cosine_distance(F.col(vector), F.col("__q")).alias("distance"))
    best = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "row_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

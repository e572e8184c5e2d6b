"""Parquet tables in hash buckets: a change reads and rewrites the buckets it touches, and no others."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import upsert

BUCKETS = 1024


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one of this machine (local mode)."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class BucketTable:
    """Rows by a hash of one of their columns, in folders that Spark prunes when it reads and replaces when it writes.

    A change is first written whole beside the table, then put in its place by dynamic partition overwrite. If the driver is
    lost between the two, opening the table again finishes what was written whole and forgets what was not; so a bucket is
    never half old and half new, and running a change again is safe.

    by: the column whose hash is the bucket. With as many buckets as there are values of it, or more, a change of some
    values touches about their share of the buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.by, self.buckets = spark, path.rstrip("/"), schema, by, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self._staged = f"{self.path}/_staged"
        self._finish()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def there(self) -> list[int]:
        """Buckets that have rows."""
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[7:]) for n in names if n.startswith("bucket="))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        if not self.there():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(*buckets)) if buckets else rows.limit(0)
        return rows.select(*self.columns)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys, of which there are no more than buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.by)).alias("b")).distinct().collect())

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Puts rows in the place of all that these buckets hold; those left without rows go."""
        if not buckets:
            return
        self._delete(self._staged)
        out = rows.select(*self.columns, self.bucket(F.col(self.by)).alias("bucket"))
        # Rows of a bucket go to one task or, if they are many, to several: by their place in the bucket's hash.
        out.repartition("bucket").write.option("maxRecordsPerFile", 2_000_000).partitionBy("bucket").parquet(f"{self._staged}/rows")
        self.spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1).write.parquet(f"{self._staged}/buckets")
        self._finish()

    def _finish(self) -> None:
        if self._exists(f"{self._staged}/buckets/_SUCCESS"):
            rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self._staged}/rows")
            fs, p = self._fs(f"{self._staged}/rows")
            written = {int(s.getPath().getName()[7:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
            if written:
                rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 2_000_000).partitionBy("bucket").parquet(self.path)
            for r in self.spark.read.schema("bucket int").parquet(f"{self._staged}/buckets").collect():
                if r["bucket"] not in written:
                    self._delete(f"{self.path}/bucket={r['bucket']}")
        self._delete(self._staged)

    def upsert(self, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> list[int]:
        """As ``scoring.upsert``, on the buckets of the new rows' keys; these are returned."""
        buckets = self.touched(new)
        self.replace(upsert(self.read(buckets), new, keys, keep), buckets)
        return buckets

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows whose ``by`` and other columns of keys are in keys go."""
        buckets = self.touched(keys)
        self.replace(self.read(buckets).join(keys.distinct(), keys.columns, "left_anti"), buckets)
        return buckets

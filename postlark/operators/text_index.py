"""Which rows can hold a word at all: a posting table of trigrams, so that a text search reads a few buckets before it compares texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import search_words

BUCKETS = 256


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    low = F.lower(text)
    n = F.char_length(low)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(low, i, F.lit(3)))))


def word_trigrams(word: str) -> list[str]:
    """Those that any text with the word has: of its parts between % and _, which stand for anything."""
    parts = word.lower().replace("_", "%").split("%")
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


class TrigramIndex:
    """Trigrams of a text column and the rows that have them, in folders by a hash of the trigram.

    It names a superset of the rows that match: texts are compared afterwards. So rows whose text has changed are added
    anew, and what their old text left behind does no harm; ``build`` leaves it out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", kind: str = "long", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.kind, self.buckets = spark, path.rstrip("/"), key, kind, buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, text: str) -> TrigramIndex:
        return self._write(rows, text, "overwrite")

    def add(self, rows: DataFrame, text: str) -> TrigramIndex:
        return self._write(rows, text, "append")

    def _write(self, rows: DataFrame, text: str, mode: str) -> TrigramIndex:
        held = rows.select(F.col(self.key).cast(self.kind).alias("id"), F.explode(trigrams(F.col(text))).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        # A frequent trigram's rows go to several tasks and files.
        held.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/rows")
        counts = held.groupBy("gram", "bucket").agg(F.count("*").alias("n"))
        counts.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def _read(self, name: str, schema: str, grams: list[tuple[str, int]]) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        return rows.where(F.col("bucket").isin(*sorted({b for _, b in grams})) & F.col("gram").isin(*sorted({g for g, _ in grams})))

    def candidates(self, query: str) -> DataFrame | None:
        """id of all rows that can hold a word of the query, by each word's rarest trigram; None where a word has no trigram, so that all rows can."""
        words = [word_trigrams(w) for w in search_words(query)]
        if not all(words):
            return None
        every = sorted({g for w in words for g in w})
        placed = self.spark.createDataFrame([(g,) for g in every], "gram string").select("gram", self._bucket(F.col("gram")).alias("bucket"))
        where = {r["gram"]: r["bucket"] for r in placed.collect()}
        n = {r["gram"]: r["n"] for r in self._read("counts", "gram string, n long", list(where.items())).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rarest = sorted({min(w, key=lambda g: (n.get(g, 0), g)) for w in words})
        return self._read("rows", f"id {self.kind}, gram string", [(g, where[g]) for g in rarest]).select("id").distinct()


def searched(postings: DataFrame, titles: TrigramIndex, names: TrigramIndex, query: str) -> DataFrame:
    """The postings that the query can match: by their normalized_title, or by their company's normalized_name (names: ids of companies)."""
    by_title, by_name = titles.candidates(query), names.candidates(query)
    if by_title is None or by_name is None:
        return postings
    of_names = postings.join(by_name.withColumnRenamed("id", "company_id"), "company_id", "left_semi").select("id")
    return postings.join(by_title.union(of_names).distinct(), "id", "left_semi")

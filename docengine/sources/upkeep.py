"""Tables that are kept up: rows are put in, replaced and deleted by key, and only the buckets that they lie in are written anew.

A table is a folder of buckets by a hash of its key.  A change is staged in the
shared folder first and then replaces the touched buckets by dynamic partition
overwrite; all other files stay as they are, name and all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources import shared
from docengine.sources.tables import first_row

#: Buckets of a table.
BUCKETS = 64

_MODE = "spark.sql.sources.partitionOverwriteMode"


class KeptTable:
    """A table at ``path`` whose rows are found by ``key``.

    Tables whose rows belong to those of this one are its ``children``; they
    have this table's key as theirs, and a delete takes their rows along.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS, children: tuple[KeptTable, ...] = ()):
        self.spark, self.path, self.key, self.schema, self.buckets, self.children = spark, path, key, schema, buckets, children

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def create(self, rows: DataFrame) -> None:
        """Write the table; rows without a key are an error."""
        keyed = rows.withColumn(self.key, F.coalesce(F.col(self.key), F.raise_error(F.lit("a row needs a key")).cast(dict(rows.dtypes)[self.key])))
        self._bucketed(keyed).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(self.path)

    def _replace(self, touched: list[int], rows: DataFrame) -> None:
        """Put ``rows`` in the place of all rows of the touched buckets."""
        staged = shared.saved(rows, "staged")
        before = self.spark.conf.get(_MODE)
        self.spark.conf.set(_MODE, "dynamic")
        try:
            staged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(self.path)
        finally:
            self.spark.conf.set(_MODE, before)
        # a bucket without rows is not written, so what it had must go
        left = {r[0] for r in staged.select("bucket").distinct().collect()}
        for bucket in set(touched) - left:
            self._remove(f"{self.path}/bucket={bucket}")

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def upsert(self, changes: DataFrame, *newest: Column) -> None:
        """Put rows in, or in the place of those with their key; of several with one key the first by ``newest`` counts."""
        once = first_row(changes, [self.key], *newest) if newest else changes.dropDuplicates([self.key])
        fresh = shared.saved(self._bucketed(once.where(F.col(self.key).isNotNull())), "changes")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        if touched:
            old = self._stored().where(F.col("bucket").isin(touched)).join(fresh.select(self.key), self.key, "left_anti")
            self._replace(touched, old.unionByName(fresh.select(old.columns)))

    def delete(self, keys: DataFrame) -> None:
        """Take out the rows of these keys, children's rows first."""
        gone = shared.saved(self._bucketed(keys.select(self.key).distinct()), "keys")
        for child in self.children:
            child.delete(gone.select(F.col(self.key).alias(child.key)))
        touched = [r[0] for r in gone.select("bucket").distinct().collect()]
        if touched:
            self._replace(touched, self._stored().where(F.col("bucket").isin(touched)).join(gone.select(self.key), self.key, "left_anti"))

    def clear(self) -> dict[str, int]:
        """Take out all rows, children's first; the counts of what was there, by path."""
        counts = {}
        for child in self.children:
            counts |= child.clear()
        counts[self.path] = self._stored().count()
        self._bucketed(self.spark.createDataFrame([], self.schema)).write.partitionBy("bucket").mode("overwrite").parquet(self.path)
        return counts

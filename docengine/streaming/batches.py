"""Work in micro-batches that can be stopped at any point and gone on with.

New files of a folder are worked on batch by batch.  A manifest has a row for
each attempt; it is written last, so a batch that was stopped is done again and
what it had written is replaced.  Rows that fail are put back into the folder
until their attempts are used up; rows that are done are never worked on twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From the rows of a batch, with the number of the ``attempt``, to their key, ``ok`` and what the work gives.
Work = Callable[[DataFrame], DataFrame]


class Batches:
    """A folder of waiting rows (``landing``), and the results and the manifest below ``home``; both are shared folders."""

    def __init__(self, spark: SparkSession, landing: str, home: str, schema: str, key: str, work: Work, most_attempts: int = 3, files: int = 1):
        self.spark, self.landing, self.home, self.schema, self.key, self.work = spark, landing, home, schema, key, work
        self.most_attempts, self.files = most_attempts, files
        self.manifest_schema = f"{dict(spark.createDataFrame([], schema).dtypes)[key]}"
        if not self._done(f"{home}/manifest/epoch=-1"):
            spark.createDataFrame([], f"{key} {self.manifest_schema}, ok boolean, attempt int").write.mode("overwrite").parquet(f"{home}/manifest/epoch=-1")

    def _done(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _once(self, rows: DataFrame, path: str, again: bool = False) -> None:
        """Write rows, unless they are there as a whole already; ``again``: in the place of what is there."""
        if again or not self._done(path):
            rows.write.mode("overwrite").parquet(path)

    def manifest(self) -> DataFrame:
        """A row for each attempt: key, ``ok, attempt, epoch``."""
        return self.spark.read.schema(f"{self.key} {self.manifest_schema}, ok boolean, attempt int, epoch long").parquet(f"{self.home}/manifest")

    def results(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.home}/results").parquet(f"{self.home}/results").drop("epoch")

    def _batch(self, rows: DataFrame, epoch: int) -> None:
        if self._done(f"{self.home}/manifest/epoch={epoch}"):
            return
        before = self.manifest().groupBy(self.key).agg(F.bool_or("ok").alias("_ok"), F.max("attempt").alias("_attempt"))
        todo = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(before, self.key, "left").where(~F.coalesce("_ok", F.lit(False)) & (F.coalesce("_attempt", F.lit(0)) < self.most_attempts))
        todo = todo.withColumn("attempt", F.coalesce("_attempt", F.lit(0)) + 1).drop("_ok", "_attempt")
        worked_at = f"{self.home}/worked/epoch={epoch}"
        self._once(self.work(todo).join(todo.select(self.key, "attempt"), self.key), worked_at, again=True)
        worked = self.spark.read.parquet(worked_at)
        self._once(worked.where("ok").drop("ok", "attempt"), f"{self.home}/results/epoch={epoch}", again=True)
        failed = worked.where(f"not ok and attempt < {self.most_attempts}").select(self.key)
        waiting = rows.dropDuplicates([self.key]).join(failed, self.key, "left_semi")
        if failed.limit(1).count():
            self._once(waiting.coalesce(1), f"{self.landing}/requeue-{epoch}")
        self._once(worked.select(self.key, "ok", F.col("attempt").cast("int").alias("attempt")), f"{self.home}/manifest/epoch={epoch}", again=True)

    def run(self) -> None:
        """Work on all files that are there now; a run goes on where the last one ended or was stopped."""
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.files).parquet(self.landing)
        query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    def run_all(self) -> None:
        """Run until no attempt is left."""
        for _ in range(self.most_attempts):
            self.run()

    def progress(self) -> dict[str, int]:
        """Keys that are done, that have failed for good and that wait for another attempt."""
        each = self.manifest().groupBy(self.key).agg(F.bool_or("ok").alias("ok"), F.max("attempt").alias("attempt"))
        n = lambda c: F.count_if(c)
        row = each.agg(n(F.col("ok")).alias("done"), n(~F.col("ok") & (F.col("attempt") >= self.most_attempts)).alias("failed"), n(~F.col("ok") & (F.col("attempt") < self.most_attempts)).alias("waiting")).first()
        return row.asDict()

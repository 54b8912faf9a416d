"""Stored tables with one row a key, into which batches are merged.

A table is a folder of Parquet, cut into buckets by a hash of the key. A batch rewrites the buckets that its keys fall into, and no
others. Each row keeps the number of the batch that changed it last, so a batch that is merged again, after a failure between
two buckets or after its checkpoint was lost, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Columns that a table has besides its own: the bucket, the batches that put the row in and that changed it last.
OWN = "bucket int, first_batch long, last_batch long"
#: Old and new values of the columns by name, to what is stored of both.
Combine = Callable[[Column, Column], dict[str, Column]]


@dataclass(frozen=True)
class Stored:
    path: str
    key: str
    columns: str  # the DDL of all columns but OWN
    buckets: int = 64

    def read(self, spark: SparkSession) -> DataFrame:
        names = [c.name for c in spark.createDataFrame([], self.columns).schema]
        return spark.read.schema(f"{self.columns}, {OWN}").parquet(self.path).select(*names, "bucket", "first_batch", "last_batch")

    def create(self, spark: SparkSession) -> None:
        """Makes the folder where it isn't there yet."""
        spark.createDataFrame([], f"{self.columns}, {OWN}").write.mode("append").partitionBy("bucket").parquet(self.path)

    def merge(self, batch: DataFrame, number: int, combine: Combine) -> list[int]:
        """Merges a batch of one row a key (rows without a key are dropped) and returns the buckets that it touched.

        Numbers rise from batch to batch. A key whose row was changed by this batch or a later one is left as it is."""
        spark = batch.sparkSession
        names = [c.name for c in spark.createDataFrame([], self.columns).schema]
        rest = [c for c in names if c != self.key]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = written(batch.select(*names).filter(F.col(self.key).isNotNull()).withColumn("bucket", bucket), "batch")
        # at most as many as there are buckets
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if not touched:
            return []
        old = self.read(spark).filter(F.col("bucket").isin(touched))
        was = old.select(self.key, "bucket", F.struct(*rest, "first_batch", "last_batch").alias("old"))
        both = was.join(new.select(self.key, "bucket", F.struct(*rest).alias("new")), [self.key, "bucket"], "full")
        o, n = F.col("old"), F.col("new")
        kept, fresh = n.isNull() | (o["last_batch"] >= number), o.isNull()
        made = combine(o, n)
        out = [F.when(kept, o[c]).when(fresh, n[c]).otherwise(made.get(c, n[c])).alias(c) for c in rest]
        out += [F.when(fresh, F.lit(number)).otherwise(o["first_batch"]).cast("long").alias("first_batch"),
                F.when(kept & ~fresh, o["last_batch"]).otherwise(F.lit(number)).cast("long").alias("last_batch")]
        # read in full before the buckets it came from are replaced
        done = written(both.select(self.key, *out, "bucket"), "merged")
        done.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched

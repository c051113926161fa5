"""Contents of a stream saved once each, however often a batch runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftline.operators.dedup import new_contents


@dataclass(frozen=True)
class History:
    """Saved contents below ``path``, and beside them their addresses (url and platform).

    Contents lie in folders by the first ``digits`` of their hash, addresses by those of the address's, so that a batch reads
    just the folders in which its rows could be. Below these there is a folder for each batch: a batch that
    runs again, after a failure or from an old checkpoint, doesn't see what it wrote itself, comes to the same rows, and puts them
    over the first ones. One stream, with one checkpoint, writes a history.

    Columns of contents, besides any others: pos, content_hash, url, platform; ``schema`` has all of them. A row
    without a hash is like no other, and lies in a folder of its own.
    """

    path: str
    schema: StructType
    digits: int = 2

    def start(self, contents: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return contents.writeStream.foreachBatch(self.save).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def rows(self, spark: SparkSession) -> DataFrame:
        """All contents, each with the id of its batch."""
        return self._read(spark, "contents", self.schema).drop("prefix")

    def save(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(self.schema.names).persist()
        try:
            history = self._near(spark, "contents", self.schema, rows.select(self._prefix(F.col("content_hash"))), batch_id)
            places = StructType().add("url", "string").add("platform", "string")
            known = self._near(spark, "addresses", places, rows.select(self._prefix(self._address())), batch_id)
            fresh = new_contents(rows, history, known).persist()
            try:
                self._write(fresh.withColumn("prefix", self._prefix(F.col("content_hash"))), "contents", batch_id)
                named = fresh.filter("url <> ''").select("url", "platform").withColumn("prefix", self._prefix(self._address()))
                self._write(named, "addresses", batch_id)
            finally:
                fresh.unpersist()
        finally:
            rows.unpersist()

    @staticmethod
    def _address() -> Column:
        return F.md5(F.concat_ws("|", "url", "platform"))

    def _prefix(self, hashed: Column) -> Column:
        return F.concat(F.lit("p"), F.coalesce(F.substring(hashed, 1, self.digits), F.lit(""))).alias("prefix")

    def _near(self, spark: SparkSession, name: str, schema: StructType, prefixes: DataFrame, batch_id: int) -> DataFrame:
        """What other batches saved in the folders of some prefixes, of which there are 16 ** digits, and one, at most."""
        found = [r[0] for r in prefixes.distinct().collect()]
        return self._read(spark, name, schema).filter(F.col("prefix").isin(found) & (F.col("batch_id") != batch_id)).select(schema.names)

    def _read(self, spark: SparkSession, name: str, schema: StructType) -> DataFrame:
        path = f"{self.path}/{name}"
        whole = StructType([*schema.fields]).add("prefix", "string").add("batch_id", "long")
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], whole)
        return spark.read.schema(whole).parquet(path)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        numbered = rows.withColumn("batch_id", F.lit(batch_id).cast("long")).hint("rebalance", "prefix")
        dynamic = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic.partitionBy("prefix", "batch_id").parquet(f"{self.path}/{name}")

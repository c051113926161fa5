"""Tables in hash buckets, of which a change reads and rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.operators.store import updated
from siftline.sources.shared import removed, stored
from siftline.sources.tables import upserted


@dataclass(frozen=True)
class Bucketed:
    """A table below ``path``, a folder for each bucket of its keys' hashes.

    A change finds the buckets of its rows (``n`` at most come to the driver), prunes the scan to them and overwrites
    them alone. The others' files are neither read nor written. Tasks write beside the table, and a bucket's new
    files take the place of its old ones when all are done; a change that was cut short is made again, and gives the same rows.
    One writer at a time. Rows with null keys are in a bucket like others.
    """

    path: str
    keys: tuple[str, ...]
    n: int
    schema: StructType

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def create(self, df: DataFrame) -> None:
        self._write(df.select(self.schema.names).withColumn("bucket", self.bucket()))

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).drop("bucket")

    def upsert(self, new: DataFrame, order: str) -> list[int]:
        """Of the rows with equal keys the latest stays; gives the buckets that were written."""
        return self._change(new, lambda old, rows: upserted(old, rows.select(self.schema.names), list(self.keys), order))

    def update(self, new: DataFrame, columns: list[str], clear_empty: bool = False, order: str | None = None) -> list[int]:
        """New values for rows that are there, by a single key."""
        (key,) = self.keys
        return self._change(new, lambda old, rows: updated(old, rows, key, columns, clear_empty, order))

    def delete(self, gone: DataFrame) -> list[int]:
        """Take out the rows with these keys. Folders of buckets in which nothing is left go."""
        spark = gone.sparkSession

        def rest(old: DataFrame, rows: DataFrame) -> DataFrame:
            return old.join(rows.select(*self.keys).distinct(), list(self.keys), "left_anti")

        placed, touched = self._touched(gone.select(*self.keys))
        if touched:
            left = stored(rest(self._of(spark, touched), placed).withColumn("bucket", self.bucket()), "left")
            full = {r[0] for r in left.select("bucket").distinct().collect()}
            self._write(left)
            for bucket in set(touched) - full:
                removed(spark, f"{self.path}/bucket={bucket}")
        return touched

    def _change(self, by: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        placed, touched = self._touched(by)
        if touched:
            made = change(self._of(by.sparkSession, touched), placed).select(self.schema.names)
            # a key that changed would take its row to a bucket whose other rows weren't read
            here = F.when(self.bucket().isin(touched), self.bucket()).otherwise(F.raise_error(F.lit("a change may not alter keys")).cast("int"))
            self._write(made.withColumn("bucket", here))
        return touched

    def _touched(self, by: DataFrame) -> tuple[DataFrame, list[int]]:
        placed = stored(by.withColumn("bucket", self.bucket()), "change")
        return placed.drop("bucket"), sorted(r[0] for r in placed.select("bucket").distinct().collect())

    def _of(self, spark: SparkSession, touched: list[int]) -> DataFrame:
        return self._read(spark).filter(F.col("bucket").isin(touched)).drop("bucket")

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields]).add("bucket", "integer")).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        dynamic = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic.partitionBy("bucket").parquet(self.path)

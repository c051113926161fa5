"""Sources and sinks: Parquet tables, JSON backups, upserts, content-addressed files, logs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from .listings import Listing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this key, if there is one; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def with_creator_defaults(creators: DataFrame, as_of: Column) -> DataFrame:
    """New creators: display name from the user name, 60 minutes between crawls, idle, the next crawl in one interval."""
    minutes = F.when(F.coalesce("crawl_interval", F.lit(0)) <= 0, 60).otherwise(F.col("crawl_interval"))
    return (
        creators.withColumn("display_name", F.coalesce(F.nullif("display_name", F.lit("")), F.col("username")))
        .withColumn("crawl_interval", minutes)
        .withColumn("crawl_status", F.lit("idle"))
        .withColumn("auto_crawl_enabled", F.lit(True))
        .withColumn("next_crawl_at", as_of + F.make_dt_interval(mins=F.col("crawl_interval").cast("int")))
    )


def with_task_defaults(tasks: DataFrame) -> DataFrame:
    limit = F.when(F.coalesce("limit", F.lit(0)) <= 0, 10).otherwise(F.col("limit"))
    return tasks.withColumn("limit", limit).withColumn("status", F.lit("pending"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """Of the rows with equal keys the latest, a new one before an old one of the same time."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("__new")))
    return both.withColumn("__rank", latest).filter("__rank = 1").drop("__rank", "__new")


def inserted_if_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti").select(old.columns))


def seeded(old: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed if there are no rows yet."""
    return seed if old.isEmpty() else old


def objects(spark: SparkSession, path: str, recursive: bool = True, prefix: str = "") -> DataFrame:
    """Files below a path: path, size, modified; contents aren't read.

    Only folders that can hold a path with the ``prefix`` (which starts below ``path``) are listed. Where nothing matches
    there are no rows.
    """
    spark.dataSource.register(Listing)
    return spark.read.format("listing").options(path=path, prefix=prefix, recursive=str(recursive).lower()).load()


def with_prefix(files: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    return files.filter(F.startswith("path", F.lit(prefix))).orderBy("path").limit(limit if limit > 0 else 20)


def by_hash_in_path(files: DataFrame, hash_text: str) -> DataFrame:
    """The first file whose name holds a hash."""
    return files.filter(F.contains("path", F.lit(hash_text))).orderBy("path").limit(1)


def listing(files: DataFrame, folder: str) -> DataFrame:
    """(path, is_folder, size, total_count): the files right in a folder and its folders, these with size 0.

    The count is joined as one row.
    """
    below = files.filter(F.startswith("path", F.lit(folder.rstrip("/") + "/")))
    rest = F.substring("path", len(folder.rstrip("/")) + 2, 1 << 20)
    name = F.substring_index(rest, "/", 1)
    found = below.groupBy(F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path")).agg(
        F.bool_or(F.contains(rest, F.lit("/"))).alias("is_folder"), F.max("size").alias("size")
    )
    total = found.agg(F.count("*").alias("total_count"))
    sized = found.withColumn("size", F.when(F.col("is_folder"), 0).otherwise(F.col("size")))
    return sized.crossJoin(F.broadcast(total))


def by_content_hash(files: DataFrame, known: DataFrame, folder: str, as_of: int) -> DataFrame:
    """New contents with a key made of their MD5; known hashes, and later copies, are left out."""
    hashed = files.withColumn("hash", F.md5("content"))
    first = F.row_number().over(W.partitionBy("hash").orderBy("path"))
    fresh = hashed.withColumn("__rank", first).filter("__rank = 1").drop("__rank").join(known, "hash", "left_anti")
    ending = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return fresh.withColumn("key", F.concat(F.lit(f"{folder}/"), F.col("hash"), F.lit(f"_{as_of}"), ending))


def backed_up(df: DataFrame, path: str) -> None:
    """One JSON object a line; times as ISO text."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def restored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A backup by its schema; fields that end in _at are times, in nested documents too, text that is none becomes null."""
    found = spark.read.schema(_as_text(schema)).json(path)
    return found.select(*(_with_times(F.col(f.name), f.dataType, f.name).alias(f.name) for f in schema))


def bad_times(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """What of a backup was to be a time and is none, kept as it was: the keys, the field's path and its text."""
    found = spark.read.schema(_as_text(schema)).json(path)

    def times(kind: StructType, before: str = "") -> list[str]:
        inner = [f"{before}{f.name}" for f in kind if _is_time(f.name)]
        return inner + [x for f in kind if isinstance(f.dataType, StructType) for x in times(f.dataType, f"{before}{f.name}.")]

    fields = [F.struct(F.lit(x).alias("field"), F.col(x).alias("text")) for x in times(schema)]
    each = found.select(*keys, F.inline(F.array(*fields)))
    return each.filter(F.col("text").isNotNull() & F.try_to_timestamp("text").isNull())


def restored_into(spark: SparkSession, path: str, target: str, schema: StructType, clear: bool = False) -> None:
    """A backup added to a stored table, or put in its place if that is to be cleared first."""
    restored(spark, path, schema).write.mode("overwrite" if clear else "append").parquet(target)


def _is_time(name: str) -> bool:
    return name.endswith(("_at", "At"))


def _as_text(schema: StructType) -> StructType:
    """The schema in which times are texts."""
    def kind(f: StructField) -> DataType:
        return StringType() if _is_time(f.name) else _as_text(f.dataType) if isinstance(f.dataType, StructType) else f.dataType

    return StructType([StructField(f.name, kind(f)) for f in schema])


def _with_times(c: Column, kind: DataType, name: str) -> Column:
    if isinstance(kind, StructType):
        inner = F.struct(*(_with_times(c.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind))
        return F.when(c.isNotNull(), inner)
    return F.try_to_timestamp(c).cast(kind) if _is_time(name) else c


def settings(path: str, default: dict) -> dict:
    """A JSON file of settings over defaults; without a readable file the defaults."""
    try:
        return default | json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return dict(default)


def access_log(requests: DataFrame, path: str) -> None:
    """One line a request, a folder for each day."""
    line = F.format_string("%s | %s | %s | %.3f", F.col("ts").cast("string"), "user_id", "event_type", "value")
    requests.select(F.to_date("ts").alias("day"), line.alias("value")).write.mode("overwrite").partitionBy("day").text(path)


def response_posts(body: Column, post: str) -> Column:
    """The posts of a reply, whichever shape it has: ``posts``, else ``data``, else itself where ``total`` is over 0."""
    whole = F.from_json(body, f"posts array<{post}>, data array<{post}>, total long")
    alone = F.when(whole["total"] > 0, F.array(F.from_json(body, post)))
    return F.coalesce(F.nullif(whole["posts"], F.array().cast(f"array<{post}>")), whole["data"], alone)

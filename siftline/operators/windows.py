"""Order-dependent logic as windows: moving means, changes, eviction, time defaults, rate limits."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siftline.sources.shared import stored


def moving_mean(df: DataFrame, value: str, order: list[str], rows: int = 1000, block: int = 100_000) -> DataFrame:
    """``mean``: of the last ``rows`` rows, this one included, in the order given.

    One global order is one task as a window. Here rows are numbered by ``row_numbers`` and cut into blocks of
    ``block`` rows; a block also gets the last rows of the one before, and windows run within blocks. Sums of
    whole numbers are exact in any order, so their mean is the difference of two running sums; other numbers
    are summed anew for each row.
    """
    numbered = row_numbers(df, order)
    own = (F.floor((F.col("__n") - 1) / block)).alias("__block")
    spread = numbered.select("*", own, F.lit(True).alias("__own"))
    lead = numbered.filter(((F.col("__n") - 1) % block) >= block - rows + 1).select(
        "*", (F.floor((F.col("__n") - 1) / block) + 1).alias("__block"), F.lit(False).alias("__own")
    )
    within = W.partitionBy("__block").orderBy("__n")
    both = spread.unionByName(lead)
    if isinstance(df.schema[value].dataType, IntegralType):
        running = both.withColumn("__sum", F.sum(value).over(within)).withColumn("__count", F.count(value).over(within))
        before = {c: F.coalesce(F.lag(c, rows).over(within), F.lit(0)) for c in ("__sum", "__count")}
        held = F.nullif(F.col("__count") - before["__count"], F.lit(0))
        mean = (F.col("__sum") - before["__sum"]).cast("double") / held
        found = running.withColumn("mean", mean).drop("__sum", "__count")
    else:
        found = both.withColumn("mean", F.avg(value).over(within.rowsBetween(1 - rows, 0)))
    return found.filter("__own").drop("__n", "__block", "__own")


def _ranged(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Rows sorted by ranges of ``by`` and ``order`` and written, with ``__id``, whose high bits are the range's number."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    return stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "sorted")


def _same(by: list[str]) -> Column:
    """Joins what is known of a part and group, ``__p`` and ``__`` each of ``by``, to its rows."""
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return same


def totals_before(df: DataFrame, value: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """``__before``: the sum of a value over the rows that come before, of all or of those equal in ``by``; nulls come first.

    As in ``row_numbers``, no task holds all rows, nor all of a group.
    """
    by = list(by)
    ranged = _ranged(df, order, by).withColumn("__part", F.shiftright("__id", 33))
    sums = ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"), *(F.col(c).alias(f"__{c}") for c in by))
    within = W.partitionBy("__part", *by).orderBy("__id").rowsBetween(W.unboundedPreceding, -1)
    running = ranged.withColumn("__running", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return running.join(offsets, _same(by)).select(*df.columns, (F.col("__offset") + F.col("__running")).alias("__before"))


def row_numbers(df: DataFrame, order: list[str], by: list[str] = ()) -> DataFrame:
    """``__n``: each row's place in an order, of all rows or of those equal in ``by``, from 1; nulls come first.

    No task holds all rows, nor all of a group: rows are sorted by range of ``by`` and ``order`` together, and a row's
    place is that within its part, after what earlier parts hold of its group. The sorted rows are written
    to the shared folder first, so that counting and numbering see the same parts.
    """
    by = list(by)
    ranged = _ranged(df, order, by)
    part, place = F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.select(*by, part, place.alias("__place")).groupBy(*by, "__part").agg(F.count("*").alias("__size"), F.min("__place").alias("__first"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a part and group
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    renamed = offsets.select(F.col("__part").alias("__p"), "__first", "__before", *(F.col(c).alias(f"__{c}") for c in by))
    joined = ranged.withColumn("__part", part).join(renamed, _same(by))
    return joined.withColumn("__n", F.col("__before") + place - F.col("__first") + 1).select(*df.columns, "__n")


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("rank") <= n)


def status_changes(df: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Rows where a status differs from the one before; before the first row it was false."""
    before = F.lag(status, 1, False).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("before", before).filter(F.col(status) != F.col("before"))


def evicted(df: DataFrame, platform: str, order: list[str], platform_cap: int = 5) -> DataFrame:
    """The least recently used rows of each platform that stand in the way of one more. ``order`` tells rows apart.

    What stays of a platform is a handful of newest rows, which Spark cuts before it shuffles; what is older than
    all of them goes. No task holds a platform.
    """
    if platform_cap <= 1:
        return df
    place = F.struct(*order)
    rank = F.row_number().over(W.partitionBy(platform).orderBy(*(F.desc(c) for c in order)))
    newest = df.withColumn("__rank", rank).filter(F.col("__rank") < platform_cap)
    oldest = newest.groupBy(F.col(platform).alias("__platform")).agg(F.min(place).alias("__oldest_kept"))
    older = F.col(platform).eqNullSafe(F.col("__platform")) & (place < F.col("__oldest_kept"))
    return df.join(oldest, older).select(df.columns)


def dated(df: DataFrame, time: str, as_of: Column, pos: str, batch: str) -> DataFrame:
    """Rows without a time get one: an hour before for each place in their batch."""
    placed = row_numbers(df, [pos], [batch])
    hours = F.make_dt_interval(hours=F.col("__n").cast("int"))
    return placed.withColumn(time, F.coalesce(F.col(time), as_of - hours)).drop("__n")


def rate_limited(df: DataFrame, client: str, rate: int, window: timedelta, most: int = 1_000_000) -> DataFrame:
    """(client, event_id, accepted): fixed windows of ``rate`` requests a client; one too many blocks it for a window.

    A client's requests stream through one task in order, with a state of three values, so that they are never held
    together. Clients of more than ``most`` requests are spread over all tasks instead, see ``limited_by_jumps``; which
    way a client goes makes no difference to the result.
    """
    rows = df.select(client, "ts", "event_id")
    busy = stored(rows.groupBy(client).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > most).select(client), "busy")
    if busy.isEmpty():
        return _limited_in_order(rows, client, rate, window)
    hot = rows.join(busy, rows[client].eqNullSafe(busy[client]), "left_semi")
    rest = rows.join(busy, rows[client].eqNullSafe(busy[client]), "left_anti")
    return _limited_in_order(rest, client, rate, window).unionByName(limited_by_jumps(hot, client, rate, window))


def limited_by_jumps(rows: DataFrame, client: str, rate: int, window: timedelta) -> DataFrame:
    """(client, event_id, accepted), as by the sequential limiter, without its sequence.

    Whichever request begins a window, the one that begins the next follows from the times alone: the first that comes a
    window's length after the request too many, or after the window's own begin if there is none. So each request gets its
    jump, and those that do begin windows are what the client's first one reaches by jumps. They are found by
    doubling: in a round jumps of twice the length are joined, so there are as many rounds as the logarithm of the number
    of windows. Joins are on a client and a place, so a client's rows are spread like any.
    """
    length = F.make_dt_interval(secs=F.lit(window.total_seconds()))
    numbered = row_numbers(rows.select("*", _as_key(client)), ["ts", "event_id"], ["__client"])
    placed = stored(numbered.withColumnRenamed("__n", "n"), "requests")
    at = ["__client", "n"]
    over = placed.select("__client", (F.col("n") - rate).alias("n"), F.col("ts").alias("over"))
    free = F.when(F.col("over") < F.col("ts") + length, F.col("over") + length).otherwise(F.col("ts") + length)
    probes = placed.join(over, at, "left").select(*at, free.alias("time"), F.lit(0).alias("is_request"))
    both = probes.unionByName(placed.select(*at, F.col("ts").alias("time"), F.lit(1).alias("is_request")))
    found = totals_before(both, "is_request", ["time", "is_request"], ["__client"])
    first = stored(found.filter("is_request = 0").select(*at, (F.col("__before") + 1).alias("next")), "jumps")
    jumps, begun = first, placed.filter("n = 1").select(*at)
    while True:
        begun = stored(begun, "begun")
        more = begun.join(jumps, at).select("__client", F.col("next").alias("n")).join(placed.select(*at), at, "left_semi")
        if more.isEmpty():
            break
        begun = begun.unionByName(more)
        further = jumps.select("__client", F.col("n").alias("next"), F.col("next").alias("further"))
        jumps = stored(jumps.join(further, ["__client", "next"]).select(*at, F.col("further").alias("next")), "jumps")
    # the requests of a window, as many as are let through
    spans = begun.join(first, at).join(placed.select(*at, F.col("ts").alias("began")), at)
    places = F.explode(F.sequence("n", F.least(F.col("n") + rate, F.col("next")) - 1))
    within = spans.select("__client", "began", places.alias("n"))
    judged = placed.join(within, at, "left")
    return judged.select(client, "event_id", F.coalesce(F.col("ts") < F.col("began") + length, F.lit(False)).alias("accepted"))


def _as_key(client: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(client).cast("string")), F.lit("")).alias("__client")


def _limited_in_order(rows: DataFrame, client: str, rate: int, window: timedelta) -> DataFrame:
    kinds = dict(rows.dtypes)
    # clients go as text, the empty one for null, for pandas knows no whole numbers with nulls among them
    rows = rows.select(_as_key(client), "ts", "event_id").repartition("__client").sortWithinPartitions("__client", "ts", "event_id")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = object()
        start = until = None
        n = 0
        for frame in frames:
            accepted = []
            for who, ts in zip(frame["__client"], frame["ts"], strict=True):
                if who != now:
                    now, start, until, n = who, ts, None, 1
                    accepted.append(True)
                elif until is not None and ts < until:
                    accepted.append(False)
                elif ts - start >= window:
                    start, until, n = ts, None, 1
                    accepted.append(True)
                else:
                    n += 1
                    if n > rate:
                        until = ts + window
                    accepted.append(n <= rate)
            yield frame.assign(accepted=accepted)[["__client", "event_id", "accepted"]]

    found = rows.mapInPandas(scan, f"__client string, event_id {kinds['event_id']}, accepted boolean")
    given = F.when(F.col("__client") != "", F.substring("__client", 2, 1 << 20)).cast(kinds[client])
    return found.select(given.alias(client), "event_id", "accepted")

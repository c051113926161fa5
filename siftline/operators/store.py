"""Queries, updates and deletes over stored tables.

Parquet has no update in place: an update is a new version of the row, a delete an anti-join. A null in
a condition never deletes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampNTZType, TimestampType

OBJECT_ID = "^[0-9a-fA-F]{24}$"


def equal_where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality with each value that is given; None and empty text filter nothing."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == F.lit(value))
    return df


def selected(df: DataFrame, ids: list[str], allow_all: bool = False, **wanted: object) -> DataFrame:
    """Rows by id, ill-formed ids dropped; without ids by the equalities; without any of them nothing, unless allowed."""
    if ids:
        return df.filter(F.col("id").isin(ids) & F.col("id").rlike(OBJECT_ID))
    if not allow_all and all(v in (None, "") for v in wanted.values()):
        return df.filter(F.lit(False))
    return equal_where_given(df, **wanted)


def is_due(auto: Column, status: Column, next_at: Column, as_of: Column) -> Column:
    """Automatic, not under way, and its time has come or was never set."""
    return auto & (status.isNull() | (status != "crawling")) & (next_at.isNull() | (next_at <= as_of))


def is_valid_session(active: Column, expires: Column, as_of: Column) -> Column:
    return active & (expires.isNull() | (expires >= as_of))


def is_active_session(active: Column, expires: Column, as_of: Column) -> Column:
    return F.coalesce(active & (expires > as_of), F.lit(False))


def is_unread(read: Column) -> Column:
    return ~F.coalesce(read, F.lit(False))


def matches(text: str, *columns: Column) -> Column:
    """The text stands in one of the columns, whatever the case; an empty text matches."""
    found = F.lit(text == "")
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return found


def searched(posts: DataFrame, text: str, platform: str = "all", creator: str = "all", recent: int | None = None) -> DataFrame:
    """Posts by platform, creator and text. recent: search only so many newest ones, as a screen of them would."""
    if recent is not None:
        posts = posts.orderBy(F.desc("created_at"), "id").limit(recent)
    wanted = {k: v for k, v in (("platform", platform), ("creator_id", creator)) if v != "all"}
    return equal_where_given(posts, **wanted).filter(matches(text, F.col("title"), F.col("content")))


def looked_up(left: DataFrame, right: DataFrame, on: str, name: str, default: str) -> DataFrame:
    """``left`` with the right side's name for its key; the least name where the right side has several."""
    names = right.groupBy(on).agg(F.min(name).alias(name))
    return left.join(names, on, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def members_named(teams: DataFrame, people: DataFrame, most: int = 3) -> DataFrame:
    """team_id and the names of its first members, in order. Columns: team_id, member_ids; person_id, name."""
    ids = teams.select("team_id", F.posexplode(F.slice("member_ids", 1, most)).alias("pos", "person_id"))
    named = ids.join(people.groupBy("person_id").agg(F.min("name").alias("name")), "person_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return named.groupBy("team_id").agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def cascaded(tasks: DataFrame, contents: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tasks and contents without the tasks that are gone and what belongs to them."""
    return tasks.join(gone, key, "left_anti"), contents.join(gone, key, "left_anti")


def updated(old: DataFrame, new: DataFrame, key: str, columns: list[str], clear_empty: bool = False, order: str | None = None) -> DataFrame:
    """New values over old ones. An empty or missing new value keeps the old one; with ``clear_empty`` it removes it.

    Of new rows with equal keys the last in ``order`` counts, without an order any one; no row of ``old`` is multiplied.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order) if order else F.lit(0)))
    last = new.select("*", place.alias("__place")).filter("__place = 1")
    renamed = last.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    joined = old.join(renamed, key, "left")
    for c in columns:
        value = F.nullif(F.col(f"__{c}"), F.lit("")) if dict(old.dtypes)[c] == "string" else F.col(f"__{c}")
        kept = F.when(F.col("__hit"), value).otherwise(F.col(c)) if clear_empty else F.coalesce(value, F.col(c))
        joined = joined.withColumn(c, kept)
    return joined.select(old.columns)


def without(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def marked_read(notes: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """Notes of valid sessions become read now; those read before keep their time."""
    mine = sessions.filter(is_valid_session(F.col("is_active"), F.col("expires_at"), as_of)).select("session_id").distinct()
    hit = notes.join(mine.withColumn("__hit", F.lit(True)), "session_id", "left")
    now = F.col("__hit") & is_unread(F.col("read"))
    return hit.withColumn("read_at", F.when(now, as_of).otherwise(F.col("read_at"))).withColumn(
        "read", F.when(now, True).otherwise(F.col("read"))
    ).select(notes.columns)


def modified(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows an update matched by their keys, and how many of them it changed."""
    columns = [c for c in before.columns if c not in keys]
    new = after.select(*keys, F.struct(*columns).alias("__new"))
    both = before.select(*keys, F.struct(*columns).alias("__old")).join(new, keys)
    return both.agg(F.count("*").alias("matched"), F.count_if(~F.col("__old").eqNullSafe(F.col("__new"))).alias("modified"))


def without_owned(df: DataFrame, row: object, user: object, key: str = "id", owner: str = "user_id") -> DataFrame:
    """All but one row, which goes only if it is the user's own."""
    return without(df, (F.col(key) == F.lit(row)) & (F.col(owner) == F.lit(user)))


def without_instance(df: DataFrame, instance: object, platform: str | None = None, key: str = "instance_id") -> DataFrame:
    """All but the rows of an instance, or only of one of its platforms if that is named."""
    gone = F.col(key) == F.lit(instance)
    return without(df, gone if platform is None else gone & (F.col("platform") == platform))


def searched_videos(videos: DataFrame, text: str = "", status: str = "all", creator: str = "all") -> DataFrame:
    """Videos whose title holds the text, of one status and of one creator if they are named."""
    wanted = {k: v for k, v in (("status", status), ("creator_id", creator)) if v != "all"}
    return equal_where_given(videos, **wanted).filter(matches(text, F.col("title")))


def searched_items(items: DataFrame, text: str = "", category: str = "all") -> DataFrame:
    """Items whose name or description holds the text, of one category if it is named."""
    wanted = {} if category == "all" else {"category": category}
    return equal_where_given(items, **wanted).filter(matches(text, F.col("name"), F.col("description")))


def expired_tasks(tasks: DataFrame, as_of: Column, days: int = 7) -> Column:
    ended = F.col("status").isin("completed", "failed", "cancelled")
    return ended & (F.col("completed_at") < as_of - F.make_dt_interval(days=F.lit(days)))


def expired(as_of: Column) -> Column:
    """Sessions, instances and cookies that go: expired or no longer active."""
    return (F.col("expires_at") < as_of) | ~F.col("is_active")


def older_than(time: Column, as_of: Column, days: int = 30) -> Column:
    """What retention removes."""
    return time < as_of - F.make_dt_interval(days=F.lit(days))


def publishing(requests: DataFrame, outcomes: DataFrame, task: str = "task_id") -> DataFrame:
    """Publish tasks by how far they have come: pending, processing once they are taken up, then as they end.

    Columns: task, taken_up; task, outcome.
    """
    state = F.coalesce("outcome", F.when(F.col("taken_up"), "processing"), F.lit("pending"))
    return requests.join(outcomes.select(task, "outcome"), task, "left").withColumn("status", state).drop("outcome")


def taken_up(creators: DataFrame, as_of: Column, at_once: int = 3) -> DataFrame:
    """Of the creators that are due the ones waiting longest, so many at once as may run beside those under way."""
    running = creators.filter("crawl_status = 'crawling'").limit(at_once).count()
    due = creators.filter(is_due(F.col("auto_crawl_enabled"), F.col("crawl_status"), F.col("next_crawl_at"), as_of))
    return due.orderBy(F.asc_nulls_first("next_crawl_at"), "id").limit(at_once - running)


def string_at(document: Column, key: str) -> Column:
    """The text under a key of a JSON document, only if it is a text; else an empty one."""
    value = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.lit(""))


def strings_at(document: Column, key: str) -> Column:
    """The texts in the array under a key of a JSON document; what is no text is left out."""
    values = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "array<variant>")
    texts = F.transform(F.filter(values, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def as_texts(df: DataFrame) -> DataFrame:
    """Every column as text, times as ISO text; what is nested becomes JSON."""
    def text(name: str, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
        return F.to_json(name) if kind.startswith(("struct", "array", "map")) else F.col(name).cast("string")

    return df.select(*(text(n, k).alias(n) for n, k in df.dtypes))


def iso_text(c: Column) -> Column:
    """A time as ISO text, with a fraction of a second if there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.date_format(c, ".SSSSSS")))


def texted(df: DataFrame) -> DataFrame:
    """Times as ISO text and binary ids as hexadecimal text at any depth; all else stays as it is, in its place.

    The walk is over the schema, so rows are never read one by one: structs, arrays and maps are rebuilt by
    expressions. A null at any depth stays null.
    """
    def walked(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(walked(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: walked(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(c, lambda _, v: walked(v, kind.valueType))
        if isinstance(kind, TimestampType | TimestampNTZType):
            return iso_text(c)
        return F.lower(F.hex(c)) if isinstance(kind, BinaryType) else c

    return df.select(*(walked(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def enabled(configurations: DataFrame, platform: str | None = None) -> DataFrame:
    """Configurations that are enabled, of one platform if it is named."""
    return equal_where_given(configurations.filter(F.coalesce("enabled", F.lit(False))), platform=platform)


def with_status(tasks: DataFrame, events: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks by their last event: running sets the start, an end sets the end; an empty error changes nothing.

    Columns of events: key, seq, status, error, at.
    """
    last = events.groupBy(key).agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by(F.when(F.col("status") == "running", F.col("at")), F.when(F.col("status") == "running", F.col("seq"))).alias("started_at"),
        F.max_by(
            F.when(F.col("status").isin("completed", "failed"), F.col("at")),
            F.when(F.col("status").isin("completed", "failed"), F.col("seq")),
        ).alias("completed_at"),
        F.max_by(F.nullif("error", F.lit("")), F.when(F.coalesce("error", F.lit("")) != "", F.col("seq"))).alias("error"),
    )
    return tasks.join(last, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def after_crawls(creators: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Idle with a next time after success; failed, to be tried at the next look, otherwise. Columns: id, error."""
    hit = creators.join(results.select("id", F.col("error").alias("__error"), F.lit(True).alias("__hit")), "id", "left")
    failed = F.coalesce("__error", F.lit("")) != ""
    next_at = as_of + F.make_dt_interval(mins=F.col("crawl_interval").cast("int"))
    return (
        hit.withColumn("crawl_status", F.when(F.col("__hit"), F.when(failed, "failed").otherwise("idle")).otherwise(F.col("crawl_status")))
        .withColumn("next_crawl_at", F.when(F.col("__hit") & ~failed, next_at).otherwise(F.col("next_crawl_at")))
        .withColumn("crawl_error", F.when(F.col("__hit"), F.when(failed, F.col("__error"))).otherwise(F.col("crawl_error")))
        .select(creators.columns)
    )


def as_posts(contents: DataFrame) -> DataFrame:
    """Contents as the posts a screen shows: media are images and then the video, the first image leads."""
    video = F.when(F.coalesce("video_url", F.lit("")) != "", F.array("video_url")).otherwise(F.array().cast("array<string>"))
    images = F.coalesce("images", F.array().cast("array<string>"))
    return contents.select(
        "id",
        F.col("task_id").alias("creator_id"),
        F.col("origin_id").alias("post_id"),
        "title",
        "content",
        "platform",
        F.concat(images, video).alias("media_urls"),
        F.get(images, F.lit(0)).alias("image_url"),
        "video_url",
        "published_at",
        "created_at",
    )


def publish_errors(video: Column, platforms: Column, description: Column, supported: list[str]) -> Column:
    """The first thing wrong with a request to publish, or null."""
    unknown = F.array_except(platforms, F.array(*map(F.lit, supported)))
    return (
        F.when(F.coalesce(video, F.lit("")) == "", "video_required")
        .when(F.coalesce(F.size(platforms), F.lit(0)) < 1, "platform_required")
        .when(F.trim(F.coalesce(description, F.lit(""))) == "", "description_required")
        .when(F.size(unknown) > 0, "platform_unsupported")
    )


def with_publish_errors(requests: DataFrame, videos: DataFrame, supported: list[str]) -> DataFrame:
    """Requests (video_id, platforms, description) with ``error``: what is wrong with them, else with their video, or null.

    Columns of videos: id, status; where an id repeats, one of its rows must be completed. Only requests that are right by
    themselves are joined, so that those without a video, however many, aren't gathered under one key. Both sides are shuffled
    by video, for a size guessed from compressed files would broadcast millions of videos; a video that many ask for is split
    by Spark as a skewed join.
    """
    known = videos.groupBy(F.col("id").alias("video_id")).agg(F.max(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("__done"))
    judged = requests.withColumn("error", publish_errors(F.col("video_id"), F.col("platforms"), F.col("description"), supported))
    joined = judged.filter("error is null").drop("error").join(known.hint("merge"), "video_id", "left")
    stored = F.when(F.col("__done").isNull(), "video_missing").when(~F.col("__done"), "video_unfinished")
    checked = joined.withColumn("error", stored).select(*requests.columns, "error")
    return judged.filter("error is not null").select(*requests.columns, "error").union(checked)


def with_registration_errors(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (username, email, password, confirm) with ``wrong``: field -> what is wrong; if nothing else is, what is taken.

    A name that is a user's name is taken; so is the address if either of the two is a user's address, or it is
    a user's name. Columns of users: username, email.
    """
    names = users.select(F.col("username").alias("__key"), F.lit(True).alias("is_name"))
    keys = names.union(users.select("email", F.lit(False))).filter("__key is not null").groupBy("__key").agg(F.bool_or("is_name").alias("__is_name"))
    by_name = keys.select(F.col("__key").alias("username"), F.col("__is_name").alias("__by_name"))
    by_email = keys.select(F.col("__key").alias("email"), F.lit(True).alias("__by_email"))
    joined = requests.join(by_name, "username", "left").join(by_email, "email", "left")
    taken = F.when(F.col("__by_name"), "username").when(F.col("__by_name").isNotNull() | F.col("__by_email").isNotNull(), "email")
    wrong = registration_errors(*(F.col(c) for c in ("username", "email", "password", "confirm")))
    found = F.when(F.size(wrong) > 0, wrong).when(taken.isNotNull(), F.create_map(taken, F.lit("taken"))).otherwise(wrong)
    return joined.withColumn("wrong", found).select(*requests.columns, "wrong")


def registration_errors(name: Column, email: Column, password: Column, again: Column) -> Column:
    """Field -> what is wrong with it; empty if nothing is. What is missing is as empty."""
    name, email, password, again = (F.coalesce(c, F.lit("")) for c in (name, email, password, again))

    def entry(condition: Column, field: str, what: str) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(what).alias("what")))

    weak = (F.char_length(password) < 6) | ~password.rlike("[A-Za-z]") | ~password.rlike("[0-9]")
    wrong = F.array(
        entry(F.char_length(F.trim(name)) < 3, "username", "too_short"),
        entry(~email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "email", "malformed"),
        entry(weak, "password", "too_weak"),
        entry(password != again, "confirm", "differs"),
    )
    return F.map_from_entries(F.filter(wrong, lambda x: x.isNotNull()))

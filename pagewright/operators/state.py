"""Keyed state over logs: history, bookmarks, suggestions and search results, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entries that a history keeps.
HISTORY = 2000
#: Parts that an owner's keys are ranked in before they are ranked together.
BUCKETS = 64


def recent(visits: DataFrame, owner: str, limit: int = HISTORY) -> DataFrame:
    """(owner, kind, target, title, time_s, place): each owner's latest visit of every target, newest first, ``limit``
    at most. The latest per key is a partial aggregate, so only one row a key is sorted."""
    latest = visits.groupBy(owner, "kind", "target").agg(F.max_by(F.struct("title", "time_s", "id"), F.struct("time_s", "id")).alias("v"))
    latest = latest.select(owner, "kind", "target", F.col("v.title").alias("title"), F.col("v.time_s").alias("time_s"), F.col("v.id").alias("id"))
    # an owner may hold a tenth of all keys: its newest are found in buckets first, so no task sorts more than a bucket
    bucket = F.pmod(F.xxhash64("kind", "target"), F.lit(BUCKETS))
    newest = [F.desc("time_s"), F.desc("id")]
    near = latest.withColumn("bucket", bucket).withColumn("place", F.row_number().over(W.partitionBy(owner, "bucket").orderBy(*newest))).where(F.col("place") <= limit)
    return near.drop("bucket").withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(*newest))).where(F.col("place") <= limit)


def toggled(actions: DataFrame, owner: str, target: str) -> DataFrame:
    """(owner, target, added): what an odd number of toggles leaves, at the time of the last."""
    t = actions.groupBy(owner, target).agg(F.count("*").alias("n"), F.max("ts").alias("added"))
    return t.where("n % 2 = 1").select(owner, target, "added")


def matches(query: str, title: Column, target: Column) -> Column:
    """Whether every word of a query stands in a title and target, without case."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(target, F.lit(""))))
    out = F.lit(True)
    for word in query.lower().split():
        out = out & F.contains(hay, F.lit(word))
    return out


def suggestions(items: DataFrame, owner: str, query: str, limit: int = 11, bookmarks_only: bool = False) -> DataFrame:
    """(owner, kind, target, title, mark, place): bookmarks that match, then history that matches and is not marked,
    each newest first. An item is marked by any bookmark of it, whether that matches or not. One row a key is kept in a
    partial aggregate before anything is sorted."""
    is_mark = F.col("list_name") == "bookmarks"
    row, order = F.struct(F.coalesce("title", F.lit("")).alias("title"), "time_s"), F.struct("time_s", "item_id")
    keys = items.groupBy(owner, "kind", "target").agg(F.max_by(row, F.when(is_mark, order)).alias("marked"), F.max_by(row, F.when(~is_mark, order)).alias("visited"))
    shown = keys.select(owner, "kind", "target", F.col("marked").isNotNull().cast("int").alias("mark"), F.coalesce("marked", "visited").alias("r"))
    hit = shown.where(matches(query, F.col("r.title"), F.col("target")))
    hit = hit.where("mark = 1") if bookmarks_only else hit
    place = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("mark"), F.desc("r.time_s"), "kind", "target"))
    return hit.select(owner, "kind", "target", "r.title", "mark", place.alias("place")).where(F.col("place") <= limit)


def without(items: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of items after those of some keys are removed; a null part of a key equals a null."""
    g = gone.select(*[F.col(k).alias(f"gone_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"gone_{k}"))
    return items.join(g, same, "left_anti")


def find(items: DataFrame, owner: str, kind: str, target: str) -> DataFrame:
    """Each owner's newest item of one key."""
    hit = items.where((F.col("kind") == kind) & (F.col("target") == target))
    newest = hit.groupBy(owner).agg(F.max_by(F.struct("item_id", "title", "time_s"), F.struct("time_s", "item_id")).alias("v"))
    return newest.select(owner, "v.*")


def cleared(items: DataFrame, since: Column) -> DataFrame:
    """What is left after entries from a time on are removed."""
    return items.where(F.col("time_s") < since)


def days(items: DataFrame, now_s: int) -> DataFrame:
    """Each entry's day (today, yesterday, its date, or unknown for a time of 0), its minute, and whether a heading
    stands before it in its owner's list."""
    at = F.timestamp_seconds("time_s")
    today = F.to_date(F.timestamp_seconds(F.lit(now_s)))
    day = F.when(F.col("time_s") <= 0, "unknown").when(F.to_date(at) == today, "today").when(F.to_date(at) == F.date_sub(today, 1), "yesterday").otherwise(F.date_format(at, "yyyy-MM-dd"))
    w = W.partitionBy("profile_id", "list_name").orderBy(F.desc("time_s"), F.desc("item_id"))
    out = items.withColumn("day", day).withColumn("minute", F.when(F.col("time_s") > 0, F.date_format(at, "HH:mm")).otherwise(""))
    before = F.lag("day").over(w)
    return out.withColumn("heading", before.isNull() | (before != F.col("day")))


def unseen(pages: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not seen before, the first of each key only."""
    first = pages.groupBy(key).agg(F.min_by(F.struct(*[c for c in pages.columns if c != key]), F.struct("rank", "id")).alias("r"))
    return first.select(key, "r.*").join(seen.select(key).distinct(), key, "left_anti")


def noted(note: Column, status: Column, removed: Column) -> Column:
    """A page's note with its status in front if that is an error, and behind how many links were removed."""
    gone = F.when(removed > 0, F.concat(F.lit("Removed "), removed.cast("string"), F.lit(" ad/tracking links")))
    return F.concat_ws(" | ", F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))), F.nullif(note, F.lit("")), gone)


def error_message(status: Column, blocks: Column) -> Column:
    """The paragraph that stands for an error page without blocks; null otherwise."""
    return F.when((status >= 400) & (F.coalesce(F.size(blocks), F.lit(0)) <= 0), F.concat(F.lit("The site answered with HTTP "), status.cast("string"), F.lit(".")))


def numbered_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """File names made unique: a number in brackets before the extension for every later one."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    base, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("n", n).withColumn("unique_name", F.when(F.col("n") == 0, F.col(name)).otherwise(F.concat(base, F.lit(" ("), F.col("n").cast("string"), F.lit(")"), ext))).drop("n")

"""Queries on logs and keyed state, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import state as S
from pagewright.plans.stages import stage_path
from pagewright.sources.tables import table
from pagewright.streaming import visits as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, d) -> DataFrame:
    """Items once, in the order of their ids."""
    return table(spark, d, "items", "item_id bigint, profile_id bigint, list_name string, kind string, target string, title string, time_s double").distinct()


_I = "(SELECT DISTINCT item_id, profile_id, list_name, kind, target, title, time_s FROM items)"


@_query(
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY profile_id, kind, target ORDER BY time_s DESC, item_id DESC) AS r FROM {_I} WHERE list_name = 'history'),
    p AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY time_s DESC, item_id DESC) AS place FROM l WHERE r = 1)
    SELECT profile_id, kind, target, title, time_s, CAST(place AS BIGINT) AS place FROM p WHERE place <= 2000"""
)
def history_recent(spark, d):
    """The newest visit of every target of a profile, 2,000 at most."""
    v = _items(spark, d).where("list_name = 'history'").withColumnRenamed("item_id", "id")
    return S.recent(v, "profile_id").select("profile_id", "kind", "target", "title", "time_s", F.col("place").cast("bigint"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


@_query("SELECT user_id, k AS target, max(ts) AS added FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click') GROUP BY ALL HAVING count(*) % 2 = 1")
def bookmark_state(spark, d):
    """Bookmarks left by toggles (here clicks on a key)."""
    return S.toggled(_events(spark, d).where("event_type = 'click'"), "user_id", "k").withColumnRenamed("k", "target")


@_query(
    f"""WITH g AS (SELECT profile_id, kind, target, count(*) FILTER (WHERE list_name = 'bookmarks') > 0 AS marked,
    arg_max(coalesce(title, ''), (time_s, item_id)) FILTER (WHERE list_name = 'bookmarks') AS mark_title, max(time_s) FILTER (WHERE list_name = 'bookmarks') AS mark_time,
    arg_max(coalesce(title, ''), (time_s, item_id)) FILTER (WHERE list_name <> 'bookmarks') AS visit_title, max(time_s) FILTER (WHERE list_name <> 'bookmarks') AS visit_time FROM {_I} GROUP BY ALL),
    h AS (SELECT profile_id, kind, target, CASE WHEN marked THEN mark_title ELSE visit_title END AS title, CASE WHEN marked THEN mark_time ELSE visit_time END AS time_s, CASE WHEN marked THEN 1 ELSE 0 END AS mark FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY mark DESC, time_s DESC, kind, target) AS place FROM h WHERE contains(lower(title || ' ' || coalesce(target, '')), 'forest') AND contains(lower(title || ' ' || coalesce(target, '')), 'a'))
    SELECT profile_id, kind, target, title, CAST(mark AS BIGINT) AS mark, CAST(place AS BIGINT) AS place FROM p WHERE place <= 11"""
)
def suggest(spark, d):
    """Up to eleven suggestions for two words: bookmarks first, then history that is not marked."""
    s = S.suggestions(_items(spark, d), "profile_id", "forest a")
    return s.select("profile_id", "kind", "target", "title", F.col("mark").cast("bigint"), F.col("place").cast("bigint"))


#: The time that "now" stands for in queries on fixed tables: the end of 2024-12-31.
NOW = 1735689599


@_query(f"SELECT r.name AS range, CAST(count(*) FILTER (WHERE time_s < r.since) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE time_s >= r.since) AS BIGINT) AS removed FROM {_I}, (VALUES ('hour', {NOW - 3600}), ('yesterday', {NOW - 86399 - 86400}), ('all', -1)) r(name, since) WHERE list_name = 'history' GROUP BY r.name")
def history_clear(spark, d):
    """What clearing the last hour, the time since yesterday's midnight, or all would leave and remove."""
    h = _items(spark, d).where("list_name = 'history'")
    counts = [(n, F.coalesce(F.sum((F.col("time_s") < s).cast("bigint")), F.lit(0)), F.coalesce(F.sum((F.col("time_s") >= s).cast("bigint")), F.lit(0))) for n, s in (("hour", NOW - 3600), ("yesterday", NOW - 86399 - 86400), ("all", -1))]
    one = h.agg(F.array(*[F.struct(F.lit(n).alias("range"), k.alias("kept"), r.alias("removed")) for n, k, r in counts]).alias("a"))
    return one.select(F.explode("a").alias("x")).select("x.*")


@_query(
    f"""WITH x AS (SELECT *, make_timestamp(CAST(floor(time_s * 1000000) AS BIGINT)) AS moment FROM {_I}),
    y AS (SELECT *, CASE WHEN time_s <= 0 THEN 'unknown' WHEN CAST(moment AS DATE) = DATE '2024-12-31' THEN 'today' WHEN CAST(moment AS DATE) = DATE '2024-12-30' THEN 'yesterday' ELSE strftime(moment, '%Y-%m-%d') END AS day, CASE WHEN time_s > 0 THEN strftime(moment, '%H:%M') ELSE '' END AS minute FROM x),
    z AS (SELECT *, lag(day) OVER (PARTITION BY profile_id, list_name ORDER BY time_s DESC, item_id DESC) AS before FROM y)
    SELECT item_id, day, minute, before IS NULL OR before <> day AS heading FROM z"""
)
def history_days(spark, d):
    """Day headings and minutes of every list."""
    return S.days(_items(spark, d), NOW).select("item_id", "day", "minute", "heading")


@_query(
    """WITH a AS (SELECT k, min(event_id) AS id FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view') GROUP BY k),
    seen AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase' AND user_id < 20)
    SELECT k, id FROM a WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.k = a.k)"""
)
def unseen_results(spark, d):
    """Keys of one log that another has not shown yet, each once."""
    e = _events(spark, d)
    rows = e.where("event_type = 'view'").select("k", F.col("event_id").alias("rank"), F.col("event_id").alias("id"))
    seen = e.where("event_type = 'purchase' AND user_id < 20").select("k")
    return S.unseen(rows, seen, "k").select("k", "id")


@_query(
    """WITH a AS (SELECT k, min(event_id) AS id FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view') GROUP BY k),
    seen AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase')
    SELECT k, id FROM a WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.k = a.k)"""
)
def unseen_results_whole(spark, d):
    """The same with the whole of the other log: keys shown to no user yet."""
    e = _events(spark, d)
    rows = e.where("event_type = 'view'").select("k", F.col("event_id").alias("rank"), F.col("event_id").alias("id"))
    return S.unseen(rows, e.where("event_type = 'purchase'").select("k"), "k").select("k", "id")


@_query("SELECT page_id FROM (SELECT DISTINCT page_id, url, note FROM page_docs) WHERE trim(coalesce(url, '')) <> '' AND NOT regexp_matches(coalesce(note, ''), 'HTTP [45][0-9][0-9]')")
def visit_log_rule(spark, d):
    """Pages whose visit is recorded: an address, no error note."""
    p = table(spark, d, "page_docs", "page_id bigint, url string, note string").distinct()
    return p.where((F.trim(F.coalesce("url", F.lit(""))) != "") & ~F.coalesce("note", F.lit("")).rlike("HTTP [45][0-9][0-9]")).select("page_id")


@_query(
    """SELECT page_id, concat_ws(' | ', CASE WHEN status >= 400 THEN 'HTTP ' || status END, nullif(note, ''), CASE WHEN removed > 0 THEN 'Removed ' || removed || ' ad/tracking links' END) AS note,
    CASE WHEN status >= 400 AND (page_id % 2 = 0 OR coalesce(len(blocks), 0) = 0) THEN 'The site answered with HTTP ' || status || '.' END AS message
    FROM (SELECT DISTINCT page_id, note, blocks, [200, 404, 503][page_id % 3 + 1] AS status, page_id % 4 AS removed FROM page_docs)"""
)
def error_notes(spark, d):
    """Notes of pages with a status (here one of three) and removed links (here up to three), and the message that an empty
    error page has (here every other page is emptied)."""
    p = table(spark, d, "page_docs", "page_id bigint, note string, blocks array<struct<kind:string>>").select("page_id", "note", F.when(F.col("page_id") % 2 == 1, F.size("blocks")).otherwise(0).alias("n")).distinct()
    status = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503)), (F.col("page_id") % 3 + 1).cast("int"))
    blocks = F.when(F.col("n") > 0, F.array_repeat(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    return p.select("page_id", S.noted(F.col("note"), status, F.col("page_id") % 4).alias("note"), S.error_message(status, blocks).alias("message"))


@_query(
    f"""SELECT item_id, CASE WHEN list_name = 'bookmarks' THEN '★ ' ELSE '  ' END || CASE WHEN kind = 'search' THEN 'Search: ' || target ELSE coalesce(nullif(title, ''), target || ' & ö') || '  ' || target || ' & ö' END AS label FROM {_I}"""
)
def suggestion_labels(spark, d):
    """Items as they are suggested: marked or not, what was searched for, else the title and the readable address (here
    with escapes at its end)."""
    i = _items(spark, d)
    readable = U.unquote(F.when(F.col("kind") == "search", F.col("target")).otherwise(F.concat("target", F.lit("%20%26%20%C3%B6"))))
    told = F.when(F.col("kind") == "search", F.concat(F.lit("Search: "), F.col("target"))).otherwise(F.concat(F.coalesce(F.nullif("title", F.lit("")), readable), F.lit("  "), readable))
    return i.select("item_id", F.concat(F.when(F.col("list_name") == "bookmarks", "★ ").otherwise("  "), told).alias("label"))


@_query(
    """WITH f AS (SELECT doc_id, regexp_extract(url, '([^/?#]*)[?#]?[^/]*$', 1) AS name FROM documents WHERE url IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS n FROM f)
    SELECT doc_id, name, CASE WHEN n = 0 THEN name ELSE regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || ' (' || n || ')' || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) END AS unique_name FROM n"""
)
def unique_file_names(spark, d):
    f = table(spark, d, "documents").where("url IS NOT NULL").select("doc_id", F.regexp_extract("url", "([^/?#]*)[?#]?[^/]*$", 1).alias("name"))
    return S.numbered_names(f, "name", "doc_id")


@_query("SELECT page_id, CAST(round_even(100.0 * pos / n, 0) AS BIGINT) AS percent FROM (SELECT DISTINCT page_id, len(blocks) AS n, len(blocks) // 2 AS pos FROM page_docs WHERE len(blocks) > 0)")
def read_position(spark, d):
    """How far a reader in the middle of a page is, in percent, halves to even."""
    p = table(spark, d, "page_docs", "page_id bigint, blocks array<struct<kind:string>>").select("page_id", F.size("blocks").alias("n")).distinct().where("n > 0")
    return p.select("page_id", F.bround(F.floor(F.col("n") / 2) * F.lit(100.0) / F.col("n"), 0).cast("bigint").alias("percent"))


@_query("SELECT url, page_id FROM (SELECT string_split(url, '#')[1] AS url, page_id, row_number() OVER (PARTITION BY string_split(url, '#')[1] ORDER BY ingested_at DESC, page_id DESC) AS r FROM page_docs WHERE url IS NOT NULL) WHERE r = 1")
def response_cache(spark, d):
    """The newest page of every address without its fragment."""
    p = table(spark, d, "page_docs", "page_id bigint, url string, ingested_at timestamp").where("url IS NOT NULL")
    return p.groupBy(F.substring_index("url", "#", 1).alias("url")).agg(F.max_by("page_id", F.struct("ingested_at", "page_id")).alias("page_id"))


@_query("SELECT user_id, CAST(count(*) AS BIGINT) AS live, max(expires) AS last FROM (SELECT user_id, ts + to_seconds(CAST(floor(value) AS BIGINT) * 3600) AS expires FROM events) WHERE expires > TIMESTAMP '2024-01-30' GROUP BY user_id")
def live_cookies(spark, d):
    """Entries with a lifetime that have not expired at a given time."""
    e = table(spark, d, "events").select("user_id", F.expr("ts + make_dt_interval(0, cast(floor(value) as int), 0, 0)").alias("expires"))
    return e.where("expires > TIMESTAMP_NTZ '2024-01-30 00:00:00'").groupBy("user_id").agg(F.count("*").alias("live"), F.max("expires").alias("last"))


@_query(
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id FROM events),
    n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
    SELECT user_id, min(ts) AS first, max(ts) AS last, CAST(count(*) AS BIGINT) AS visits FROM n GROUP BY user_id, s"""
)
def visit_sessions(spark, d):
    """Visits of a user less than six hours apart, in batch."""
    return V.sessions(table(spark, d, "events"))


@_query(
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id FROM events),
    n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e),
    w AS (SELECT user_id, min(ts) AS first, max(ts) AS last, CAST(count(*) AS BIGINT) AS visits FROM n GROUP BY user_id, s)
    SELECT * FROM w WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"""
)
def streamed_sessions(spark, d):
    """Sessions by a stream: those that are over by the watermark."""
    return V.session_stream(spark, f"{d}/events.parquet")


@_query("SELECT date_trunc('day', ts) AS day, event_type, CAST(count(*) AS BIGINT) AS visits FROM events GROUP BY ALL")
def streamed_daily_visits(spark, d):
    """Daily counts by a stream with a watermark, read to its end."""
    return V.daily_stream(spark, f"{d}/events.parquet")


@_query("SELECT user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, max(ts) AS last, CAST(count(*) AS BIGINT) AS visits FROM events GROUP BY ALL")
def streamed_history(spark, d):
    """The latest visit of every target of a user, upserted by a stream."""
    return V.history_stream(spark, f"{d}/events.parquet")


@_query("SELECT DISTINCT item_id, profile_id, kind, target FROM items")
def streamed_unique_items(spark, d):
    """Items once, duplicates dropped within the watermark of their delivery."""
    return V.unique_stream(spark, f"{d}/items.parquet")


@_query(f"SELECT kind, target, coalesce(title, '') AS title, coalesce(time_s, 0.0) AS time FROM {_I} WHERE list_name = 'bookmarks' AND target <> ''")
def saved_bookmarks(spark, d):
    """Bookmarks saved as JSON and read again."""
    marks = _items(spark, d).where("list_name = 'bookmarks'").select("kind", "target", "title", F.col("time_s").alias("time"))
    path = stage_path(spark, "bookmarks")
    marks.write.mode("overwrite").json(path)
    lines = spark.read.schema("kind string, target string, title string, time double").json(path)
    return lines.select("kind", "target", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("time", F.lit(0.0)).alias("time")).where("target <> ''")


@_query("SELECT user_id, event_type AS mark, CAST(arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS BIGINT) AS target FROM events GROUP BY ALL")
def marks(spark, d):
    """The last target set for each mark of a user."""
    return _events(spark, d).groupBy("user_id", F.col("event_type").alias("mark")).agg(F.max_by("k", F.struct("ts", "event_id")).alias("target"))


@_query(f"SELECT h.item_id FROM {_I} h WHERE list_name = 'history' AND NOT EXISTS (SELECT 1 FROM {_I} b WHERE b.list_name = 'bookmarks' AND b.kind IS NOT DISTINCT FROM h.kind AND b.target IS NOT DISTINCT FROM h.target)")
def items_removed(spark, d):
    """History after the items whose kind and target some bookmark has are removed."""
    i = _items(spark, d)
    return S.without(i.where("list_name = 'history'"), i.where("list_name = 'bookmarks'"), ["kind", "target"]).select("item_id")


@_query(f"WITH k AS (SELECT min(target) AS target FROM {_I} WHERE kind = 'search') SELECT profile_id, item_id, title FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY time_s DESC, item_id DESC) AS r FROM {_I} WHERE kind = 'search' AND target = (SELECT target FROM k)) WHERE r = 1")
def items_found(spark, d):
    """Each profile's newest item of one key (here the first of all searches)."""
    i = _items(spark, d)
    key = i.where("kind = 'search'").agg(F.min("target")).first()[0]
    return S.find(i, "profile_id", "search", key or "").select("profile_id", "item_id", "title")


@_query(
    """WITH t AS (SELECT DISTINCT item_id, target, synced_at FROM items WHERE kind = 'url' AND target IS NOT NULL),
    k AS (SELECT *, string_split(target, '#')[1] AS bare FROM t), q AS (SELECT *, string_split(bare, '?')[1] AS path FROM k),
    n AS (SELECT item_id, synced_at, path || '?' || array_to_string(list_sort(list_filter(string_split(substr(bare, length(path) + 2), '&'), lambda x: x <> '')), '&') AS key FROM q)
    SELECT key, arg_max(item_id, (synced_at, item_id)) AS item_id, CAST(count(DISTINCT item_id) AS BIGINT) AS requests FROM n GROUP BY key"""
)
def search_cache(spark, d):
    """The newest item of every address whose parameters are the same in any order."""
    i = table(spark, d, "items").where("kind = 'url' AND target IS NOT NULL").select("item_id", "target", "synced_at")
    bare = F.substring_index("target", "#", 1)
    path = F.substring_index(bare, "?", 1)
    fields = F.array_sort(F.filter(F.split(F.substring(bare, F.length(path) + 2, F.length(bare)), "&"), lambda x: x != ""))
    key = F.concat(path, F.lit("?"), F.array_join(fields, "&"))
    return i.groupBy(key.alias("key")).agg(F.max_by("item_id", F.struct("synced_at", "item_id")).alias("item_id"), F.countDistinct("item_id").alias("requests"))

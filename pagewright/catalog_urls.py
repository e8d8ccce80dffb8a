"""Queries on addresses, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# fragments of SQL: an address taken apart as in functions.urls
_CLEAN = r"regexp_replace(regexp_replace({u}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"


def _part(u: str, n: int) -> str:
    return f"regexp_extract({_CLEAN.format(u=u)}, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', {n})"


def _scheme(u: str) -> str:
    return f"lower({_part(u, 1)})"


def _host(u: str) -> str:
    return f"lower(regexp_extract(regexp_replace({_part(u, 2)}, '^.*@', ''), '^(\\[[^\\]]*\\]|[^:]*)', 1))"


def _port(u: str) -> str:
    e = f"regexp_extract({_part(u, 2)}, ':([0-9]+)$', 1)"
    return f"CAST(CASE WHEN {e} <> '' THEN CAST({e} AS BIGINT) WHEN {_scheme(u)} = 'http' THEN 80 ELSE 443 END AS BIGINT)"


def _authority(u: str) -> str:
    return f"lower(regexp_replace({_part(u, 2)}, '^.*@', ''))"


def _site(h: str) -> str:
    cut = lambda n: f"array_to_string(list_slice(string_split({h}, '.'), -{n}, -1), '.')"
    return f"CASE WHEN regexp_matches({h}, '\\.(?:co|ne|or|ac|go|com|net|org|gov|edu)\\.[a-z]{{2}}$') THEN {cut(3)} ELSE {cut(2)} END"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Each page's address once, with null addresses left out."""
    return table(spark, d, "page_docs", "page_id bigint, url string").where("url IS NOT NULL").distinct()


_P = "(SELECT DISTINCT page_id, url FROM page_docs WHERE url IS NOT NULL)"


@_query(f"SELECT page_id, {_scheme('url')} AS scheme, {_part('url', 2)} AS netloc, {_part('url', 3)} AS path, {_part('url', 4)} AS query, {_part('url', 5)} AS fragment FROM {_P}")
def url_parts(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.scheme(u).alias("scheme"), U.netloc(u).alias("netloc"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"))


@_query(f"SELECT page_id, {_host('url')} AS host, {_port('url')} AS port FROM {_P}")
def url_host_port(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.host(u).alias("host"), U.port(u).cast("bigint").alias("port"))


_Q = "string_split(url, '#')[1]"
_TRACK = "(starts_with(string_split(x, '=')[1], 'utm_') OR list_contains([" + ", ".join(f"'{p}'" for p in U.TRACKING_PARAMETERS) + "], string_split(x, '=')[1]))"


@_query(
    f"""SELECT doc_id, CASE WHEN instr(base, '?') = 0 THEN url ELSE string_split(base, '?')[1] || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || substr(url, length(base) + 1) END AS clean_url
    FROM (SELECT *, array_to_string(list_filter(string_split(substr(base, length(string_split(base, '?')[1]) + 2), '&'), lambda x: x <> '' AND NOT {_TRACK}), '&') AS kept
          FROM (SELECT doc_id, url, {_Q} AS base FROM documents WHERE url IS NOT NULL))"""
)
def url_tracker_clean(spark, d):
    return table(spark, d, "documents").where("url IS NOT NULL").select("doc_id", U.without_trackers(F.col("url")).alias("clean_url"))


@_query(
    f"""WITH p AS (SELECT item_id, string_split({_part('target', 4)}, '&') AS l FROM (SELECT DISTINCT item_id, target FROM items WHERE kind = 'url')),
    e AS (SELECT item_id, unnest(range(len(l))) AS n, unnest(l) AS kv FROM p),
    s AS (SELECT item_id, n, url_decode(replace(string_split(kv, '=')[1], '+', ' ')) AS name, url_decode(replace(CASE WHEN instr(kv, '=') > 0 THEN substr(kv, instr(kv, '=') + 1) ELSE '' END, '+', ' ')) AS value FROM e WHERE kv <> ''),
    f AS (SELECT *, row_number() OVER (PARTITION BY item_id, name ORDER BY n) AS r FROM s WHERE value <> '')
    SELECT item_id, name, value FROM f WHERE r = 1"""
)
def url_query_params(spark, d):
    """The first value of each parameter of an item's address."""
    items = table(spark, d, "items").where("kind = 'url'").select("item_id", "target").distinct()
    e = items.select("item_id", F.posexplode(U.query_pairs(F.col("target"))).alias("n", "p"))
    return e.groupBy("item_id", F.col("p.k").alias("name")).agg(F.min_by("p.v", "n").alias("value"))


@_query(f"SELECT item_id, [title, CAST(item_id AS VARCHAR)] AS values FROM (SELECT DISTINCT item_id, title FROM items WHERE title <> '')")
def form_params(spark, d):
    """The first values of an address with a form's fields: titles quoted into it come out as they were, later ones of a name don't."""
    items = table(spark, d, "items").where("title <> ''").select("item_id", "title").distinct()
    url = F.concat(F.lit("https://find.example/a?q="), U.quote_plus(F.col("title")), F.lit("&_seen=&q=2&%6E="), F.col("item_id"), F.lit("&n"))
    first = U.first_values(U.query_pairs(url))
    return items.withColumn("p", first).select("item_id", F.transform("p", lambda p: p["v"]).alias("values"))


_ABOVE = f"regexp_replace(regexp_replace({_part('url', 3)}, '/+$', ''), '[^/]*$', '')"


@_query(f"SELECT page_id, {_scheme('url')} || '://' || {_part('url', 2)} || CASE WHEN {_ABOVE} = '' THEN '/' ELSE {_ABOVE} END AS parent, {_scheme('url')} || '://' || {_part('url', 2)} || '/' AS root FROM {_P}")
def url_parent_root(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.parent(u).alias("parent"), U.site_root(u).alias("root"))


@_query(
    f"""SELECT page_id, CASE WHEN s <> '' THEN s || ':' ELSE '' END || CASE WHEN n <> '' THEN '//' || n ELSE '' END || CASE WHEN n <> '' AND p <> '' AND NOT starts_with(p, '/') THEN '/' ELSE '' END || p
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END || CASE WHEN f <> '' THEN '#' || f ELSE '' END AS url
    FROM (SELECT page_id, {_scheme('url')} AS s, {_part('url', 2)} AS n, {_part('url', 3)} AS p, {_part('url', 4)} AS q, {_part('url', 5)} AS f FROM {_P})"""
)
def url_unsplit(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.unsplit(U.scheme(u), U.netloc(u), U.path(u), U.query(u), U.fragment(u)).alias("url"))


@_query(f"SELECT page_id, string_split(url, '#')[1] AS url, {_scheme('url')} = 'https' OR ends_with({_host('url')}, '.onion') AS allowed, CASE WHEN {_scheme('url')} = 'http' AND NOT ends_with({_host('url')}, '.onion') THEN regexp_replace({_CLEAN.format(u='url')}, '^[hH][tT][tT][pP]:', 'https:') ELSE url END AS upgraded FROM {_P}")
def url_private_policy(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.defragmented(u).alias("url"), U.private_allowed(u).alias("allowed"), U.private_upgrade(u).alias("upgraded"))


def _links(spark, d):
    pages = table(spark, d, "page_docs", "page_id bigint, url string, links array<string>").where("url IS NOT NULL")
    return pages.select("page_id", "url", F.posexplode("links").alias("link_no", "link")).dropDuplicates(["page_id", "link_no"])


_L = "(SELECT DISTINCT page_id, url, unnest(range(len(links))) AS link_no, unnest(links) AS link FROM page_docs WHERE url IS NOT NULL)"
_SAME = f"{_scheme('url')} = {_scheme('link')} AND {_authority('url')} = {_authority('link')}"


@_query(f"SELECT page_id, CAST(link_no AS BIGINT) AS link_no, CASE WHEN {_SAME} THEN 'same-origin' WHEN {_scheme('url')} = {_scheme('link')} AND {_site(_host('url'))} = {_site(_host('link'))} THEN 'same-site' ELSE 'cross-site' END AS relation FROM {_L}")
def url_site_relation(spark, d):
    return _links(spark, d).select("page_id", F.col("link_no").cast("bigint"), U.site_relation(F.col("url"), F.col("link")).alias("relation"))


_ORIGIN = f"{_scheme('url')} || '://' || {_authority('url')}"


@_query(
    f"""SELECT page_id, CAST(link_no AS BIGINT) AS link_no, CASE WHEN {_scheme('url')} NOT IN ('http', 'https') OR {_scheme('url')} = 'https' AND {_scheme('link')} <> 'https' THEN NULL
    WHEN {_SAME} THEN {_ORIGIN} || {_part('url', 3)} || CASE WHEN {_part('url', 4)} <> '' THEN '?' || {_part('url', 4)} ELSE '' END ELSE {_ORIGIN} || '/' END AS referer FROM {_L}"""
)
def url_referer(spark, d):
    return _links(spark, d).select("page_id", F.col("link_no").cast("bigint"), U.referer(F.col("url"), F.col("link")).alias("referer"))


@_query(f"SELECT page_id, CAST(link_no AS BIGINT) AS link_no, link AS url, CASE WHEN link_no % 4 = 3 THEN 'https://other.example/l/?uddg=' || url_encode(link) ELSE link END AS unwrapped FROM {_L}")
def redirect_unwrap(spark, d):
    """Links as they are, and each of them wrapped: with a scheme, without one, on the hidden host, and on a host that leads nowhere."""
    link, target = F.col("link"), F.concat(F.lit("uddg="), F.url_encode("link"))
    hosts = F.array(F.lit("https://duckduckgo.com/l/?a=1&"), F.lit("//html.duckduckgo.com/l/x?"), F.lit(f"http://{U.REDIRECT_ONION}/l/?"), F.lit("https://other.example/l/?"))
    wrapped = F.concat(F.get(hosts, F.col("link_no") % 4), target)
    return _links(spark, d).select("page_id", F.col("link_no").cast("bigint"), U.redirect_target(link).alias("url"), U.redirect_target(wrapped).alias("unwrapped"))


_I = "(SELECT DISTINCT item_id, target FROM items WHERE target IS NOT NULL)"


def _targets(spark, d):
    return table(spark, d, "items").where("target IS NOT NULL").select("item_id", "target").distinct()


_LOOKS = r"(regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\-]*://') OR (instr(target, ' ') = 0 AND NOT regexp_matches(target, '[^\x00-\x7F]') AND instr(regexp_replace(target, '^\.+|\.+$', '', 'g'), '.') > 0))"


@_query(f"SELECT item_id, {_LOOKS} AS is_url, CASE WHEN NOT {_LOOKS} THEN NULL WHEN instr(target, '://') > 0 THEN target ELSE 'https://' || target END AS url FROM {_I}")
def input_dispatch(spark, d):
    """Typed text as an address or as words to search for."""
    t = F.col("target")
    return _targets(spark, d).select("item_id", U.looks_like_url(t).alias("is_url"), F.when(U.looks_like_url(t), U.to_url(t)).alias("url"))


@_query(f"SELECT item_id, replace(url_encode(target), '%20', '+') AS quoted FROM {_I}")
def url_quote_plus(spark, d):
    return _targets(spark, d).select("item_id", U.quote_plus(F.col("target")).alias("quoted"))


@_query("SELECT doc_id, text, text AS again, '100% ' || text AS stray FROM documents WHERE text IS NOT NULL")
def url_unquote_roundtrip(spark, d):
    """Texts quoted and unquoted again, also behind a percent sign that begins no escape."""
    texts = table(spark, d, "documents", "doc_id bigint, text string").where("text IS NOT NULL")
    quoted = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return texts.select("doc_id", "text", U.unquote(quoted).alias("again"), U.unquote(F.concat(F.lit("100% "), quoted)).alias("stray"))


_LAST = "regexp_extract(regexp_replace({c}, '/+$', ''), '[^/]*$')"


@_query(
    f"""SELECT doc_id, coalesce(nullif({_LAST.format(c=_part('url', 3))}, ''), 'download') AS file_name, coalesce(nullif({_LAST.format(c=_part('url', 3))}, ''), 'download') AS of_folder, coalesce(source, 'x') || ' & ' || doc_id || '.txt' AS quoted
    FROM documents WHERE url IS NOT NULL"""
)
def download_names(spark, d):
    """The names that addresses give: of a page, of the same as a folder, and with escapes."""
    docs = table(spark, d, "documents").where("url IS NOT NULL")
    bare = F.regexp_replace(F.substring_index(F.substring_index("url", "#", 1), "?", 1), "/*$", "")
    name = F.concat(F.coalesce("source", F.lit("x")), F.lit(" & "), F.col("doc_id"), F.lit(".txt"))
    quoted = F.concat(F.lit("https://a.example/x/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("?q=/y"))
    return docs.select("doc_id", U.file_name(F.col("url")).alias("file_name"), U.file_name(F.concat(bare, F.lit("//"))).alias("of_folder"), U.file_name(quoted).alias("quoted"))


@_query(
    f"""SELECT page_id, coalesce(nullif({_LAST.format(c='title')}, ''), 'download') AS extended, coalesce(nullif({_LAST.format(c='title')}, ''), 'download') AS plain, 'download' AS none
    FROM (SELECT DISTINCT page_id, title FROM page_docs WHERE title IS NOT NULL AND trim(title) = title AND NOT regexp_matches(title, '[\x00-\x1F]'))"""
)
def disposition_names(spark, d):
    """The names that a Content-Disposition gives: escaped, quoted, and none."""
    p = table(spark, d, "page_docs", "page_id bigint, title string").where("title IS NOT NULL").distinct()
    p = p.where((F.trim("title") == F.col("title")) & ~F.col("title").rlike(r"[\x00-\x1F]"))
    url = F.lit("https://a.example/")
    extended = F.concat(F.lit("attachment; filename*=UTF-8''"), F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20")))
    inner = F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = F.concat(F.lit('attachment; size=3; filename="'), inner, F.lit('"; filename*=UTF-8\'\'other'))
    return p.select("page_id", U.download_name(url, extended).alias("extended"), U.download_name(url, plain).alias("plain"), U.download_name(url, F.lit("inline")).alias("none"))


_FOLDER = f"regexp_replace({_part('url', 3)}, '[^/]*$', '')"
_FRONT = f"{_scheme('url')} || '://' || {_part('url', 2)}"


@_query(
    f"""SELECT page_id, CAST(link_no AS BIGINT) AS link_no, CASE link_no % 5 WHEN 0 THEN {_FRONT} || coalesce(nullif(regexp_replace({_FOLDER}, '[^/]*/$', ''), ''), '/') || 'd' WHEN 1 THEN {_FRONT} || {_part('url', 3)} || '?y=2'
    WHEN 2 THEN {_FRONT} || {_part('url', 3)} || CASE WHEN {_part('url', 4)} <> '' THEN '?' || {_part('url', 4)} ELSE '' END || '#top' WHEN 3 THEN {_scheme('url')} || '://other.example/x' ELSE link END AS resolved FROM {_L}"""
)
def url_join(spark, d):
    """Links resolved against their page."""
    ref = F.element_at(F.array(F.lit("../d"), F.lit("?y=2"), F.lit("#top"), F.lit("//other.example/x"), F.col("link")), F.col("link_no") % 5 + 1)
    return _links(spark, d).select("page_id", F.col("link_no").cast("bigint"), U.url_join(F.col("url"), ref).alias("resolved"))


@_query(f"SELECT page_id, CAST(link_no AS BIGINT) AS link_no FROM {_L} WHERE link_no % 3 < 2 OR string_split(url, '#')[1] = string_split(link, '#')[1]")
def same_page_links(spark, d):
    """Links that stay on their page: of the page's address with an anchor, the same with its path escaped, and the links themselves."""
    url, n = F.col("url"), F.col("link_no") % 3
    escaped = F.concat(F.regexp_replace(F.replace(U.defragmented(url), F.lit("e"), F.lit("%65")), "^https://", "https://"), F.lit("#part"))
    ref = F.when(n == 0, F.concat(U.defragmented(url), F.lit("#part"))).when(n == 1, escaped).otherwise(F.col("link"))
    own = U.unquote(U.defragmented(url)) == U.unquote(U.defragmented(ref))
    return _links(spark, d).where(own).select("page_id", F.col("link_no").cast("bigint"))


@_query(
    f"""WITH dom AS (SELECT host FROM sites WHERE lang <> 'en'), l AS (SELECT page_id, link_no, {_host('link')} AS h FROM {_L}),
    hit AS (SELECT DISTINCT page_id, link_no FROM l JOIN dom ON l.h = dom.host OR ends_with(l.h, '.' || dom.host))
    SELECT page_id, CAST(count(*) AS BIGINT) AS links, CAST(count(hit.link_no) AS BIGINT) AS listed FROM l LEFT JOIN hit USING (page_id, link_no) GROUP BY page_id"""
)
def listed_domain_links(spark, d):
    """Links to hosts of a domain list or their subdomains (here the hosts of one half of the sites), by an equi join on
    host suffixes. The list is a fixed table, broadcast by Catalyst if its size allows."""
    listed = table(spark, d, "sites").where("lang <> 'en'").select(F.col("host").alias("suffix"))
    links = _links(spark, d)
    hits = links.select("page_id", "link_no", F.explode(U.host_suffixes(U.host(F.col("link")))).alias("suffix")).join(listed, "suffix").select("page_id", "link_no").distinct().withColumn("hit", F.lit(1))
    return links.join(hits, ["page_id", "link_no"], "left").groupBy("page_id").agg(F.count("*").alias("links"), F.count("hit").alias("listed"))


@_query(f"SELECT page_id, CAST(link_no AS BIGINT) AS link_no FROM {_L} WHERE link_no % 3 < 2")
def ad_links(spark, d):
    """Links to advertising and affiliate services: each link led through one of them, through a subdomain of one, and through
    a host that only begins like one."""
    hosts = F.array(*map(F.lit, U.AD_DOMAINS))
    service = F.element_at(hosts, (F.pmod("page_id", F.size(hosts)) + 1).cast("int"))
    way = F.get(F.array(F.lit("https://"), F.lit("http://Eu.cdn."), F.lit("https://")), F.col("link_no") % 3)
    link = F.concat(way, service, F.when(F.col("link_no") % 3 == 2, ".example").otherwise(""), F.lit("/go?to="), F.url_encode("link"))
    return _links(spark, d).where(F.arrays_overlap(U.host_suffixes(U.host(link)), hosts)).select("page_id", F.col("link_no").cast("bigint"))

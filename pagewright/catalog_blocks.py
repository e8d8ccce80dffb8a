"""Queries on the blocks of pages, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.functions import urls as U
from pagewright.operators import blocks as B
from pagewright.operators import markdown as M
from pagewright.operators import selection as S
from pagewright.plans.stages import once
from pagewright.sources.tables import FULL_BLOCKS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAGE = f"page_id bigint, url string, title string, {FULL_BLOCKS}, links array<string>"


def _pages(spark, d, schema: str = PAGE) -> DataFrame:
    return table(spark, d, "page_docs", schema)


def _blocks(spark, d, *more: str) -> DataFrame:
    return B.page_blocks(_pages(spark, d), *more)


# ---- fragments of SQL -------------------------------------------------------------------------------------------

_JOINED = "array_to_string(list_transform({s}, lambda s: coalesce(s.text, '')), '')"
_TEXT = f"coalesce(CASE WHEN b.cell_rows IS NOT NULL THEN array_to_string(list_transform(b.cell_rows, lambda r: array_to_string(list_transform(r, lambda c: {_JOINED.format(s='c')}), ' ')), ' / ') END, {_JOINED.format(s='b.spans')}, '')"
BLOCKS = f"""d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ingested_at) AS nth FROM page_docs) WHERE nth = 1),
    b0 AS (SELECT page_id, title, links, unnest(range(len(blocks))) AS pos, unnest(blocks) AS b FROM d),
    blk AS (SELECT page_id, title, links, CAST(pos AS BIGINT) AS pos, b.kind AS kind, CAST(coalesce(b.level, 0) AS BIGINT) AS level, coalesce(b.marker, '') AS marker, b.spans AS spans, b.cell_rows AS rws, {_TEXT} AS text FROM b0)"""
#: Unicode blanks and information separators; letters and digits with the vowel signs of Thai.
_SP = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _solid(t: str) -> str:
    return f"length(regexp_replace({t}, '{_SP}', '', 'g'))"


def _norm(t: str) -> str:
    return "replace(lower(regexp_replace(" + t + r", '[^\p{L}\p{N}\x{E31}\x{E34}-\x{E3A}\x{E4D}\x{24B6}-\x{24E9}]', '', 'g')), 'ς', 'σ')"


def _strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{_SP}+', ''), '{_SP}+$', '')"


_SPEAK = _strip("regexp_replace(array_to_string(list_transform(list_filter(spans, lambda s: NOT coalesce(s.image, false)), lambda s: coalesce(s.text, '')), ''), 'https?://\\S+', '', 'g')")
_LINKED = "coalesce(list_sum(list_transform(list_filter(spans, lambda s: s.link IS NOT NULL{x}), lambda s: length(coalesce(s.text, '')))), 0)"
_KIND_BODY = "kind IN ('h', 'p', 'li', 'quote')"


@_query(f"WITH {BLOCKS} SELECT page_id, pos, kind, level, marker, text, len(list_filter(spans, lambda s: s.image)) > 0 AND len(list_filter(spans, lambda s: NOT (s.image OR {_solid('s.text')} = 0))) = 0 AS image_only FROM blk")
def block_texts(spark, d):
    """Every block's text, and whether it is a picture only."""
    return _blocks(spark, d).select("page_id", F.col("pos").cast("bigint"), "kind", F.col("level").cast("bigint"), "marker", "text", B.image_only(F.col("spans")).alias("image_only"))


@_query(f"WITH {BLOCKS} SELECT page_id, pos, {_norm('text')} AS norm FROM blk")
def block_norms(spark, d):
    return _blocks(spark, d).select("page_id", F.col("pos").cast("bigint"), X.norm(F.col("text")).alias("norm"))


@_query(f"WITH {BLOCKS} SELECT page_id, CAST(sum({_solid('text')}) AS BIGINT) AS chars, CAST(count(*) AS BIGINT) AS blocks FROM blk GROUP BY page_id")
def page_text_length(spark, d):
    b = _blocks(spark, d)
    return b.groupBy("page_id").agg(F.sum(X.solid_length(F.col("text"))).cast("bigint").alias("chars"), F.count("*").alias("blocks"))


@_query(f"WITH {BLOCKS} SELECT page_id, pos, CAST({_LINKED.format(x='')} AS BIGINT) AS linked, CAST(length(text) AS BIGINT) AS chars FROM blk")
def link_density(spark, d):
    """Linked characters and all characters of each block."""
    return _blocks(spark, d).select("page_id", F.col("pos").cast("bigint"), B.linked_chars(F.col("spans")).cast("bigint").alias("linked"), F.length("text").cast("bigint").alias("chars"))


_PARTS = f"list_filter(list_transform(list_concat([coalesce(title, '')], regexp_split_to_array(coalesce(title, ''), '\\s+[|｜\\-–—:：]\\s+|[|｜]')), lambda p: {_norm('p')}), lambda p: length(p) >= 4)"


@_query(
    f"""WITH {BLOCKS}, n AS (SELECT page_id, pos, kind, level, {_norm('text')} AS norm, {_PARTS} AS parts FROM blk),
    h AS (SELECT *, pos < 10 AND list_contains(parts, norm) AS hit FROM n),
    c AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY page_id) AS hits, min(CASE WHEN hit AND kind = 'h' THEN level * 100000 + pos END) OVER (PARTITION BY page_id) AS best FROM h),
    k AS (SELECT * FROM c WHERE NOT hit OR hits < 2 OR (kind = 'h' AND level * 100000 + pos = best)),
    l AS (SELECT *, lag(norm) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM k)
    SELECT page_id, pos FROM l WHERE before IS NULL OR norm = '' OR norm <> before"""
)
def title_and_neighbour_dedupe(spark, d):
    """Blocks left after repeats of the title and equal neighbours are gone."""
    return B.dedupe(_blocks(spark, d, "title")).select("page_id", F.col("pos").cast("bigint"))


@_query(
    """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ingested_at) AS nth FROM page_docs) WHERE nth = 1),
    u AS (SELECT page_id, links, list_filter(flatten(list_transform(blocks, lambda b: list_concat(list_transform(coalesce(b.spans, []), lambda s: s.link), coalesce(list_transform(flatten(flatten(b.cell_rows)), lambda s: s.link), [])))), lambda x: x IS NOT NULL) AS l FROM d),
    o AS (SELECT page_id, links, unnest(range(len(l))) AS n, unnest(l) AS old FROM u),
    f AS (SELECT page_id, any_value(links) AS links, old, min(n) AS n FROM o GROUP BY page_id, old)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS link_no, links[old + 1] AS url FROM f"""
)
def links_renumbered(spark, d):
    return B.renumbered_links(_pages(spark, d)).select("page_id", F.col("link_no").cast("bigint"), "url")


@_query(
    f"""WITH {BLOCKS}, s AS (SELECT page_id, pos, kind, spans, {_SPEAK} AS speak FROM blk)
    SELECT page_id, pos, speak FROM s WHERE {_KIND_BODY} AND regexp_matches(speak, '\\p{{L}}') AND NOT regexp_matches(speak, '[>›»/|]\\s*$')
    AND (kind = 'h' OR {_LINKED.format(x=' AND NOT coalesce(s.image, false)')} / greatest(length(speak), 1) < 0.5)"""
)
def speakable_blocks(spark, d):
    """Blocks that are read aloud, with what is read."""
    b = _blocks(spark, d).withColumn("speak", X.speakable(F.col("spans")))
    return b.where(B.is_body(F.col("kind"), F.col("spans"), F.col("speak"))).select("page_id", F.col("pos").cast("bigint"), "speak")


_END = r"""[。！？!?．.…][」』）)"'”’]*$"""


@_query(
    f"""WITH {BLOCKS}, s AS (SELECT page_id, pos, kind, {_SPEAK} AS speak FROM blk WHERE {_KIND_BODY}),
    l AS (SELECT page_id, pos, kind, unnest(range(len(string_split(speak, chr(10))))) AS line_no, {_strip("unnest(string_split(speak, chr(10)))")} AS line FROM s WHERE speak <> '')
    SELECT page_id, pos, CAST(line_no AS BIGINT) AS line_no, kind = 'h' OR NOT regexp_matches(line, '{_END.replace("'", "''")}') AS label FROM l WHERE line <> ''"""
)
def label_lines(spark, d):
    """Lines that are headings or no sentences."""
    b = _blocks(spark, d).where("kind IN ('h', 'p', 'li', 'quote')").withColumn("speak", X.speakable(F.col("spans"))).where("speak <> ''")
    lines = b.select("page_id", "pos", "kind", F.posexplode(F.split("speak", "\n")).alias("line_no", "line")).withColumn("line", X.strip(F.col("line"))).where("line <> ''")
    return lines.select("page_id", F.col("pos").cast("bigint"), F.col("line_no").cast("bigint"), ((F.col("kind") == "h") | ~F.col("line").rlike(_END)).alias("label"))


_TAIL = X.TAIL_SECTION


@_query(
    f"""WITH {BLOCKS}, t AS (SELECT page_id, pos, kind, level, kind = 'h' AND regexp_matches(text, '{_TAIL}') AS tail FROM blk),
    o AS (SELECT a.page_id, a.pos, coalesce(min(b.pos), 1000000) AS stop FROM t a LEFT JOIN t b ON a.page_id = b.page_id AND b.kind = 'h' AND b.pos > a.pos AND b.level <= a.level WHERE a.tail AND a.level BETWEEN 1 AND 6 GROUP BY ALL)
    SELECT t.page_id, t.pos FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = t.page_id AND t.pos >= o.pos AND t.pos < o.stop)"""
)
def section_scope(spark, d):
    """Blocks outside the closing sections of a page."""
    return B.sections(_blocks(spark, d)).where(~F.col("in_tail")).select("page_id", F.col("pos").cast("bigint"))


@_query(
    f"""WITH {BLOCKS}, s AS (SELECT page_id, array_to_string(list_transform(list_filter(spans, lambda s: s.link IS NULL AND NOT coalesce(s.image, false)), lambda s: coalesce(s.text, '')), '') AS t FROM blk WHERE kind IN ('p', 'li', 'quote'))
    SELECT page_id, CAST(sum(len(regexp_extract_all(t, '{X.SENTENCE}'))) AS BIGINT) AS sentences, CAST(sum(coalesce(length(array_to_string(regexp_extract_all(t, '{X.SENTENCE}'), '')), 0)) AS BIGINT) AS chars FROM s GROUP BY page_id"""
)
def prose_sentences(spark, d):
    """Sentences outside links and pictures, by hard stops, and their characters."""
    spans = F.filter("spans", lambda s: s["link"].isNull() & ~F.coalesce(s["image"], F.lit(False)))
    b = _blocks(spark, d).where("kind IN ('p', 'li', 'quote')").withColumn("s", X.prose_sentences(B.joined(spans)))
    return b.groupBy("page_id").agg(F.sum(F.size("s")).cast("bigint").alias("sentences"), F.sum(F.length(F.array_join("s", ""))).cast("bigint").alias("chars"))


def _reference(b: DataFrame) -> DataFrame:
    """A page's reference text: its paragraphs without links, normalised; of 50 characters at least."""
    ref = b.where((F.col("kind") == "p") & (B.linked_chars(F.col("spans")) == 0)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("l"))
    return ref.select("page_id", F.array_join(F.transform("l", lambda x: x["norm"]), "").alias("ref")).where(F.length("ref") >= 50)


_REF = f"""n AS (SELECT page_id, pos, kind, spans, {_norm('text')} AS norm FROM blk),
    r AS (SELECT page_id, string_agg(norm, '' ORDER BY pos) AS ref FROM n WHERE kind = 'p' AND {_LINKED.format(x='')} = 0 GROUP BY page_id HAVING length(string_agg(norm, '')) >= 50),
    k AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, length(ref) - 2), lambda i: substr(ref, i, 4))) AS s FROM r),
    e AS (SELECT page_id, pos, unnest(list_transform(range(1, length(norm) - 2), lambda i: substr(norm, i, 4))) AS s FROM n WHERE length(norm) >= 4),
    c AS (SELECT e.page_id, e.pos, CAST(count(*) AS BIGINT) AS shingles, CAST(count(k.s) AS BIGINT) AS matched FROM e LEFT JOIN k ON e.page_id = k.page_id AND e.s = k.s GROUP BY ALL)"""


@_query(f"WITH {BLOCKS}, {_REF} SELECT page_id, pos, shingles, matched FROM c")
def shingle_coverage(spark, d):
    """How much of each block is covered by its page's reference text, in runs of four characters."""
    covered = _normed(spark, d).select("page_id", F.posexplode(B.page_coverage("norms", "chosen")).alias("pos", "c"))
    return covered.where("c.shingles > 0").select("page_id", F.col("pos").cast("bigint"), "c.shingles", "c.matched")


def _normed(spark, d) -> DataFrame:
    """(page_id, norms, chosen): the normalised texts of each page's blocks, and which make its reference text."""
    pages = once(table(spark, d, "page_docs", "page_id bigint, blocks array<struct<kind:string,spans:array<struct<text:string,link:int>>,cell_rows:array<array<array<struct<text:string>>>>>>"), "page_id")
    norms = F.transform("blocks", lambda b: X.norm(B.block_text(b["spans"], b["cell_rows"])))
    chosen = F.transform("blocks", lambda b: (b["kind"] == "p") & (F.coalesce(F.size(F.filter(b["spans"], lambda s: s["link"].isNotNull() & (F.length(F.coalesce(s["text"], F.lit(""))) > 0))), F.lit(0)) <= 0))
    return pages.select("page_id", norms.alias("norms"), chosen.alias("chosen"))


_RUN = """p AS (SELECT page_id, pos, weight, sum(weight) OVER (PARTITION BY page_id ORDER BY pos) AS p FROM w),
    q AS (SELECT *, p - weight AS q FROM p),
    m AS (SELECT *, min(q) OVER (PARTITION BY page_id ORDER BY pos) AS low FROM q),
    x AS (SELECT page_id, max(p - low) AS best FROM m GROUP BY page_id),
    z AS (SELECT m.page_id, min(m.pos) AS last FROM m JOIN x USING (page_id) WHERE m.p - m.low = x.best AND x.best > 0 GROUP BY m.page_id)"""


@_query(
    f"""WITH {BLOCKS}, {_REF}, w AS (SELECT n.page_id, n.pos, CASE WHEN c.shingles IS NULL THEN 0 WHEN c.matched * 2 >= c.shingles THEN length(norm) ELSE -length(norm) END AS weight FROM n LEFT JOIN c USING (page_id, pos)),
    {_RUN}
    SELECT z.page_id, (SELECT max(a.pos) FROM m a WHERE a.page_id = z.page_id AND a.pos <= z.last AND a.q = (SELECT b.low FROM m b WHERE b.page_id = z.page_id AND b.pos = z.last)) AS "first", z.last AS "last", CAST(x.best AS BIGINT) AS best FROM z JOIN x USING (page_id)"""
)
def max_weight_run(spark, d):
    """The contiguous run of blocks that the reference text covers best."""
    return _normed(spark, d).select("page_id", B.page_run("norms", "chosen").alias("r")).where("r IS NOT NULL").select("page_id", "r.first", "r.last", "r.best")


_GROUPS = """sp AS (SELECT page_id, pos, unnest(range(len(spans))) AS n, unnest(spans) AS s FROM blk),
    sy AS (SELECT page_id, pos, n, coalesce(s.text, '') AS t, concat_ws('|', coalesce(s.link, -1), coalesce(s.bold, false), coalesce(s.code, false), coalesce(s.image, false), coalesce(s.italic, false), coalesce(s.strike, false), coalesce(s.minor, false), coalesce(s.translated, false), coalesce(s.src, '')) AS style FROM sp),
    sz AS (SELECT *, CASE WHEN lag(style) OVER w IS DISTINCT FROM style THEN 1 ELSE 0 END AS new FROM sy WINDOW w AS (PARTITION BY page_id, pos ORDER BY n)),
    sg AS (SELECT *, sum(new) OVER (PARTITION BY page_id, pos ORDER BY n) - 1 AS group_no FROM sz),
    grp AS (SELECT page_id, pos, CAST(group_no AS BIGINT) AS group_no, string_agg(t, '' ORDER BY n) AS text FROM sg GROUP BY page_id, pos, group_no)"""


@_query(f"WITH {BLOCKS}, {_GROUPS} SELECT page_id, pos, group_no, text FROM grp")
def style_groups(spark, d):
    return B.style_groups(_blocks(spark, d)).select("page_id", F.col("pos").cast("bigint"), F.col("group_no").cast("bigint"), "text")


_HEADS = "kind IN ('h', 'p', 'li', 'quote')"


@_query(f"WITH {BLOCKS} SELECT page_id, pos, text FROM blk WHERE {_HEADS} AND regexp_matches(text, '\\p{{L}}') AND NOT regexp_matches(text, '^\\s*(https?://|www\\.)\\S*\\s*$') AND NOT regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}\\x{{FF66}}-\\x{{FF9F}}]') AND NOT (len(list_filter(spans, lambda s: s.image)) > 0 AND len(list_filter(spans, lambda s: NOT (s.image OR {_solid('s.text')} = 0))) = 0)")
def translate_targets(spark, d):
    """Blocks to be translated into Japanese: words, no picture or address alone, not Japanese yet."""
    return _targets(spark, d).select("page_id", F.col("pos").cast("bigint"), "text")


def _targets(spark, d) -> DataFrame:
    b = _blocks(spark, d).where("kind IN ('h', 'p', 'li', 'quote')")
    t = F.col("text")
    b = b.withColumn("groups", B.grouped(F.col("spans"))).withColumn("request", B.request(F.col("groups")))
    return b.where(X.has_letter(t) & ~t.rlike(X.URL_ONLY) & ~t.rlike(f"[{X.KANA}]") & ~B.image_only(F.col("spans")))


_TARGETS = SQL["translate_targets"].split(" SELECT page_id, pos, text FROM blk", 1)
_ESC = "replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_REQUESTS = f"""{_GROUPS}, req AS (SELECT page_id, pos, CASE WHEN count(*) > 1 THEN string_agg('<a i=' || group_no || '>' || {_ESC.format(t='text')} || '</a>', '' ORDER BY group_no) ELSE {_ESC.format(t=_strip('max(text)'))} END AS request FROM grp GROUP BY page_id, pos)"""


def _batched(order: str) -> str:
    """The batches of requests in an order of places."""
    return f"""WITH RECURSIVE {BLOCKS}, {_REQUESTS}, tg AS (SELECT page_id, pos FROM blk{_TARGETS[1]}),
    t AS (SELECT page_id, pos, length(request) AS n, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS i FROM tg JOIN req USING (page_id, pos)),
    f AS (SELECT page_id, pos, i, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS k, CAST(n AS BIGINT) AS c FROM t WHERE i = 1
    UNION ALL SELECT t.page_id, t.pos, t.i, CASE WHEN f.k >= 50 OR f.c + t.n > 4000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.k >= 50 OR f.c + t.n > 4000 THEN 1 ELSE f.k + 1 END, CASE WHEN f.k >= 50 OR f.c + t.n > 4000 THEN t.n ELSE f.c + t.n END FROM f JOIN t ON t.page_id = f.page_id AND t.i = f.i + 1)
    SELECT page_id, pos, batch FROM f"""


@_query(_batched("pos"))
def translate_batches(spark, d):
    """The texts of a page in requests of at most 50 texts and 4,000 characters."""
    return B.batches(_targets(spark, d)).select("page_id", F.col("pos").cast("bigint"), F.col("batch").cast("bigint"))


@_query(_batched("pos < page_id % 20, pos"))
def translate_order(spark, d):
    """The same from the place on that a reader sees (here another for each page), what is above it last."""
    return B.batches(_targets(spark, d), top=F.pmod("page_id", F.lit(20))).select("page_id", F.col("pos").cast("bigint"), F.col("batch").cast("bigint"))


@_query(f"WITH {BLOCKS}, {_REQUESTS} SELECT page_id, pos, request FROM req JOIN blk USING (page_id, pos) WHERE {_HEADS}")
def translate_requests(spark, d):
    """What is sent for a block: its text, or its groups of one style in numbered marks."""
    b = _blocks(spark, d).where("kind IN ('h', 'p', 'li', 'quote')").where(F.size("spans") > 0)
    return b.withColumn("groups", B.grouped(F.col("spans"))).select("page_id", F.col("pos").cast("bigint"), B.request(F.col("groups")).alias("request"))


@_query(
    f"""WITH {BLOCKS}, t AS (SELECT page_id, pos, text, length(text) <= 24 AND len(regexp_split_to_array({_strip('text')}, '\\s+')) <= 4 AND instr(text, chr(10)) = 0 AS short FROM blk WHERE kind IN ('h', 'p', 'li', 'quote')),
    o AS (SELECT page_id, pos, 0 AS half, CASE WHEN short THEN text || '  [' || text || ']' ELSE text END AS line FROM t UNION ALL SELECT page_id, pos, 1, '[' || text || ']' FROM t WHERE NOT short)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos, half) - 1 AS BIGINT) AS place, pos, line FROM o"""
)
def bilingual_layout(spark, d):
    """Originals with their translations (here in brackets): short ones on one line, others below."""
    from pyspark.sql import Window as W

    b = _blocks(spark, d).where("kind IN ('h', 'p', 'li', 'quote')")
    t = F.col("text")
    other = F.concat(F.lit("["), t, F.lit("]"))
    both = F.when(X.is_short(t), F.array(F.concat(t, F.lit("  "), other))).otherwise(F.array(t, other))
    rows = b.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.posexplode(both).alias("half", "line"))
    return rows.select("page_id", (F.row_number().over(W.partitionBy("page_id").orderBy("pos", "half")) - 1).cast("bigint").alias("place"), "pos", "line")


def _md_spans(s: str) -> str:
    t = "replace(coalesce({s}[i].text, ''), chr(10), '  ' || chr(10))".format(s=s)
    w = lambda x, m, f: f"CASE WHEN coalesce({s}[i].{f}, false) THEN '{m}' || {x} || '{m}' ELSE {x} END"
    styled = w("(" + w("(" + w(t, "**", "bold") + ")", "*", "italic") + ")", "~~", "strike")
    body = f"CASE WHEN coalesce({s}[i].code, false) THEN '`' || {t} || '`' WHEN {_solid(t)} > 0 THEN {styled} ELSE {t} END"
    return f"coalesce(array_to_string(list_transform(range(1, len({s}) + 1), lambda i: ({body}) || CASE WHEN {s}[i].link IS NOT NULL AND {s}[i + 1].link IS DISTINCT FROM {s}[i].link THEN '[' || ({s}[i].link + 1) || ']' ELSE '' END), ''), '')"


_MD = _md_spans("spans")
_CELL = f"replace(replace({_md_spans('c')}, '|', chr(92) || '|'), '  ' || chr(10), ' ')"


@_query(
    f"""WITH {BLOCKS}, g AS (SELECT *, lag(kind) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM blk),
    w AS (SELECT *, list_max(list_transform(rws, lambda r: len(r))) AS width FROM g)
    SELECT page_id, pos, before IS NOT NULL AND NOT (before = 'li' AND kind = 'li') AS gap, coalesce(CASE kind
    WHEN 'h' THEN repeat('#', least(level + 1, 6)) || ' ' || {_MD} WHEN 'li' THEN repeat('  ', level) || CASE WHEN regexp_matches(marker, '^[0-9]+.$') THEN marker ELSE '-' END || ' ' || {_MD}
    WHEN 'quote' THEN '> ' || {_MD} WHEN 'pre' THEN '```' || chr(10) || coalesce(spans[1].text, '') || chr(10) || '```' WHEN 'hr' THEN '---'
    WHEN 'table' THEN array_to_string(list_transform(range(1, len(rws) + 1), lambda j: '| ' || array_to_string(list_concat(list_transform(rws[j], lambda c: {_CELL}), list_transform(range(width - len(rws[j])), lambda k: '')), ' | ') || ' |' || CASE WHEN j = 1 THEN chr(10) || '|' || repeat('---|', width) ELSE '' END), chr(10))
    ELSE {_MD} END, '') AS md FROM w"""
)
def markdown_blocks(spark, d):
    """Each block as Markdown, and whether an empty line stands before it."""
    return M.markdown_blocks(_blocks(spark, d)).select("page_id", F.col("pos").cast("bigint"), "gap", "md")


@_query(
    f"""WITH {BLOCKS}, h AS (SELECT page_id, level, row_number() OVER (PARTITION BY page_id ORDER BY level) - 1 AS rank FROM (SELECT DISTINCT page_id, level FROM blk WHERE kind = 'h')),
    j AS (SELECT b.page_id, b.pos, b.kind, CASE WHEN b.kind = 'h' THEN h.rank END AS own FROM blk b LEFT JOIN h ON b.page_id = h.page_id AND b.level = h.level),
    l AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS up FROM j)
    SELECT page_id, pos, CAST(CASE WHEN kind = 'h' THEN least(own * 2, 8) WHEN up IS NULL THEN 0 ELSE least((up + 1) * 2, 8) END AS BIGINT) AS indent FROM l"""
)
def heading_indents(spark, d):
    return M.indents(_blocks(spark, d)).select("page_id", F.col("pos").cast("bigint"), F.col("indent").cast("bigint"))


_N = "CAST(nullif(regexp_extract(marker, '^([0-9]+).$', 1), '') AS INTEGER)"


@_query(
    f"""WITH {BLOCKS}, n AS (SELECT page_id, pos, marker, pos % 3 AS depth, {_N} AS n FROM blk WHERE kind = 'li')
    SELECT page_id, pos, CASE WHEN marker = '' THEN '' WHEN n IS NULL THEN '-' WHEN depth = 1 THEN CASE WHEN n <= 26 THEN chr(n + 96) ELSE chr(CAST(trunc((n - 1) / 26) AS INTEGER) + 96) || chr((n - 1) % 26 + 97) END || '.'
    WHEN depth = 2 THEN ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(trunc(n / 10) AS INTEGER) + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] || '.' ELSE marker END AS shown FROM n"""
)
def list_markers(spark, d):
    """The numbers of list items by depth (here the place modulo three)."""
    b = _blocks(spark, d).where("kind = 'li'")
    return b.select("page_id", F.col("pos").cast("bigint"), M.list_marker(F.col("marker"), F.col("pos") % 3).alias("shown"))


@_query(f"WITH {BLOCKS} SELECT page_id, NOT bool_or(pos < 3 AND kind = 'h' AND {_norm('text')} <> '' AND contains({_norm('''coalesce(title, '')''')}, {_norm('text')})) AS title_line FROM blk GROUP BY page_id")
def title_headings(spark, d):
    """Whether a page needs a line with its title: none of its first three blocks is a heading within it."""
    b = _blocks(spark, d, "title")
    n, t = X.norm(F.col("text")), X.norm(F.coalesce("title", F.lit("")))
    return b.groupBy("page_id").agg((~F.bool_or((F.col("pos") < 3) & (F.col("kind") == "h") & (n != "") & F.contains(t, n))).alias("title_line"))


_REL = "arg_max(url, (pos, -n)) FILTER (WHERE regexp_matches(t, '{r}'))"


@_query(
    f"""WITH {BLOCKS}, sp AS (SELECT page_id, links, pos, unnest(range(len(spans))) AS n, unnest(spans) AS s FROM blk),
    l AS (SELECT page_id, pos, n, coalesce(s.text, '') AS t, links[s.link + 1] AS url FROM sp WHERE s.link IS NOT NULL)
    SELECT * FROM (SELECT page_id, {_REL.format(r=X.NEXT_LINK)} AS next_url, {_REL.format(r=X.PREVIOUS_LINK)} AS previous_url FROM l GROUP BY page_id) WHERE next_url IS NOT NULL OR previous_url IS NOT NULL"""
)
def rel_links(spark, d):
    """Where the last block with a link that reads like "next" or "previous" leads, by its first such link."""
    pages = _pages(spark, d, "page_id bigint, links array<string>, blocks array<struct<spans:array<struct<text:string,link:int>>>>")
    linked = F.filter(F.flatten(F.transform("blocks", lambda b: F.reverse(F.coalesce(b["spans"], F.array().cast("array<struct<text:string,link:int>>"))))), lambda s: s["link"].isNotNull())
    # blocks in order and each one's spans reversed: the last that reads so is the one
    at = lambda r: F.get("links", F.try_element_at(F.filter(linked, lambda s: F.coalesce(s["text"], F.lit("")).rlike(r)), F.lit(-1))["link"])
    out = once(pages, "page_id").select("page_id", at(X.NEXT_LINK).alias("next_url"), at(X.PREVIOUS_LINK).alias("previous_url"))
    return out.where("next_url IS NOT NULL OR previous_url IS NOT NULL")


@_query(f"WITH {BLOCKS}, i AS (SELECT page_id, pos, text, spans FROM blk WHERE len(list_filter(spans, lambda s: s.image)) > 0 AND len(list_filter(spans, lambda s: NOT (s.image OR {_solid('s.text')} = 0))) = 0) SELECT page_id, pos, text AS alt, list_filter(list_transform(spans, lambda s: s.src), lambda x: x IS NOT NULL) AS sources FROM i")
def page_images(spark, d):
    """Blocks that are pictures only, with the addresses of their pictures."""
    b = _blocks(spark, d).where(B.image_only(F.col("spans")))
    return b.select("page_id", F.col("pos").cast("bigint"), F.col("text").alias("alt"), F.filter(F.transform("spans", lambda s: s["src"]), lambda x: x.isNotNull()).alias("sources"))


@_query("SELECT page_id, anchor, CAST(min(pos) AS BIGINT) AS pos FROM (SELECT page_id, pos, unnest(anchors) AS anchor FROM (SELECT page_id, unnest(range(len(blocks))) AS pos, unnest(list_transform(blocks, lambda b: b.anchors)) AS anchors FROM page_docs)) GROUP BY page_id, anchor")
def anchor_places(spark, d):
    """The block that a fragment leads to (here an escaped one of every anchor): the first that has the anchor."""
    pages = table(spark, d, "page_docs", "page_id bigint, blocks array<struct<anchors:array<string>>>")
    held = pages.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", F.explode("b.anchors").alias("anchor"))
    first = held.groupBy("page_id", U.unquote(F.col("anchor")).alias("key")).agg(F.min("pos").cast("bigint").alias("pos"))
    link = F.concat(F.lit("https://a.example/x?y#"), F.replace(F.url_encode("anchor"), F.lit("+"), F.lit("%20")))
    asked = held.select("page_id", "anchor").distinct().withColumn("key", U.unquote(U.fragment(link)))
    return asked.join(first, ["page_id", "key"]).select("page_id", "anchor", "pos")


def _in_korean(t: str) -> str:
    return f"regexp_matches({t}, '[\\x{{AC00}}-\\x{{D7A3}}\\x{{1100}}-\\x{{11FF}}\\x{{3131}}-\\x{{318E}}]')"


_PLAIN_TARGETS = SQL["translate_targets"].replace(" AND NOT regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{FF66}-\\x{FF9F}]')", "")
_LABELLED = f"(SELECT page_id, 'ko' AS target FROM d UNION ALL SELECT page_id, 'en' FROM d WHERE coalesce(lower(regexp_extract(trim(coalesce(lang, '')), '^([^-_]*)', 1)), '') <> 'en')"


@_query(f"WITH {BLOCKS}, o AS ({_PLAIN_TARGETS.split('WITH ' + BLOCKS, 1)[1].strip()}) SELECT o.page_id, o.pos, t.target FROM o JOIN {_LABELLED} t USING (page_id) WHERE t.target = 'en' OR NOT {_in_korean('o.text')}")
def translate_targets_other(spark, d):
    """Blocks to be translated into Korean (none that is Korean) and into English (none of a page labelled so)."""
    pages = table(spark, d, "page_docs", f"page_id bigint, lang string, {FULL_BLOCKS}")
    b = B.page_blocks(pages, "lang").where("kind IN ('h', 'p', 'li', 'quote')")
    wanted = F.filter(F.array(F.lit("ko"), F.lit("en")), lambda t: B.is_to_translate(F.col("text"), F.col("spans"), F.col("lang"), t))
    return b.select("page_id", F.col("pos").cast("bigint"), F.explode(wanted).alias("target"))


@_query(f"WITH {BLOCKS}, l AS (SELECT page_id, pos, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM blk) SELECT page_id, pos, CAST(line_no AS BIGINT) AS line_no, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos, line_no) AS BIGINT) AS hit_no FROM l WHERE contains(lower(line), 'cookie')")
def find_in_page(spark, d):
    """Lines that hold a word, numbered in reading order."""
    from pyspark.sql import Window as W

    lines = _blocks(spark, d).select("page_id", "pos", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hit = lines.where(F.contains(F.lower("line"), F.lit("cookie")))
    return hit.select("page_id", F.col("pos").cast("bigint"), F.col("line_no").cast("bigint"), F.row_number().over(W.partitionBy("page_id").orderBy("pos", "line_no")).cast("bigint").alias("hit_no"))


@_query(
    f"""WITH {BLOCKS}, {_REF}, y AS (SELECT n.page_id, n.pos, n.norm, length(n.norm) AS len, r.ref, c.matched, c.shingles,
    b.text = '' OR len(list_filter(b.spans, lambda s: s.image)) > 0 AND len(list_filter(b.spans, lambda s: NOT (s.image OR {_solid("coalesce(s.text, '')")} = 0))) = 0 AS blank
    FROM n JOIN blk b USING (page_id, pos) JOIN r USING (page_id) LEFT JOIN c USING (page_id, pos)),
    t AS (SELECT page_id, pos, len, CASE WHEN coalesce(blank, false) OR norm = '' THEN NULL WHEN len < 4 THEN contains(ref, norm) ELSE matched * 2 >= shingles END AS match FROM y),
    w AS (SELECT page_id, pos, CASE WHEN match IS NULL THEN 0 WHEN match THEN len ELSE -len END AS weight FROM t),
    {_RUN},
    g AS (SELECT z.page_id, (SELECT max(a.pos) FROM m a WHERE a.page_id = z.page_id AND a.pos <= z.last AND a.q = (SELECT b.low FROM m b WHERE b.page_id = z.page_id AND b.pos = z.last)) AS "first", z.last AS "last" FROM z),
    v AS (SELECT t.page_id, t.pos, t.match, last_value(match IGNORE NULLS) OVER (PARTITION BY t.page_id ORDER BY t.pos) AS before, first_value(match IGNORE NULLS) OVER (PARTITION BY t.page_id ORDER BY t.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM t JOIN g ON g.page_id = t.page_id AND t.pos BETWEEN g."first" AND g."last")
    SELECT page_id, pos FROM v WHERE coalesce(match, before AND after)"""
)
def select_by_reference(spark, d):
    """The blocks of a page that its reference text covers."""
    b = _blocks(spark, d)
    return S.selected(b, _reference(b.withColumn("norm", X.norm(F.col("text"))))).select("page_id", F.col("pos").cast("bigint"))


@_query(
    f"""WITH {BLOCKS}, s AS (SELECT page_id, kind, unnest(regexp_extract_all(text, '{X.SENTENCE}')) AS sentence FROM blk WHERE kind IN ('p', 'li', 'quote')),
    o AS (SELECT page_id, string_agg({_norm('sentence')}, chr(10)) AS there, sum(length(sentence)) AS other_chars FROM s WHERE kind = 'quote' GROUP BY page_id),
    k AS (SELECT s.page_id, length(sentence) AS size, coalesce(other_chars, 0) AS other_chars, coalesce(contains(there, substr({_norm('sentence')}, 1, 20)), false) AS known FROM s LEFT JOIN o USING (page_id)),
    t AS (SELECT page_id, CAST(sum(size) AS BIGINT) AS own_chars, CAST(max(other_chars) AS BIGINT) AS other_chars, CAST(sum(CASE WHEN known THEN size ELSE 0 END) AS BIGINT) AS common_chars FROM k GROUP BY page_id)
    SELECT *, own_chars >= 300 AND own_chars >= 1.5 * other_chars AND common_chars < 0.3 * own_chars AS prefer FROM t"""
)
def prefer_own_decision(spark, d):
    """Whether a page's own extraction is preferred to one of its quotes only."""
    b = _blocks(spark, d).where("kind IN ('p', 'li', 'quote')")
    s = b.select("page_id", "kind", F.explode(X.prose_sentences(F.col("text"))).alias("sentence"))
    out = S.prefer_own(s.select("page_id", "sentence"), s.where("kind = 'quote'").select("page_id", "sentence"))
    return out.select("page_id", F.col("own_chars").cast("bigint"), F.col("other_chars").cast("bigint"), F.col("common_chars").cast("bigint"), "prefer")


@_query(
    f"""WITH {BLOCKS}, l AS (SELECT page_id, unnest(range(len(links))) AS link, unnest(links) AS url FROM d),
    hit AS (SELECT l.page_id, l.link FROM l JOIN sites ON sites.lang <> 'en' AND (lower(regexp_extract(url, '://([^/?#:]*)', 1)) = sites.host OR ends_with(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.' || sites.host))),
    s AS (SELECT page_id, pos, kind, unnest(spans) AS s FROM blk),
    t AS (SELECT s.page_id, s.pos, s.kind, hit.link IS NOT NULL AS hit, {_solid("coalesce(s.s.text, '')")} = 0 AS blank FROM s LEFT JOIN hit ON hit.page_id = s.page_id AND hit.link = s.s.link),
    g AS (SELECT page_id, pos, any_value(kind) AS kind, bool_and(hit OR blank) AS only_, count(*) FILTER (WHERE hit) AS hits FROM t GROUP BY page_id, pos)
    SELECT page_id, pos, kind IN ('p', 'li', 'quote') AND only_ AS removed, CAST(CASE WHEN kind IN ('p', 'li', 'quote') AND only_ THEN 0 ELSE hits END AS BIGINT) AS unlinked FROM g WHERE hits > 0"""
)
def listed_links_cleaned(spark, d):
    """Pages without links to listed hosts (here those of one half of the sites): blocks removed, spans unlinked."""
    hosts = table(spark, d, "sites").where("lang <> 'en'").select(F.col("host").alias("suffix"))
    links = _pages(spark, d, "page_id bigint, links array<string>").select("page_id", F.posexplode("links").alias("link", "url"))
    listed = links.select("page_id", "link", F.explode(U.host_suffixes(U.host(F.col("url")))).alias("suffix")).join(hosts, "suffix").select("page_id", "link")
    return S.cleaned(_blocks(spark, d), listed).select("page_id", F.col("pos").cast("bigint"), "removed", "unlinked")


_MARKDOWN_BLOCKS = SQL["markdown_blocks"].split("SELECT page_id, pos, before IS NOT NULL", 1)
SQL["page_markdown"] = f"""{_MARKDOWN_BLOCKS[0].rstrip()}, mb AS (SELECT page_id, pos, before IS NOT NULL{_MARKDOWN_BLOCKS[1]}),
    bt AS (SELECT page_id, pos, coalesce(b.translation, false) AS translation FROM b0),
    body AS (SELECT page_id, string_agg(CASE WHEN gap AND NOT translation THEN chr(10) ELSE '' END || md, chr(10) ORDER BY pos) AS body FROM mb JOIN bt USING (page_id, pos) GROUP BY page_id)
    SELECT d.page_id, '# ' || coalesce(d.title, '') || chr(10) || '<' || coalesce(d.url, '') || '>' || chr(10) || coalesce(chr(10) || body, '')
    || CASE WHEN len(links) > 0 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(links) + 1), lambda i: '[' || i || ']: ' || links[i]), chr(10)) ELSE '' END || chr(10) AS markdown
    FROM d LEFT JOIN body USING (page_id)"""


_BODY = f"""sp AS (SELECT page_id, pos, kind, level, spans, {_SPEAK} AS speak FROM blk),
    ta AS (SELECT page_id, pos, kind, level, kind = 'h' AND regexp_matches(text, '{_TAIL}') AS tail FROM blk),
    oa AS (SELECT a.page_id, a.pos, coalesce(min(b.pos), 1000000) AS stop FROM ta a LEFT JOIN ta b ON a.page_id = b.page_id AND b.kind = 'h' AND b.pos > a.pos AND b.level <= a.level WHERE a.tail AND a.level BETWEEN 1 AND 6 GROUP BY ALL),
    bo AS (SELECT page_id, pos, kind, level, speak, {_KIND_BODY} AND regexp_matches(speak, '\\p{{L}}') AND NOT regexp_matches(speak, '[>›»/|]\\s*$')
    AND (kind = 'h' OR {_LINKED.format(x=' AND NOT coalesce(s.image, false)')} / greatest(length(speak), 1) < 0.5) AND NOT EXISTS (SELECT 1 FROM oa WHERE oa.page_id = sp.page_id AND sp.pos >= oa.pos AND sp.pos < oa.stop) AS body FROM sp),
    nx AS (SELECT a.page_id, a.pos, coalesce(min(b.pos), 1000000) AS stop FROM bo a LEFT JOIN bo b ON a.page_id = b.page_id AND b.kind = 'h' AND b.pos > a.pos AND b.level <= a.level WHERE a.kind = 'h' GROUP BY ALL)"""


@_query(f"WITH {BLOCKS}, {_BODY} SELECT page_id, pos, speak FROM bo WHERE body AND (kind <> 'h' OR EXISTS (SELECT 1 FROM nx JOIN bo i ON i.page_id = nx.page_id AND i.pos > nx.pos AND i.pos < nx.stop WHERE nx.page_id = bo.page_id AND nx.pos = bo.pos AND (i.kind = 'h' OR i.body)))")
def readable_blocks(spark, d):
    """Blocks that are read aloud: outside closing sections, and of the headings those with something to read below."""
    return B.readable(_blocks(spark, d)).select("page_id", F.col("pos").cast("bigint"), "speak")


@_query()
def speech_chunks(spark, d):
    """The pieces that are read aloud, with the places of their blocks."""
    b = B.readable(_blocks(spark, d))
    return b.select("page_id", F.col("pos").cast("bigint"), F.posexplode(X.reading_pieces("speak")).alias("n", "piece")).withColumn("n", F.col("n").cast("bigint"))


@_query(
    f"""WITH RECURSIVE {BLOCKS}, w AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS place FROM blk WHERE pos % 2 = 1),
    g AS (SELECT w.page_id, w.place, (SELECT min(b.pos) FROM blk b WHERE b.page_id = w.page_id AND b.text = w.text) AS shown FROM w WHERE place = 0
    UNION ALL SELECT w.page_id, w.place, min(b.pos) AS shown FROM g JOIN w ON w.page_id = g.page_id AND w.place = g.place + 1 JOIN blk b ON b.page_id = w.page_id AND b.text = w.text AND b.pos > g.shown GROUP BY w.page_id, w.place)
    SELECT page_id, CAST(place AS BIGINT) AS place, CAST(shown AS BIGINT) AS shown FROM g"""
)
def view_places(spark, d):
    """Where the blocks of a reduced page (here every other one) stand in the whole one, found by their texts in order."""
    b = _blocks(spark, d)
    order = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("pos", "text"))))
    pages = b.groupBy("page_id").agg(order(F.col("pos") % 2 == 1).alias("body"), order(F.lit(True)).alias("shown"))
    places = pages.select("page_id", F.posexplode(B.places_in_view(F.col("body")["text"], F.col("shown")["text"])).alias("place", "shown")).where("shown IS NOT NULL")
    return places.select("page_id", F.col("place").cast("bigint"), F.col("shown").cast("bigint"))

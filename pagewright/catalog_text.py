"""Queries on texts, with their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.catalog_blocks import _GROUPS, _HEADS, _SP, BLOCKS, _blocks, _strip
from pagewright.functions import layout as L
from pagewright.functions import text as X
from pagewright.operators import blocks as B
from pagewright.operators import printed as R
from pagewright.sources import store as J
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


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents", "doc_id bigint, text string, lang string").where("text IS NOT NULL")


_D = "(SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL)"


def _of(r: str) -> str:
    return f"length(regexp_replace(text, '[^{r}]', '', 'g'))"


_KANA, _KANJI, _LATIN = r"\x{3040}-\x{30FF}\x{FF66}-\x{FF9F}", r"\x{3400}-\x{9FFF}", r"A-Za-z\x{C0}-\x{24F}"


@_query(f"SELECT doc_id, {_of(_KANA)} AS kana, {_of(_KANJI)} AS kanji, {_of(chr(92) + 'x{AC00}-' + chr(92) + 'x{D7A3}')} AS hangul, {_of(chr(92) + 'x{E00}-' + chr(92) + 'x{E7F}')} AS thai, {_of(chr(92) + 'x{400}-' + chr(92) + 'x{4FF}')} AS cyrillic, {_of(_LATIN)} AS latin FROM {_D}")
def script_profile(spark, d):
    """Characters by script."""
    return _docs(spark, d).select("doc_id", *[c.cast("bigint").alias(n) for n, c in X.script_counts(F.col("text")).items()])


_CODE = f"lower(regexp_extract({_strip('lang')}, '^([^\\-_]*)', 1))"
_READ = "list_contains([" + ", ".join(f"'{c}'" for c in X.READABLE) + f"], {_CODE})"


@_query(
    f"""SELECT doc_id, CASE WHEN ja + latin > 0 AND ja > 0 AND ja >= 0.2 * (ja + latin) AND kana >= 0.05 * ja THEN 'ja' WHEN {_READ} AND {_CODE} <> 'ja' THEN {_CODE}
    WHEN coalesce({_strip('lang')}, '') IN ('', 'und') AND letters > 0 AND latin * 2 >= letters THEN 'en' END AS language
    FROM (SELECT *, {_of(_KANA)} AS kana, {_of(_KANA)} + {_of(_KANJI)} AS ja, {_of(_LATIN)} AS latin, {_of(chr(92) + 'p{L}')} AS letters FROM {_D})"""
)
def language_rules(spark, d):
    """The language by script and label."""
    return _docs(spark, d).select("doc_id", X.language_by_rules(F.col("text"), F.col("lang")).alias("language"))


@_query(f"SELECT DISTINCT lang, CASE WHEN {_READ} THEN {_CODE} END AS readable FROM page_docs WHERE lang IS NOT NULL")
def locale_codes(spark, d):
    """Declared labels as languages that can be read aloud."""
    return table(spark, d, "page_docs", "lang string").where("lang IS NOT NULL").distinct().select("lang", X.readable_code(F.col("lang")).alias("readable"))


# letters and digits outside the Japanese ranges, by what they are not
_JAPANESE = r"ぁ-ヿ㐀-鿿\x{F900}-\x{FAFF}ｦ-ﾟ"
_MARKS = r"\x{E31}\x{E34}-\x{E3A}\x{E4D}\x{24B6}-\x{24E9}"
_RUN_PATTERN = rf"[ぁ-ゟ]+|[゠-ヿｦ-ﾟ]+|[㐀-鿿\x{{F900}}-\x{{FAFF}}々〆ヶ]+|(?:[^\P{{L}}{_JAPANESE}]|[^\P{{N}}{_JAPANESE}]|[{_MARKS}])+|[^\s\p{{L}}\p{{N}}{_MARKS}]+"


@_query(f"WITH r AS (SELECT doc_id, regexp_extract_all(text, '{_RUN_PATTERN}') AS runs FROM {_D}) SELECT doc_id, CAST(unnest(range(len(runs))) AS BIGINT) AS run_no, unnest(runs) AS run FROM r")
def script_runs(spark, d):
    """Runs of one script."""
    return _docs(spark, d).select("doc_id", F.posexplode(X.script_runs(F.col("text"))).alias("run_no", "run")).withColumn("run_no", F.col("run_no").cast("bigint"))


@_query()
def reading_pieces(spark, d):
    """Texts cut for reading aloud: at stops, outside brackets, and at 150 characters."""
    return _docs(spark, d).select("doc_id", F.posexplode(X.reading_pieces("text")).alias("piece_no", "piece"))


_JA = r"\x{3001}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF01}-\x{FFEF}"
_GAP = r"[ \t\x{A0}]+"


def _closed(t: str) -> str:
    """Gaps closed twice over, as one pass cannot match a character both as end and as start."""
    for _ in range(2):
        t = f"regexp_replace({t}, '([{_JA}]){_GAP}([{_JA}A-Za-z0-9])', '\\1\\2', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([A-Za-z0-9]){_GAP}([{_JA}])', '\\1\\2', 'g')"
    return t


_VISIBLE = r"regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')"


@_query(f"SELECT doc_id, {_closed(_VISIBLE)} AS clean FROM {_D}")
def printed_clean(spark, d):
    """Printed text without control characters and gaps within Japanese."""
    return _docs(spark, d).select("doc_id", X.extracted_text(F.col("text")).alias("clean"))


@_query(f"SELECT doc_id, CAST(count(DISTINCT lower(w)) AS BIGINT) AS words FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM {_D}) WHERE length(w) > 1 GROUP BY doc_id")
def printed_vocabulary(spark, d):
    return R.vocabulary(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("words"))


_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_LINES = f"l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '{_BREAKS}') AS a FROM {_D}))"


@_query(
    f"""WITH {_LINES}, n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS below FROM l),
    c AS (SELECT doc_id, line_no, regexp_extract(line, '([A-Za-z]+)-$', 1) AS "left", regexp_extract(below, '^([a-z][A-Za-z]*)', 1) AS "right" FROM n),
    v AS (SELECT DISTINCT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM {_D}) WHERE length(w) > 1)
    SELECT c.doc_id, CAST(line_no AS BIGINT) AS line_no, "left", "right", CASE WHEN v.w IS NOT NULL THEN "left" || "right" ELSE "left" || '-' || "right" END AS joined FROM c LEFT JOIN v ON c.doc_id = v.doc_id AND lower("left" || "right") = v.w WHERE "left" <> '' AND "right" <> ''"""
)
def printed_hyphens(spark, d):
    return R.hyphens(_docs(spark, d)).withColumn("line_no", F.col("line_no").cast("bigint"))


@_query(
    f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, {_strip('line')} AS line FROM l),
    b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM s),
    n AS (SELECT *, before IS NULL OR before = '' OR (length(before) < 40 AND regexp_matches(before, '[。.．！!？?：:」』）)]$')) AS new FROM b),
    p AS (SELECT *, sum(CASE WHEN new AND line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS par FROM n)
    SELECT doc_id, CAST(par - 1 AS BIGINT) AS par_no, string_agg(CASE WHEN NOT new AND regexp_matches(before, '[\\x00-\\x7F]$') AND regexp_matches(line, '^[\\x00-\\x7F]') THEN ' ' ELSE '' END || line, '' ORDER BY line_no) AS text FROM p WHERE line <> '' GROUP BY doc_id, par"""
)
def printed_paragraphs(spark, d):
    return R.paragraphs(_docs(spark, d)).withColumn("par_no", F.col("par_no").cast("bigint"))


@_query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\r\\f\\x{{A0}}\\x{{3000}}]*\\n[ \\t\\r\\f\\n\\x{{A0}}\\x{{3000}}]*', chr(10), 'g'), '[ \\t\\r\\f\\x{{A0}}]+', ' ', 'g') AS collapsed FROM {_D}")
def collapsed_space(spark, d):
    return _docs(spark, d).select("doc_id", X.collapse(F.col("text")).alias("collapsed"))


@_query(f"SELECT doc_id, {_strip('text')} AS stripped, CAST(length(regexp_replace(text, '{_SP}', '', 'g')) AS BIGINT) AS solid FROM {_D}")
def stripped_text(spark, d):
    return _docs(spark, d).select("doc_id", X.strip(F.col("text")).alias("stripped"), X.solid_length(F.col("text")).cast("bigint").alias("solid"))


@_query(f"SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, text AS back FROM {_D}")
def escaped_text(spark, d):
    e = X.escape(F.col("text"))
    plain = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _docs(spark, d).select("doc_id", e.alias("escaped"), X.unescape(plain).alias("back"))


@_query(f"SELECT doc_id, base64(encode(text)) AS raw FROM {_D}")
def base64_text(spark, d):
    """Texts in Base64 on one line."""
    return _docs(spark, d).select("doc_id", X.base64_plain(F.col("text")).alias("raw"))


@_query("SELECT doc_id, regexp_replace(text, '\\s+([,.;:!?](?:\\s|$)|[)\\]）」』、。])', '\\1', 'g') AS tidy FROM " + _D)
def tidy_spaces(spark, d):
    """Texts without blanks before closing signs."""
    return _docs(spark, d).select("doc_id", X.tidy_spaces(F.col("text")).alias("tidy"))


def _wide(c: str) -> str:
    for pair, form in X.VOICED.items():
        c = f"replace({c}, '{pair}', '{form}')"
    c = f"regexp_replace({c}, '[\\x00-\\x1F\\x7F]', '', 'g')"
    signs = "".join(chr(i) for i in range(0x20, 0x7F)).replace("'", "''") + "".join(X.HALF_WIDTH) + X.VOICE_MARKS
    return f"translate({c}, '{signs}', '　" + "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F)) + "".join(unicodedata.normalize("NFKC", k) for k in X.HALF_WIDTH) + "')"


_WIDE = _wide("text")


@_query(f"SELECT doc_id, {_WIDE} AS wide FROM {_D}")
def full_width_text(spark, d):
    return _docs(spark, d).select("doc_id", X.full_width(F.col("text")).alias("wide"))


@_query(f"SELECT doc_id, CAST(length(regexp_replace(text, '[^\\x{{3041}}-\\x{{3096}}\\x{{30A1}}-\\x{{30FA}}\\x{{30FC}}]|[ゃゅょぁぃぅぇぉャュョァィゥェォ]', '', 'g')) AS BIGINT) AS moras FROM {_D}")
def mora_counts(spark, d):
    """Moras of the kana in each text."""
    return _docs(spark, d).select("doc_id", X.mora_count(F.col("text")).cast("bigint").alias("moras"))


@_query()
def speech_input(spark, d):
    """Texts as a voice model reads them."""
    return _docs(spark, d).select("doc_id", X.speech_input("text", F.coalesce(F.col("lang"), F.lit("na"))).alias("spoken"))


@_query(f"SELECT doc_id, text AS labelled, text AS marked, text AS named FROM {_D}")
def decoded_bytes(spark, d):
    """Texts from bytes: of a declared charset, of UTF-8 with a mark in front, and of a charset named in their beginning."""
    docs = _docs(spark, d)
    utf8, none = F.encode("text", "UTF-8"), F.lit(None).cast("string")
    head = '<meta charset="utf-8">'
    named = X.decoded(F.concat(F.encode(F.lit(head), "UTF-8"), utf8), none)
    return docs.select("doc_id", X.decoded(F.encode("text", "UTF-16LE"), F.lit("utf-16-le")).alias("labelled"), X.decoded(F.concat(F.unhex(F.lit("EFBBBF")), utf8), F.lit("utf-8")).alias("marked"), F.substring(named, len(head) + 1, 2**30).alias("named"))


_TYPES = ["text/html; charset=UTF-8", "application/xhtml+xml", "application/pdf", "text/plain; Charset=\"shift_jis\"", "application/ld+json", "image/png", ""]
_LIST = "[" + ", ".join(f"'{x}'" for x in _TYPES) + "]"


@_query(
    f"""SELECT site_id, content_type, mime, lower(regexp_extract(content_type, '(?i)charset=\\s*"?([^\\s;"]*)', 1)) AS charset,
    CASE WHEN mime IN ('text/html', 'application/xhtml+xml', '') THEN 'page' WHEN mime = 'application/pdf' THEN 'pdf' WHEN starts_with(mime, 'text/') OR regexp_matches(mime, '(json|xml|javascript)$') THEN 'text' ELSE 'download' END AS route
    FROM (SELECT *, lower(trim(string_split(content_type, ';')[1])) AS mime FROM (SELECT site_id, unnest({_LIST}) AS content_type FROM sites))"""
)
def content_routes(spark, d):
    """What becomes of a response by its content type (here of each site, for seven types)."""
    t = table(spark, d, "sites").select("site_id", F.explode(F.array(*map(F.lit, _TYPES))).alias("content_type"))
    t = t.withColumn("mime", F.lower(F.trim(F.substring_index("content_type", ";", 1))))
    m = F.col("mime")
    route = F.when(m.isin("text/html", "application/xhtml+xml", ""), "page").when(m == "application/pdf", "pdf").when(m.startswith("text/") | m.rlike("(json|xml|javascript)$"), "text").otherwise("download")
    return t.select("site_id", "content_type", "mime", F.lower(F.regexp_extract("content_type", r'(?i)charset=\s*"?([^\s;"]*)', 1)).alias("charset"), route.alias("route"))


def _class(holds: Callable[[str], bool]) -> str:
    """The characters of which something holds as the inside of a character class."""
    out, start = [], None
    for c in range(0x20, 0x20001):
        inside = not 0xD800 <= c < 0xE000 and c < 0x20000 and holds(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\x{{{start:X}}}-\\x{{{c - 1:X}}}")
            start = None
    return "".join(out)


_CELLS = f"length(text) + length(regexp_replace(text, '[^{_class(lambda c: L.char_width(c) == 2)}]', '', 'g')) - length(regexp_replace(text, '[^\\x00-\\x1F{_class(lambda c: L.char_width(c) == 0)}]', '', 'g'))"


@_query(f"SELECT doc_id, CAST(CASE WHEN strlen(text) = length(text) THEN length(text) ELSE {_CELLS} END AS BIGINT) AS cells FROM {_D}")
def cell_widths(spark, d):
    """How many cells of a terminal each text takes."""
    return _docs(spark, d).select("doc_id", L.cell_width("text").cast("bigint").alias("cells"))


@_query()
def wrapped_lines(spark, d):
    """Texts in lines of 80 cells."""
    return _docs(spark, d).select("doc_id", F.posexplode(L.wrapped("text")).alias("line_no", "line"))


@_query()
def shortened_titles(spark, d):
    """Titles cut to 20 cells."""
    p = table(spark, d, "page_docs", "page_id bigint, title string").distinct()
    return p.select("page_id", L.shortened("title", F.lit(20)).alias("title"))


_TIDY = "regexp_replace({t}, '\\s+([,.;:!?](?:\\s|$)|[)\\]）」』、。])', '\\1', 'g')"


@_query(f"SELECT doc_id, CAST(1 AS BIGINT) AS parts, {_TIDY.format(t='text')} AS first FROM {_D} WHERE regexp_matches(text, '\\S')")
def reply_spans(spark, d):
    """Replies for texts of one style, as JSON: one part each, its escapes undone and its blanks tidied."""
    docs = _docs(spark, d).where(F.col("text").rlike(r"\S"))
    texts = docs.select("doc_id", F.explode(J.reply_texts(F.to_json(F.array(X.escape(F.col("text")))))).alias("reply")).withColumn("spans", J.reply_spans("reply", F.lit(1)))
    return texts.select("doc_id", F.size("spans").cast("bigint").alias("parts"), F.get("spans", F.lit(0))["text"].alias("first"))


@_query(
    f"""WITH {BLOCKS}, {_GROUPS}, k AS (SELECT *, count(*) OVER (PARTITION BY page_id, pos) AS n FROM grp JOIN blk b USING (page_id, pos) WHERE {_HEADS})
    SELECT page_id, pos, CAST(group_no AS BIGINT) AS i, {_TIDY.format(t="CASE WHEN n > 1 THEN '>' || grp_text || '<' ELSE grp_text END")} AS text FROM (SELECT page_id, pos, group_no, n, CASE WHEN n > 1 THEN text ELSE {_strip('text')} END AS grp_text FROM (SELECT page_id, pos, group_no, n, text FROM k)) WHERE n > 1 OR length(grp_text) > 0"""
)
def reply_spans_whole(spark, d):
    """Marked replies taken apart: the requests of all blocks with each text between two signs, their groups in the
    opposite order, come back as JSON and keep their styles."""
    b = _blocks(spark, d).where("kind IN ('h', 'p', 'li', 'quote')").where(F.size("spans") > 0)
    b, groups = b.withColumn("groups", B.grouped(F.col("spans"))), F.col("groups")
    marked = F.transform(groups, lambda g, i: F.concat(F.lit("<a i="), i.cast("string"), F.lit(">&gt;"), X.escape(g["text"]), F.lit("&lt;</a>")))
    request = F.when(F.size(groups) > 1, F.array_join(F.reverse(marked), "")).otherwise(X.escape(X.strip(F.get(groups, F.lit(0))["text"])))
    rows = b.select("page_id", "pos", F.size(groups).alias("n"), request.alias("request"))
    replies = rows.select("page_id", "pos", "n", F.explode(J.reply_texts(F.to_json(F.array("request")))).alias("reply"))
    return replies.select("page_id", F.col("pos").cast("bigint"), F.explode(J.reply_spans("reply", "n")).alias("x")).select("page_id", "pos", F.col("x.i").cast("bigint").alias("i"), "x.text")


_MORAS = "CAST(length(regexp_replace(text, '[^\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}\\x{30FC}]|[ゃゅょぁぃぅぇぉャュョァィゥェォ]', '', 'g')) AS BIGINT)"
_INNER = f"regexp_replace(regexp_replace(text, '^[{X.PAUSES}\\s]+', ''), '[{X.PAUSES}\\s]+$', '')"


@_query(f"SELECT doc_id, moras, pauses, round(CAST(0.95 * (0.27 + 0.154 * moras) + 0.3 * pauses AS DOUBLE), 6) AS seconds FROM (SELECT doc_id, {_MORAS} AS moras, CAST(len(regexp_extract_all({_INNER}, '[{X.PAUSES}]+')) AS BIGINT) AS pauses FROM {_D})")
def least_durations(spark, d):
    """The least time that each text's kana are given when they are read."""
    t = _docs(spark, d).select("doc_id", X.mora_count(F.col("text")).cast("bigint").alias("moras"), X.pause_count(F.col("text")).cast("bigint").alias("pauses"))
    return t.withColumn("seconds", F.round(X.least_seconds(F.col("moras"), F.col("pauses")), 6))


@_query("SELECT DISTINCT page_id, title AS reading, CAST(NULL AS VARCHAR) AS starred FROM page_docs WHERE title <> '' AND NOT regexp_matches(title, '[\\x00-\\x1F\\\\]') AND trim(title) = title")
def word_readings(spark, d):
    """The ninth field of features whose fields may hold commas and quotes (here each page's title)."""
    p = table(spark, d, "page_docs", "page_id bigint, title string").where("title <> ''").distinct()
    p = p.where(~F.col("title").rlike(r"[\x00-\x1F\\]") & (F.trim("title") == F.col("title")))
    field = F.concat(F.lit('"'), F.replace("title", F.lit('"'), F.lit('""')), F.lit('"'))
    front = F.concat(F.lit("a,"), field, F.lit(",c,d,,f,g,h,"))
    return p.select("page_id", X.pronunciation(F.concat(front, field, F.lit(",x"))).alias("reading"), X.pronunciation(F.concat(front, F.lit("*,x"))).alias("starred"))


@_query()
def printed_joined(spark, d):
    """Printed texts with their wrapped lines joined."""
    return _docs(spark, d).select("doc_id", R.joined_lines("text").alias("text"))


@_query(f"SELECT doc_id, text, coalesce(lang, '') AS told FROM {_D} WHERE coalesce(lang, '') <> 'en' AND length({_strip('text')}) > 0 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')")
def translations_kept(spark, d):
    """The replies that replace their original (here each text with its label as a reply into English): not blank, and of another language."""
    docs = _docs(spark, d).where(~F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    reply = F.to_json(F.array(F.array("text", F.coalesce("lang", F.lit("")))))
    pairs = docs.select("doc_id", F.explode(J.reply_pairs(reply)).alias("p"))
    return pairs.where(J.is_of_use(F.col("p.text"), F.col("p.lang"), "en")).select("doc_id", "p.text", F.col("p.lang").alias("told"))

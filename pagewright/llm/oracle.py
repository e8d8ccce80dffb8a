"""SQL for the problems that SQL can state: a second way to the same rows, for tables of any size that one machine holds."""

from __future__ import annotations

from pagewright.llm import collapse, repeats, unify

_HOST = r"regexp_replace(rtrim(lower(regexp_extract({u}, '^\s*(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?)?([^/?#:\s]+)', 1)), '.'), '^www\.', '')"
#: Pages once each, their blocks and spans.
_ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ingested_at) AS nth FROM page_docs) WHERE nth = 1)"
_BLOCKS = f"(SELECT page_id, url, CAST(unnest(range(len(blocks))) AS BIGINT) AS pos, unnest(blocks) AS b FROM {_ONCE})"


def copies() -> str:
    """p6_found."""
    between = collapse._BETWEEN.replace("'", "''")
    separator = collapse._SEPARATOR.replace("'", "''")
    words = lambda c: f"trim(regexp_replace(translate(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ'), '{between}', ' ', 'g'))"
    parts = lambda c: f"array_to_string(list_sort(list_filter(list_transform({c}, lambda p: {words('p')}), lambda p: p <> '')), ' ')"
    return f"""WITH i AS (SELECT DISTINCT item_id, coalesce(lower(trim(kind)), '') AS kind, coalesce(target, '') AS target, coalesce(title, '') AS title FROM items),
    a AS (SELECT *, string_split(target, '#')[1] AS address FROM i),
    q AS (SELECT *, substr(target, length(address) + 2) AS fragment, string_split(address, '?')[1] AS path FROM a),
    k AS (SELECT item_id, kind, CASE WHEN kind = 'url' THEN {words('path')} || chr(10) || {parts("regexp_split_to_array(substr(address, length(path) + 2), '[&;]')")} || chr(10) || {words('fragment')} ELSE {words('target')} END AS target_key,
    {parts(f"regexp_split_to_array(title, '{separator}')")} AS title_key FROM q),
    g AS (SELECT item_id, min(item_id) OVER (PARTITION BY kind, target_key, title_key) AS keep_id FROM k)
    SELECT DISTINCT keep_id, item_id AS copy_id FROM g WHERE item_id <> keep_id"""


def disguised() -> str:
    """p7_found."""
    spans = f"SELECT page_id, pos, CAST(unnest(range(len(b.spans))) AS BIGINT) AS span_pos, unnest(b.spans) AS s FROM {_BLOCKS}"
    source = f"(SELECT 'page' AS record, page_id AS record_id, pos, span_pos, s.text AS text FROM ({spans}) UNION ALL SELECT DISTINCT 'chunk', chunk_id, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), text FROM chunks)"
    return f"SELECT DISTINCT record, record_id, pos, span_pos FROM ({unify.build_sql(True, source)})"


def repeated_lines() -> str:
    """p3_found: the letters of each line in its one form decide which lines are the same."""
    text = "array_to_string(list_transform(b.spans, lambda s: coalesce(s.text, '')), '')"
    blocks = f"SELECT page_id, pos, string_split({text}, chr(10)) AS lines FROM {_BLOCKS} WHERE b.kind IS DISTINCT FROM 'table' AND url IS NOT NULL"
    source = f"(SELECT 'line' AS record, page_id AS record_id, pos, CAST(unnest(range(len(lines))) AS BIGINT) AS span_pos, unnest(lines) AS text FROM ({blocks}))"
    letters = r"regexp_replace(replace(translate(lower(unified), 'ςªº', 'σao'), 'ß', 'ss'), '[^\p{L}\x{E31}\x{E34}-\x{E3A}\x{E47}-\x{E4E}]', '', 'g')"
    return f"""WITH site AS (SELECT page_id, {_HOST.format(u='url')} AS host FROM {_ONCE} WHERE url IS NOT NULL),
    l AS (SELECT record_id AS page_id, pos, span_pos AS line_no, {letters} AS line FROM ({unify.build_sql(False, source)})),
    n AS (SELECT host, count(*) AS total FROM site WHERE host <> '' GROUP BY host),
    c AS (SELECT host, line, count(DISTINCT page_id) AS pages FROM l JOIN site USING (page_id) WHERE line <> '' AND host <> '' GROUP BY host, line),
    often AS (SELECT host, line FROM c JOIN n USING (host) WHERE pages >= {repeats.LEAST_PAGES} AND pages * 100 >= total * {repeats.LEAST_PERCENT})
    SELECT l.page_id, l.pos, l.line_no FROM l JOIN site USING (page_id) JOIN often USING (host, line)"""


def cleaned_pages() -> str:
    """p3_pages."""
    text = "array_to_string(list_transform(b.spans, lambda s: coalesce(s.text, '')), '')"
    cells = "array_to_string(list_transform(b.cell_rows, lambda r: array_to_string(list_transform(r, lambda c: array_to_string(list_transform(c, lambda s: coalesce(s.text, '')), '')), chr(9))), chr(10))"
    return f"""WITH gone AS ({repeated_lines()}),
    t AS (SELECT page_id, pos, b.kind = 'table' AS is_table, {text} AS text, {cells} AS cells FROM {_BLOCKS}),
    l AS (SELECT page_id, pos, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM t WHERE NOT coalesce(is_table, false) AND text <> ''),
    k AS (SELECT l.page_id, l.pos, string_agg(line, chr(10) ORDER BY l.line_no) AS text FROM l LEFT JOIN gone USING (page_id, pos, line_no) WHERE gone.page_id IS NULL GROUP BY l.page_id, l.pos),
    r AS (SELECT * FROM k UNION ALL SELECT page_id, pos, cells FROM t WHERE is_table AND regexp_matches(cells, '\\S'))
    SELECT * FROM r UNION ALL SELECT page_id, CAST(-1 AS BIGINT), '' FROM {_ONCE} WHERE page_id NOT IN (SELECT page_id FROM r)"""

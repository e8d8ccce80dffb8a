"""Problem 7: one form for text that looks alike.

DuckDB runs inside each Arrow partition. Its SQL composes with ``nfc_normalize``, maps full-width and half-width
forms, ligatures and radicals with ``translate``, strips invisible characters and odd blanks with regular
expressions, and turns words of mixed scripts into the one script that their unmistakable letters belong to.

Defined results: a null text stays null and is never altered; an empty text stays empty; a text of any length is one
value; repeated rows give repeated rows (``found`` counts a key once); extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import ALIKE, ALIKE_CYRILLIC, _flatten
from pagewright.sources.tables import table

SCHEMA = "record string, record_id bigint, pos bigint, span_pos bigint, text string, unified string, altered boolean"
PAGES = "page_id bigint, blocks array<struct<spans:array<struct<text:string>>>>"


#: Pages that DuckDB sees at a time, and the memory that it may use in a task.
ROWS, MEMORY = 1000, "512MB"


def _forms() -> dict[str, str]:
    """Single characters that stand for ordinary ones, by rule: those whose compatibility form is other letters."""
    blocks = [range(0xFF10, 0xFF1A), range(0xFF21, 0xFF3B), range(0xFF41, 0xFF5B), range(0xFF66, 0xFFDD), range(0x2F00, 0x2FD6), range(0xFB00, 0xFB07), range(0xF900, 0xFAFF), range(0x2E80, 0x2EF4), range(0x1D400, 0x1D800)]
    out = {}
    for block in blocks:
        for c in map(chr, block):
            form = unicodedata.normalize("NFKC", c)
            if form != c and all(unicodedata.category(x)[0] in "LNM" for x in form):
                out[c] = form
    return out


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def build_sql(only_altered: bool = False, source: str = "batch") -> str:
    """The statement that brings ``source`` (columns of SCHEMA up to text) to one form."""
    forms = _forms()
    single = {k: v for k, v in forms.items() if len(v) == 1}
    several = {k: v for k, v in forms.items() if len(v) > 1}
    latin, other = r"A-Za-z\x{C0}-\x{24F}", r"\x{370}-\x{3FF}\x{400}-\x{52F}"
    mixed = f"[{latin}][{other}]|[{other}][{latin}]"
    # half-width voiced kana become a base and a half-width mark; the marks turn into combining ones, which NFC joins
    steps = f"replace(replace(text, 'ﾞ', '゙'), 'ﾟ', '゚')"
    steps = f"translate({steps}, {_quote(''.join(k for k in single if k not in 'ﾞﾟ'))}, {_quote(''.join(v for k, v in single.items() if k not in 'ﾞﾟ'))})"
    for k, v in several.items():
        steps = f"replace({steps}, {_quote(k)}, {_quote(v)})"
    steps = f"replace({steps}, 'ํา', 'ำ')"
    steps = rf"regexp_replace({steps}, '[\x{{AD}}\x{{200B}}\x{{200C}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    steps = rf"regexp_replace({steps}, '([\p{{L}}\p{{M}}\p{{N}}\p{{P}}\s])\x{{200D}}+', '\1', 'g')"
    steps = rf"regexp_replace({steps}, '[\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}]', ' ', 'g')"
    steps = f"nfc_normalize({steps})"
    letters = _quote("".join(ALIKE))
    cyrillic = _quote("".join(ALIKE_CYRILLIC))
    word = f"""CASE
        WHEN NOT regexp_matches(w, '{mixed}') THEN w
        WHEN translate(regexp_replace(w, '[^{latin}]', '', 'g'), {cyrillic}, '') = '' AND (
             translate(regexp_replace(w, '[^{other}]', '', 'g'), {letters}, '') <> ''
             OR length(regexp_replace(w, '[^{other}]', '', 'g')) > length(regexp_replace(w, '[^{latin}]', '', 'g')))
        THEN translate(w, {cyrillic}, {_quote("".join(ALIKE_CYRILLIC.values()))})
        ELSE translate(w, {letters}, {_quote("".join(ALIKE.values()))}) END"""
    # an ASCII text is in its one form already; one without any character of concern skips the mapping
    concern = r"[\x{AD}\x{A0}\x{2000}-\x{200D}\x{202F}\x{205F}\x{2060}\x{FEFF}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FFDC}\x{2E80}-\x{2FD5}\x{FB00}-\x{FB06}\x{F900}-\x{FAFF}\x{1D400}-\x{1D7FF}\x{E4D}]"
    return f"""
    WITH seen AS (
        SELECT *, CASE WHEN text IS NULL OR strlen(text) = length(text) THEN 0
                       WHEN regexp_matches(text, '{concern}') OR nfc_normalize(text) <> text THEN 2
                       WHEN regexp_matches(text, '{mixed}') THEN 1 ELSE 0 END AS level
        FROM {source}),
    mapped AS (SELECT * EXCLUDE level, CASE WHEN level = 2 THEN {steps} ELSE text END AS t, level FROM seen{" WHERE level > 0" if only_altered else ""}),
    spelled AS (
        SELECT * EXCLUDE (t, level), CASE WHEN level > 0 AND regexp_matches(t, '{mixed}') THEN
            nfc_normalize(array_to_string(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), ''))
            ELSE t END AS unified
        FROM mapped)
    SELECT record, record_id, pos, span_pos, text, unified, unified IS DISTINCT FROM text AS altered
    FROM spelled{" WHERE unified IS DISTINCT FROM text" if only_altered else ""}
    """


def _run(flat: Iterator[pa.Table], only_altered: bool) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})  # nothing is written to the machine's disk
    sql = build_sql(only_altered)
    try:
        for t in flat:
            con.register("batch", t)
            out = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            yield from out.cast(_ARROW).to_batches()
    finally:
        con.close()


_ARROW = pa.schema([("record", pa.string()), ("record_id", pa.int64()), ("pos", pa.int64()), ("span_pos", pa.int64()), ("text", pa.string()), ("unified", pa.string()), ("altered", pa.bool_())])


def _flat_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    import numpy as np

    for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        ids = np.asarray(b.column(0).fill_null(-1))
        page, blocks = _flatten(b.column(1))
        owner, spans = _flatten(blocks.field("spans"))
        starts = np.r_[0, np.cumsum(np.bincount(page, minlength=b.num_rows))].astype(np.int64)
        span_starts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(page)))].astype(np.int64)
        pos = np.arange(len(page)) - starts[page]
        n = len(owner)
        yield pa.table({
            "record": pa.array(["page"] * n, pa.string()),
            "record_id": pa.array(ids[page][owner], pa.int64()),
            "pos": pa.array(pos[owner], pa.int64()),
            "span_pos": pa.array(np.arange(n) - span_starts[owner], pa.int64()),
            "text": spans.field("text"),
        })


def unify_pages(pages: DataFrame, only_altered: bool = False) -> DataFrame:
    """Every span of every page (tables' cells excluded) in one form. ``pages``: page_id and blocks.spans.text."""
    return pages.select("page_id", "blocks").mapInArrow(lambda it: _run(_flat_pages(it), only_altered), SCHEMA)


def unify_chunks(chunks: DataFrame, only_altered: bool = False) -> DataFrame:
    """Every chunk in one form. ``chunks``: chunk_id and text."""
    flat = chunks.select(F.lit("chunk").alias("record"), F.col("chunk_id").alias("record_id"), F.lit(-1).cast("bigint").alias("pos"), F.lit(-1).cast("bigint").alias("span_pos"), "text")
    return flat.mapInArrow(lambda it: _run((pa.Table.from_batches([b.slice(at, 10 * ROWS)]) for b in it for at in range(0, b.num_rows, 10 * ROWS)), only_altered), SCHEMA)


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p7_found: spans and chunks with a disguised character; a redelivered row counts once."""
    pages = table(spark, data_dir, "page_docs", PAGES)
    chunks = table(spark, data_dir, "chunks", "chunk_id bigint, text string")
    both = unify_pages(pages, True).unionByName(unify_chunks(chunks, True))
    return both.select("record", "record_id", "pos", "span_pos").dropDuplicates()

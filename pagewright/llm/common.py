"""Parts that several operators of this package share: nested-page flattening, text keys, hosts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.tables import table

#: The nested fields of a page that the operators here read.
PAGE_SCHEMA = (
    "page_id bigint, url string, title string, lang string, "
    "blocks array<struct<kind:string,level:int,marker:string,spans:array<struct<text:string,link:int,image:boolean>>,"
    "cell_rows:array<array<array<struct<text:string>>>>,caption:boolean>>"
)

#: Invisible characters that may hide within a word.
INVISIBLE = "­​‌‍⁠﻿"
#: Letters of Greek and Cyrillic that look like a Latin letter, in the order of their code points.
ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ϳ": "j",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Һ": "h",
}
#: The Cyrillic look-alike of a Latin letter, for words that are Cyrillic otherwise.
ALIKE_CYRILLIC = {v: k for k, v in ALIKE.items() if "Ѐ" <= k <= "ӿ" and k not in "ԁԛԝӏҺһѕіјЅІЈ"}

_HIDDEN = re.compile(f"[{INVISIBLE}]")
_LATIN = "A-Za-zÀ-ɏ"
_OTHER = "Ͱ-ϿЀ-ԯ"
_MIXED = re.compile(f"[{_LATIN}][{_OTHER}]|[{_OTHER}][{_LATIN}]")
_MIXED_WORD = re.compile(f"[{_LATIN}{_OTHER}]+")
_ALL_LATIN, _ALL_OTHER = re.compile(f"[{_LATIN}]"), re.compile(f"[{_OTHER}]")
_TO_LATIN = str.maketrans(ALIKE)
_TO_CYRILLIC = str.maketrans(ALIKE_CYRILLIC)


def _unmix(m: re.Match) -> str:
    """A word of mixed scripts in the script of its unmistakable letters, else in that of most of its text."""
    w = m.group()
    latin, other = _ALL_LATIN.findall(w), _ALL_OTHER.findall(w)
    if not latin or not other:
        return w
    to_latin = all(c in ALIKE for c in other)
    to_cyrillic = all(c in ALIKE_CYRILLIC for c in latin)
    if to_cyrillic and to_latin:
        to_latin = len(_ALL_LATIN.findall(m.string)) >= len(_ALL_OTHER.findall(m.string))
    return w.translate(_TO_LATIN if to_latin or not to_cyrillic else _TO_CYRILLIC)


def fold(text: str) -> str:
    """The ordinary form of a text: compatibility forms, invisible characters and look-alike letters undone."""
    if text.isascii():
        return text
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return _MIXED_WORD.sub(_unmix, text) if _MIXED.search(text) else text


_LOWER = bytes(range(256)).lower()
_NO_LETTERS = bytes(c for c in range(256) if not chr(c).isalpha() or c > 127)
_SIGNS = re.compile("[№™℃℉℠℡]")  # signs whose compatibility form is letters
_NOT_LETTER = re.compile("[^\\wัิ-ฺ็-๎]+|[\\d_]+")


def line_key(text: str) -> str:
    """What two lines must share to be the same line: their letters, in lower case, of the folded text; '' without letters."""
    if text.isascii():
        return text.encode().translate(_LOWER, _NO_LETTERS).decode()
    return _NOT_LETTER.sub("", fold(_SIGNS.sub("", text)).casefold())


_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.I)
_BARE = re.compile(r"^\s*([^/?#:\s]+\.[^/?#:\s]+)(?:[:/?#]|$)")


@lru_cache(1 << 16)
def _host(netloc: str) -> str | None:
    host = netloc.lower().strip().rstrip(".")
    return (host[4:] if host.startswith("www.") else host) or None


def host_of(url: str | None) -> str | None:
    """The host that a url names, without case, ``www.``, port and user; None for a null or unusable url."""
    m = url and (_HOST.match(url) or _BARE.match(url))
    return _host(m.group(1)) if m else None


class Flat:
    """The blocks of a batch of pages as flat arrays.

    ``page[b]`` is the row of block b in the batch, ``pos[b]`` its index; ``text[b]`` its spans' texts joined,
    ``linked[b]`` the characters of linked spans, ``n[b]`` the characters of all spans, ``image[b]`` whether a
    span is an image. Null lists and null texts count as empty.
    """

    def __init__(self, batch: pa.RecordBatch):
        col = batch.column(batch.schema.get_field_index("blocks"))
        self.page, blocks = _flatten(col)
        starts = np.r_[0, np.cumsum(np.bincount(self.page, minlength=len(col)))] if len(self.page) else np.zeros(len(col) + 1, np.int64)
        self.starts = starts
        self.pos = np.arange(len(self.page)) - starts[self.page] if len(self.page) else np.zeros(0, np.int64)
        self.kind = blocks.field("kind").to_pylist()
        self.level = np.asarray(pc.fill_null(blocks.field("level"), 0))
        self.marker = blocks.field("marker").to_pylist()
        owner, spans = _flatten(blocks.field("spans"))
        self.span_block = owner
        texts = pc.fill_null(spans.field("text"), "")
        self.span_texts = texts.to_pylist()
        self.span_linked = pc.is_valid(spans.field("link")).to_pylist()
        size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        link = np.asarray(pc.is_valid(spans.field("link")))
        image = np.asarray(pc.fill_null(spans.field("image"), False))
        count = len(self.page)
        self.n = np.bincount(owner, size, count).astype(np.int64)
        self.linked = np.bincount(owner, size * link, count).astype(np.int64)
        self.span_image = image
        self.image = np.bincount(owner, image, count) > 0
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=count))].astype(int).tolist()
        st = self.span_texts
        self.span_starts = ends
        self.text = [st[a] if b - a == 1 else "".join(st[a:b]) for a, b in zip(ends, ends[1:])]
        names = [f.name for f in blocks.type]
        self.caption = pc.fill_null(blocks.field("caption"), False).to_pylist() if "caption" in names else [False] * count
        self.rows = blocks.field("cell_rows") if "cell_rows" in names else None
        self._cells: tuple | None = None

    def table_text(self, b: int) -> str:
        """The cells of a table block: a line for each row, cells apart by a tab."""
        if self.rows is None:
            return ""
        if self._cells is None:  # all tables of the batch are taken apart at once
            row_ends, rows = _ends(self.rows)
            cell_ends, cells = _ends(rows)
            span_ends, spans = _ends(cells)
            self._cells = row_ends, cell_ends, span_ends, pc.fill_null(spans.field("text"), "").to_pylist()
        row_ends, cell_ends, span_ends, texts = self._cells
        lines = []
        for r in range(row_ends[b], row_ends[b + 1]):
            cells = (texts[span_ends[c]] if span_ends[c + 1] - span_ends[c] == 1 else "".join(texts[span_ends[c] : span_ends[c + 1]]) for c in range(cell_ends[r], cell_ends[r + 1]))
            lines.append("\t".join(cells))
        return "\n".join(lines)


def _ends(col: pa.Array) -> tuple[list[int], pa.Array]:
    """Where each list of a column begins and ends among the flattened values; a null list is empty."""
    owner, values = _flatten(col)
    return np.r_[0, np.cumsum(np.bincount(owner, minlength=len(col)))].astype(int).tolist(), values


def _flatten(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(pc.list_parent_indices(col)).astype(np.int64), pc.list_flatten(col)


def pages(spark: SparkSession, data_dir: str, schema: str = PAGE_SCHEMA) -> DataFrame:
    """The pages with the nested fields of ``schema`` only."""
    return table(spark, data_dir, "page_docs", schema)

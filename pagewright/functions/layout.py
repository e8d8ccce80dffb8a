"""Text laid out in cells of a terminal: widths, breaking and cutting."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

READING_WIDTH = 80
# fixed values: Japanese signs that do not begin a line, and signs that do not end one
NO_START = "、。，．・：；？！゛゜ヽヾゝゞ々ー」』）】〕］｝〉》ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ"
NO_END = "「『（【〔［｛〈《"


@lru_cache(1 << 14)
def char_width(c: str) -> int:
    """0 for marks and joiners, 2 for wide and full-width characters, else 1."""
    if c in "​‍️" or unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" or 0x1F300 <= ord(c) <= 0x1FAFF else 1


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(map(char_width, text))


def clusters(text: str) -> list[str]:
    """Characters with the marks and joined characters that follow them."""
    out: list[str] = []
    for c in text:
        if out and (char_width(c) == 0 or out[-1].endswith("‍")):
            out[-1] += c
        else:
            out.append(c)
    return out


def truncate(text: str, cells: int) -> str:
    """At most ``cells`` wide, with an ellipsis if something is cut."""
    if width(text) <= cells:
        return text
    out, used = "", 0
    for c in clusters(text):
        if used + width(c) > cells - 1:
            break
        out, used = out + c, used + width(c)
    return out + "…"


def words(text: str) -> list[str]:
    """Units that a line keeps whole: runs of narrow letters with the blanks after them, single wide characters."""
    out: list[str] = []
    for c in clusters(text):
        wide = width(c) == 2
        joins = out and not wide and not out[-1][-1].isspace() and width(out[-1][-1]) < 2 and not c.isspace()
        if out and (joins or c.isspace() or c in NO_START or out[-1][-1] in NO_END):
            out[-1] += c
        else:
            out.append(c)
    return out


def wrap(text: str, cells: int = READING_WIDTH) -> list[str]:
    """Lines of at most ``cells``, broken between words; a closing sign never begins a line, an opening one never ends it."""
    lines: list[str] = []
    for paragraph in text.split("\n"):
        line, used = "", 0
        for w in words(paragraph):
            bare = width(w.rstrip())
            if line and used + bare > cells:
                lines.append(line.rstrip())
                line, used = "", 0
            while bare > cells:
                head, n = "", 0
                for c in clusters(w):
                    if n + width(c) > cells:
                        break
                    head, n = head + c, n + width(c)
                lines.append(head)
                w = w[len(head) :]
                bare = width(w.rstrip())
            line, used = line + w, used + width(w)
        lines.append(line.rstrip())
    return lines


def hint_labels(count: int, letters: str = "asdfghjklqweru") -> list[str]:
    """Labels of which none begins another, as short as they can be."""
    queue, at = [""], 0
    while len(queue) - at < count or len(queue) == 1:
        first = queue[at]
        at += 1
        queue.extend(first + c for c in letters)
    return sorted(queue[at : at + count])


@F.arrow_udf(T.IntegerType())
def cell_width(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else width(t) for t in text.to_pylist()], pa.int32())


@F.arrow_udf(T.ArrayType(T.StringType()))
def wrapped(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else wrap(t) for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def shortened(text: pa.Array, cells: pa.Array) -> pa.Array:
    return pa.array([None if t is None or n is None else truncate(t, n) for t, n in zip(text.to_pylist(), cells.to_pylist())], pa.string())

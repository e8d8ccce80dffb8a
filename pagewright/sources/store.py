"""Saved lists of items and translation replies as JSON, read with fixed schemas that tolerate missing fields."""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import SPACE_BEFORE_CLOSE, strip

_BEFORE_CLOSE = re.compile(SPACE_BEFORE_CLOSE)

ITEM = "kind string, target string, title string, time double"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a saved list: one object per line or one array; what cannot be read gives no item."""
    raw = spark.read.schema(ITEM).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.select(F.coalesce("kind", F.lit("url")).alias("kind"), F.coalesce("target", F.lit("")).alias("target"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("time", F.lit(0.0)).alias("time")).where("target <> ''")


def write_items(items: DataFrame, path: str) -> None:
    """A list in its order; readers see the old or the new one, never a part."""
    items.write.mode("overwrite").json(path)


def reply_texts(reply: Column) -> Column:
    """The texts of a translation reply: an array of texts or of pairs of text and language."""
    pairs = F.from_json(reply, "array<array<string>>")
    plain = F.from_json(reply, "array<string>")
    first = F.transform(pairs, lambda p: F.get(p, F.lit(0)))
    return F.when(F.forall(first, lambda t: t.isNotNull()) & (F.size(first) > 0), first).otherwise(plain)


def reply_pairs(reply: Column) -> Column:
    """array<struct<text,lang>> of a translation reply; the language is null where none was told."""
    pairs = F.from_json(reply, "array<array<string>>")
    told = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("text"), F.get(p, F.lit(1)).alias("lang")))
    plain = F.transform(F.from_json(reply, "array<string>"), lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("lang")))
    return F.when(F.forall(pairs, lambda p: p.isNotNull()) & (F.size(pairs) > 0), told).otherwise(plain)


def is_of_use(text: Column, lang: Column, target: str) -> Column:
    """Whether a translation replaces its original: it says something, and the original was in another language."""
    return ~F.coalesce(lang == target, F.lit(False)) & (F.length(strip(F.coalesce(text, F.lit("")))) > 0)


# fixed values: a marked part of a reply, any mark, and text before which no blank stands
_MARK = re.compile(r"<a\s+i=(\d+)>([^<]*)</a>")
_ANY_MARK = re.compile(r"</?[a-zA-Z][^>]*>")
_CLOSING, _STOPPING = tuple(")]）」』、。"), tuple(",.;:!?")


def unescape(text: str) -> str:
    """The five escapes of a reply undone, the ampersand last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = text.replace(a, b)
    return text


def _closes(text: str) -> bool:
    """Whether a text begins with a sign that follows what is before it: a closing one, or a stop that ends something."""
    text = text.lstrip()
    return text.startswith(_CLOSING) or text.startswith(_STOPPING) and (len(text) == 1 or text[1].isspace() or text[1] in string.punctuation)


def tidied(parts: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Parts of a reply without blanks before closing signs, within a part and across parts; empty parts go."""
    texts = [t for _, t in parts]
    for i, t in enumerate(texts):
        if i and _closes(t):
            texts[i] = t.lstrip()
            for j in range(i - 1, -1, -1):
                texts[j] = texts[j].rstrip()
                if texts[j]:
                    break
    texts = [_BEFORE_CLOSE.sub(r"\1", t) for t in texts]
    return [(i, t) for (i, _), t in zip(parts, texts) if t]


def reply_parts(reply: str, groups: int) -> list[tuple[int, str]]:
    """(style group, text) of a reply's parts in its own order; -1 for text outside of marks or with a mark of no group.
    A block of one style has one part, whatever marks are in it."""
    bare = lambda t: unescape(_ANY_MARK.sub("", t))
    if groups <= 1:
        return tidied([(0, bare(reply))])
    parts: list[tuple[int, str]] = []
    done = 0
    for m in _MARK.finditer(reply):
        parts.append((-1, bare(reply[done : m.start()])))
        parts.append((int(m.group(1)) if int(m.group(1)) < groups else -1, unescape(m.group(2))))
        done = m.end()
    parts.append((-1, bare(reply[done:])))
    marked = {n for n, _ in parts if n >= 0}
    return tidied([p for p in parts if p[1] or p[0] in marked])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("text", T.StringType())])))
def reply_spans(reply: pa.Array, groups: pa.Array) -> pa.Array:
    """array<struct<i,text>>: the parts of each reply to a block of so many style groups."""
    out = [None if r is None else [{"i": i, "text": t} for i, t in reply_parts(r, n or 0)] for r, n in zip(reply.to_pylist(), groups.to_pylist())]
    return pa.array(out, pa.list_(pa.struct([("i", pa.int32()), ("text", pa.string())])))

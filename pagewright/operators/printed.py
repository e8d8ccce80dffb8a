"""Text of printed pages: vocabulary, hyphens at line ends, paragraphs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import strip

# fixed values: signs that end a sentence at a line's end, and the length of a line that fills its column
SENTENCE_END = r"[。.．！!？?：:」』）)]$"
SHORT_LINE = 40


def in_document() -> WindowSpec:
    """A document's lines in their order."""
    return W.partitionBy("doc_id").orderBy("line_no")


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every document, at any kind of line break."""
    return documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")).alias("line_no", "line"))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(doc_id, word): the words of ASCII letters, of two letters at least, in lower case."""
    words = documents.select("doc_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("word"))
    return words.where(F.length("word") > 1).select("doc_id", F.lower("word").alias("word")).distinct()


def hyphens(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, left, right, joined): words parted at a line end before a small letter; joined if the document
    has the whole word elsewhere, else the hyphen stays."""
    ls = lines(documents)
    nxt = ls.withColumn("below", F.lead("line").over(in_document()))
    cut = nxt.withColumn("left", F.regexp_extract("line", "([A-Za-z]+)-$", 1)).withColumn("right", F.regexp_extract("below", "^([a-z][A-Za-z]*)", 1)).where("left <> '' AND right <> ''")
    cut = cut.withColumn("word", F.lower(F.concat("left", "right")))
    return cut.join(vocabulary(documents).withColumn("known", F.lit(True)), ["doc_id", "word"], "left").select("doc_id", "line_no", "left", "right", F.when(F.col("known"), F.concat("left", "right")).otherwise(F.concat("left", F.lit("-"), "right")).alias("joined"))


# fixed values: Japanese signs and letters, and signs that end a sentence of them
_JAPANESE = re.compile("[、-ヿ㐀-鿿\uf900-\ufaff！-￯]")
_ENDS = "。．！？!?」』）)"
_HYPHENED = re.compile(r"([A-Za-z]+)-$")
_GOES_ON = re.compile("[a-z][A-Za-z]*")


def joined(text: str) -> str:
    """A printed text whose wrapped lines are joined: an empty line within Japanese that follows a full line goes, and a
    word parted by a hyphen is one word again, without the hyphen if the text has that word elsewhere."""
    rows = text.split("\n")
    lengths = sorted(len(r.strip()) for r in rows if r.strip())
    full = lengths[len(lengths) // 2] * 4 // 5 if lengths else 0  # most of the usual length of a line
    words = {w.lower() for w in re.findall("[A-Za-z]{2,}", text)}
    out: list[str] = []
    for i, row in enumerate(rows):
        below = rows[i + 1].strip() if i + 1 < len(rows) else ""
        above = out[-1].strip() if out else ""
        if not row.strip() and above and below:
            japanese = _JAPANESE.match(above[-1]) or _JAPANESE.match(below[0])
            if japanese and above[-1] not in _ENDS and len(above) >= full:
                continue
        cut = _HYPHENED.search(out[-1].rstrip()) if out else None
        rest = _GOES_ON.match(row.lstrip())
        if cut and rest:
            kept = out[-1].rstrip()
            if (cut.group(1) + rest.group()).lower() in words:
                kept = kept[:-1]
            out[-1] = kept + row.lstrip()
        else:
            out.append(row)
    return "\n".join(out)


@F.arrow_udf(T.StringType())
def joined_lines(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else joined(t) for t in text.to_pylist()], pa.string())


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, par_no, text): lines joined, by a blank between ASCII characters; broken at empty lines and after a
    short line that ends a sentence."""
    ls = lines(documents).withColumn("line", strip(F.col("line")))
    before = F.lag("line").over(in_document())
    new = before.isNull() | (before == "") | ((F.length(before) < SHORT_LINE) & before.rlike(SENTENCE_END))
    ls = ls.withColumn("before", before).withColumn("new", new)
    ls = ls.withColumn("par", F.sum((F.col("new") & (F.col("line") != "")).cast("int")).over(in_document())).where("line <> ''")
    gap = F.when(F.col("before").rlike(r"[\x00-\x7F]$") & F.col("line").rlike(r"^[\x00-\x7F]") & ~F.col("new"), F.lit(" ")).otherwise(F.lit(""))
    p = ls.groupBy("doc_id", "par").agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat(gap, "line").alias("t")))).alias("l"))
    return p.select("doc_id", (F.col("par") - 1).alias("par_no"), F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))

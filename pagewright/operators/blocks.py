"""Blocks of pages as a relation, and the operators that read them in order.

The working form is one row per block: (page_id, pos, kind, level, marker, spans, rows, text, ...). Redelivered pages
repeat their content, so a page's rows are the same whichever delivery they come from; ``page_blocks`` keeps one and
shuffles no page for it but the redelivered.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import text as X
from pagewright.plans.stages import once


#: Characters of a shingle.
SHINGLE = 4


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")


def block_text(spans: Column, rows: Column) -> Column:
    """Spans joined; of a table the cells joined by a blank, the rows by a slash."""
    cell = lambda c: joined(c)
    table = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), " ")), " / ")
    return F.coalesce(F.when(rows.isNotNull(), table), joined(spans), F.lit(""))


def image_only(spans: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: s["image"]) & F.forall(spans, lambda s: s["image"] | (X.solid_length(F.coalesce(s["text"], F.lit(""))) == 0)), F.lit(False))


def page_blocks(pages: DataFrame, *more: str) -> DataFrame:
    """One row per block of each page, once per page."""
    b = once(pages.select("page_id", *more, "blocks"), "page_id").select("page_id", *more, F.posexplode("blocks").alias("pos", "b"))
    out = b.select("page_id", *more, "pos", F.col("b.kind").alias("kind"), F.coalesce("b.level", F.lit(0)).alias("level"), F.coalesce("b.marker", F.lit("")).alias("marker"), F.col("b.spans").alias("spans"), F.col("b.cell_rows").alias("rows"))
    return out.withColumn("text", block_text(F.col("spans"), F.col("rows")))


def in_page() -> WindowSpec:
    """A page's blocks in their order."""
    return W.partitionBy("page_id").orderBy("pos")


def linked_chars(spans: Column, images: bool = True) -> Column:
    """Characters of linked spans."""
    keep = F.filter(spans, lambda s: s["link"].isNotNull() & (F.lit(True) if images else ~F.coalesce(s["image"], F.lit(False))))
    return F.aggregate(keep, F.lit(0), lambda a, s: a + F.length(F.coalesce(s["text"], F.lit(""))))


def is_body(kind: Column, spans: Column, speak: Column) -> Column:
    """Whether a block is read aloud: words, no trail of links, less than half linked; headings always."""
    words = speak.rlike(r"\p{L}") & ~speak.rlike(X.BREADCRUMB_END)
    share = linked_chars(spans, images=False) / F.greatest(F.length(speak), F.lit(1))
    return kind.isin("h", "p", "li", "quote") & words & ((kind == "h") | (share < 0.5))


def title_parts(title: Column) -> Column:
    """The title and its parts around a separator, normalised, of four characters at least."""
    parts = F.concat(F.array(title), F.split(title, X.TITLE_SEPARATOR))
    return F.filter(F.transform(parts, X.norm), lambda p: F.length(p) >= 4)


def dedupe(blocks: DataFrame, window: int = 10) -> DataFrame:
    """Blocks without repeats of the title among the first ``window`` and without equal neighbours.

    If several of the first blocks equal the title or a part of it, only the best heading of them stays (none if none
    is a heading). Then of consecutive equal blocks the first stays; empty ones neither go nor end a run's comparison.
    """
    b = blocks.withColumn("norm", X.norm(F.col("text")))
    hit = (F.col("pos") < window) & F.array_contains(title_parts(F.coalesce("title", F.lit(""))), F.col("norm"))
    b = b.withColumn("hit", hit)
    per_page = W.partitionBy("page_id")
    b = b.withColumn("hits", F.sum(F.col("hit").cast("int")).over(per_page))
    best = F.min(F.when(F.col("hit") & (F.col("kind") == "h"), F.struct("level", "pos"))).over(per_page)
    b = b.withColumn("best", best["pos"])
    b = b.where(~F.col("hit") | (F.col("hits") < 2) | (F.col("pos") == F.col("best")))
    before = F.lag("norm").over(in_page())
    return b.withColumn("before", before).where(F.col("before").isNull() | (F.col("norm") == "") | (F.col("norm") != F.col("before"))).drop("hit", "hits", "best", "before", "norm")


def renumbered_links(pages: DataFrame) -> DataFrame:
    """(page_id, link_no, url): the links that spans and cells use, numbered densely in the order of first use."""
    none = F.array().cast("array<int>")
    per_block = F.transform("blocks", lambda b: F.concat(F.coalesce(b["spans"]["link"], none), F.coalesce(F.flatten(F.flatten(b["cell_rows"]))["link"], none)))
    spans = F.flatten(per_block)
    used = F.array_distinct(F.filter(spans, lambda x: x.isNotNull()))
    rows = once(pages.select("page_id", "links", "blocks"), "page_id").select("page_id", "links", F.posexplode(used).alias("link_no", "old"))
    return rows.select("page_id", "link_no", F.get("links", F.col("old")).alias("url"))


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with ``in_tail``: whether they lie in a closing section (references, notes, see also, ...), which lasts to
    the next heading of its level or above."""
    tail = (F.col("kind") == "h") & F.col("text").rlike(X.TAIL_SECTION)
    # the innermost open tail section of each level; headings above it close it
    b = blocks.withColumn("tail", tail)
    inside = F.lit(False)
    for level in range(1, 7):
        last_close = F.max(F.when((F.col("kind") == "h") & (F.col("level") <= level), F.col("pos"))).over(in_page())
        last_tail = F.max(F.when(F.col("tail") & (F.col("level") == level), F.col("pos"))).over(in_page())
        inside = inside | F.coalesce(last_tail == last_close, F.lit(False))
    return b.withColumn("in_tail", inside).drop("tail")


def readable(blocks: DataFrame) -> DataFrame:
    """Blocks that are read aloud, with ``speak``: bodies outside closing sections; a heading only if a heading below its
    level, or a body, follows before the next of its level or above."""
    b = sections(blocks).withColumn("speak", X.speakable(F.col("spans")))
    b = b.withColumn("body", is_body(F.col("kind"), F.col("spans"), F.col("speak")) & ~F.col("in_tail"))
    heading = F.col("kind") == "h"
    # what follows a heading up to the next one of any level; if that is below it, the heading has a section of its own
    b = b.withColumn("section", F.sum(heading.cast("int")).over(in_page()))
    b = b.withColumn("filled", F.max(F.col("body") & ~heading).over(W.partitionBy("page_id", "section")))
    next_level = F.first(F.when(heading, F.col("level")), ignorenulls=True).over(in_page().rowsBetween(1, W.unboundedFollowing))
    b = b.withColumn("next_level", next_level)
    keep = F.col("body") & (~heading | F.col("filled") | F.coalesce(F.col("next_level") > F.col("level"), F.lit(False)))
    return b.where(keep).drop("section", "filled", "next_level", "body", "in_tail")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def places_in_view(body: pa.Array, shown: pa.Array) -> pa.Array:
    """For each page the place in ``shown`` of every text of ``body``: the first equal one after the one before; null if
    there is none."""
    out = []
    for texts, view in zip(body.to_pylist(), shown.to_pylist()):
        where: dict[str, list[int]] = {}
        for i, t in enumerate(view or []):
            where.setdefault(t, []).append(i)
        places, at = [], 0
        for t in texts or []:
            found = where.get(t, [])
            i = bisect_left(found, at)
            places.append(found[i] if i < len(found) else None)
            at = places[-1] + 1 if i < len(found) else at
        out.append(places)
    return pa.array(out, pa.list_(pa.int32()))


def max_run(weighted: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, first, last, best): the contiguous run of rows (key, pos, weight) with the greatest sum, none if not above 0.

    Of equal runs the one that ends first, and of those the one that starts last. Prefix sums and one running minimum.
    """
    w = W.partitionBy(key).orderBy("pos")
    p = weighted.withColumn("p", F.sum("weight").over(w.rowsBetween(W.unboundedPreceding, 0)))
    p = p.withColumn("q", F.col("p") - F.col("weight"))  # the sum before this row
    least = F.min(F.struct(F.col("q"), -F.col("pos"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    p = p.withColumn("start", -least["col2"]).withColumn("run", F.col("p") - least["q"])
    best = p.groupBy(key).agg(F.max_by(F.struct("start", "pos", "run"), F.struct("run", -F.col("pos"))).alias("m"))
    return best.where("m.run > 0").select(key, F.col("m.start").alias("first"), F.col("m.pos").alias("last"), F.col("m.run").alias("best"))


def _runs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(points: np.ndarray) -> np.ndarray:
    """The runs of four characters as one number each, of characters that fit 16 bits."""
    a = points.astype(np.uint64)
    return a[:-3] << np.uint64(48) | a[1:-2] << np.uint64(32) | a[2:-1] << np.uint64(16) | a[3:] if len(a) >= SHINGLE else np.zeros(0, np.uint64)


def _hits(texts: list, ref: str) -> list[tuple[int, int]]:
    """For each text its runs of ``SHINGLE`` characters, and how many of them occur in a reference text."""
    sizes = [len(t) if t else 0 for t in texts]
    total = [max(n - SHINGLE + 1, 0) for n in sizes]
    if len(ref) < SHINGLE or not any(total):
        return [(n, 0) for n in total]
    own, other = _runs("".join(t for t in texts if t)), _runs(ref)
    if max(own.max(), other.max()) > 0xFFFF:  # a page has fewer different characters than that
        both = np.unique(np.concatenate([own, other]), return_inverse=True)[1]
        own, other = both[: len(own)], both[len(own) :]
    known, keys = np.unique(_packed(other)), _packed(own)
    hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
    before = np.r_[0, np.cumsum(hit)].tolist()
    starts = accumulate([0, *sizes])
    return [(n, before[at + n] - before[at] if n else 0) for at, n in zip(starts, total)]


_COVER = T.ArrayType(T.StructType([T.StructField("shingles", T.LongType()), T.StructField("matched", T.LongType())]))


def _cover_array(pages: list[list[tuple[int, int]]]) -> pa.Array:
    offsets = pa.array([0, *accumulate(map(len, pages))], pa.int32())
    total, matched = ([x[i] for p in pages for x in p] for i in (0, 1))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(matched, pa.int64())], ["shingles", "matched"]))


@F.arrow_udf(_COVER)
def _covered(norms: pa.Array, refs: pa.Array) -> pa.Array:
    return _cover_array([_hits(texts or [], ref or "") for texts, ref in zip(norms.to_pylist(), refs.to_pylist())])


def _own_reference(norms: list, chosen: list, least: int = 50) -> str:
    """The chosen texts of a page after one another, if they have ``least`` characters."""
    ref = "".join(t for t, c in zip(norms, chosen) if c and t)
    return ref if len(ref) >= least else ""


@F.arrow_udf(_COVER)
def page_coverage(norms: pa.Array, chosen: pa.Array) -> pa.Array:
    """For each block of a page how many of its runs of characters occur in the page's own chosen blocks; the page is one
    row, so nothing is shuffled."""
    return _cover_array([_hits(n or [], _own_reference(n or [], c or [])) for n, c in zip(norms.to_pylist(), chosen.to_pylist())])


def heaviest_run(weights: list[int]) -> tuple[int, int, int] | None:
    """(first, last, sum) of the contiguous run with the greatest sum above 0: of equal ones the first to end, and of
    those the last to start."""
    best, total, start = None, 0, 0
    for i, w in enumerate(weights):
        if total <= 0:
            total, start = 0, i
        total += w
        if total > (best[2] if best else 0):
            best = (start, i, total)
    return best


@F.arrow_udf(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("best", T.LongType())]))
def page_run(norms: pa.Array, chosen: pa.Array) -> pa.Array:
    """The run of a page's blocks that its own chosen blocks cover best; null if there is none."""
    out = []
    for n, c in zip(norms.to_pylist(), chosen.to_pylist()):
        n = n or []
        weights = [0 if not total else len(t) if hit * 2 >= total else -len(t) for t, (total, hit) in zip(n, _hits(n, _own_reference(n, c or [])))]
        run = heaviest_run(weights)
        out.append(None if run is None else dict(zip(("first", "last", "best"), run)))
    return pa.array(out, pa.struct([("first", pa.int64()), ("last", pa.int64()), ("best", pa.int64())]))


def coverage(blocks: DataFrame, reference: DataFrame) -> DataFrame:
    """(page_id, pos, shingles, matched): how many of a block's runs of four characters occur in its page's reference
    text. ``reference``: (page_id, ref). The texts of a page meet in one row, so no run is ever shuffled."""
    page = blocks.groupBy("page_id").agg(F.collect_list(F.struct("pos", "norm")).alias("l"))  # bounded by the page
    both = page.join(reference.select("page_id", "ref"), "page_id", "left")
    rows = both.select("page_id", F.explode(F.arrays_zip(F.col("l.pos").alias("pos"), _covered(F.col("l.norm"), F.col("ref")).alias("c"))).alias("x"))
    return rows.select("page_id", F.col("x.pos").alias("pos"), F.col("x.c.shingles").alias("shingles"), F.col("x.c.matched").alias("matched")).where("shingles > 0")


STYLE = ("bold", "code", "image", "italic", "strike", "minor", "translated")


def grouped(spans: Column) -> Column:
    """array<struct<style,text>>: adjacent spans of one style merged, in one pass over a block's own array."""
    fields = "".join(f", {k}: boolean" for k in STYLE)
    none = F.expr(f"cast(array() as array<struct<style: struct<link: int{fields}, src: string>, text: string>>)")

    def add(groups: Column, s: Column) -> Column:
        style = F.struct(F.coalesce(s["link"], F.lit(-1)).alias("link"), *[F.coalesce(s[k], F.lit(False)).alias(k) for k in STYLE], F.coalesce(s["src"], F.lit("")).alias("src"))
        last = F.try_element_at(groups, F.lit(-1))
        text = F.coalesce(s["text"], F.lit(""))
        joined = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.struct(last["style"].alias("style"), F.concat(last["text"], text).alias("text"))))
        return F.when((F.size(groups) > 0) & (last["style"] == style), joined).otherwise(F.concat(groups, F.array(F.struct(style.alias("style"), text.alias("text")))))

    return F.when(F.size(spans) > 0, F.aggregate(spans, none, add))


def style_groups(blocks: DataFrame) -> DataFrame:
    """(page_id, pos, group_no, text): adjacent spans of one style merged."""
    g = blocks.select("page_id", "pos", F.posexplode(grouped(F.col("spans"))).alias("group_no", "g"))
    return g.select("page_id", "pos", "group_no", F.col("g.text").alias("text"))


def request(groups: Column) -> Column:
    """What is sent to a translator for a block of ``grouped`` spans: its text if it has one style, else its groups in numbered marks."""
    marked = F.array_join(F.transform(groups, lambda x, i: F.concat(F.lit("<a i="), i.cast("string"), F.lit(">"), X.escape(x["text"]), F.lit("</a>"))), "")
    return F.when(F.size(groups) > 1, marked).otherwise(X.escape(X.strip(F.get(groups, F.lit(0))["text"])))


def is_to_translate(text: Column, spans: Column, declared: Column, target: Column) -> Column:
    """Whether a block is translated into a language: it has words, is no picture or address alone, and is not in that
    language; English can't be told by its letters, so the page's label decides."""
    kana, hangul = text.rlike("[\u3041-\u3096\u30a1-\u30fa]"), text.rlike("[\uac00-\ud7a3\u1100-\u11ff\u3131-\u318e]")
    labelled = F.coalesce(F.lower(F.regexp_extract(F.trim(declared), "^([^-_]*)", 1)), F.lit(""))
    there = F.when(target == "ja", kana).when(target == "ko", hangul).otherwise(labelled == target)
    return X.has_letter(text) & ~text.rlike(X.URL_ONLY) & ~image_only(spans) & ~there


def batches(targets: DataFrame, items: int = 50, chars: int = 4000, top: Column | None = None) -> DataFrame:
    """(page_id, pos, batch): requests (column ``request``) in order, a new batch at ``items`` requests or where the
    characters would pass ``chars``; a longer one has its own. With ``top``, those from that place on come first. The
    fold resets, so it runs over each page's ordered array."""
    before = F.lit(False) if top is None else F.col("pos") < top
    entry = F.struct(before.alias("before"), "pos", F.length("request").alias("n"))
    per_page = targets.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    zero = F.expr("named_struct('b', 0, 'k', 0, 'c', 0, 'o', cast(array() as array<struct<pos:int,batch:int>>))")

    def step(a: Column, x: Column) -> Column:
        new = (a["k"] > 0) & ((a["k"] >= items) | (a["c"] + x["n"] > chars))
        b = F.when(new, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(new, 1).otherwise(a["k"] + 1).alias("k"), F.when(new, x["n"]).otherwise(a["c"] + x["n"]).alias("c"), F.concat(a["o"], F.array(F.struct(x["pos"].alias("pos"), b.alias("batch")))).alias("o"))

    out = per_page.select("page_id", F.explode(F.aggregate("l", zero, step)["o"]).alias("x"))
    return out.select("page_id", "x.pos", "x.batch")

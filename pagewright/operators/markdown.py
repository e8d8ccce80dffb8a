"""Pages as Markdown, by one expression per block and an ordered join of the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators.blocks import in_page



def _wrapped(t: Column, mark: str, on: Column) -> Column:
    return F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(mark), t, F.lit(mark))).otherwise(t)


def _span(s: Column, next_link: Column) -> Column:
    t = F.replace(F.coalesce(s["text"], F.lit("")), F.lit("\n"), F.lit("  \n"))
    styled = _wrapped(_wrapped(_wrapped(t, "**", s["bold"]), "*", s["italic"]), "~~", s["strike"])
    body = F.when(F.coalesce(s["code"], F.lit(False)), F.concat(F.lit("`"), t, F.lit("`"))).when(X.solid_length(t) > 0, styled).otherwise(t)
    ends = s["link"].isNotNull() & ~F.coalesce(next_link == s["link"], F.lit(False))
    return F.concat(body, F.when(ends, F.concat(F.lit("["), (s["link"] + 1).cast("string"), F.lit("]"))).otherwise(F.lit("")))


def spans_markdown(spans: Column) -> Column:
    """Spans with their styles, and a reference after the last span of each link."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s, i: _span(s, F.get(spans["link"], i + 1))), ""), F.lit(""))


def _table(rows: Column) -> Column:
    width = F.aggregate(rows, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    cell = lambda c: F.replace(F.replace(spans_markdown(c), F.lit("|"), F.lit("\\|")), F.lit("  \n"), F.lit(" "))
    padded = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(padded(r), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")


def is_numbered(marker: Column) -> Column:
    return marker.rlike(r"^[0-9]+.$")


def block_markdown(kind: Column, level: Column, marker: Column, spans: Column, rows: Column) -> Column:
    md = spans_markdown(spans)
    heading = F.concat(F.repeat(F.lit("#"), F.least(level + 1, F.lit(6))), F.lit(" "), md)
    item = F.concat(F.repeat(F.lit("  "), level), F.when(is_numbered(marker), marker).otherwise("-"), F.lit(" "), md)
    code = F.concat(F.lit("```\n"), F.coalesce(F.get(spans["text"], F.lit(0)), F.lit("")), F.lit("\n```"))
    table = F.when(F.size(rows) > 0, _table(rows)).otherwise(F.lit(None).cast("string"))
    return F.when(kind == "h", heading).when(kind == "li", item).when(kind == "quote", F.concat(F.lit("> "), md)).when(kind == "pre", code).when(kind == "hr", F.lit("---")).when(kind == "table", table).otherwise(md)


def markdown_blocks(blocks: DataFrame) -> DataFrame:
    """(page_id, pos, gap, md): each block's Markdown and whether an empty line stands before it."""
    before = F.lag("kind").over(in_page())
    gap = before.isNotNull() & ~((before == "li") & (F.col("kind") == "li"))
    md = block_markdown(F.col("kind"), F.col("level"), F.col("marker"), F.col("spans"), F.col("rows"))
    return blocks.select("page_id", "pos", gap.alias("gap"), F.coalesce(md, F.lit("")).alias("md"))


def markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown): a page's title, address, blocks and numbered links. One expression over the page's own
    array of blocks, so no block leaves its page's row."""
    none = F.lit("")
    b = lambda x: block_markdown(x["kind"], F.coalesce(x["level"], F.lit(0)), F.coalesce(x["marker"], none), x["spans"], x["cell_rows"])
    kinds = F.col("blocks")["kind"]
    gap = lambda x, i: (i > 0) & ~F.coalesce((F.get(kinds, i - 1) == "li") & (x["kind"] == "li"), F.lit(False)) & ~F.coalesce(x["translation"], F.lit(False))
    body = F.array_join(F.transform("blocks", lambda x, i: F.concat(F.when(gap(x, i), F.lit("\n")).otherwise(none), F.coalesce(b(x), none))), "\n")
    refs = F.array_join(F.transform("links", lambda u, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]: "), u)), "\n")
    tail = F.when(F.size("links") > 0, F.concat(F.lit("\n\n---\n\n"), refs)).otherwise(none)
    head = F.concat(F.lit("# "), F.coalesce("title", none), F.lit("\n<"), F.coalesce("url", none), F.lit(">\n"))
    return pages.select("page_id", F.concat(head, F.when(F.size("blocks") > 0, F.concat(F.lit("\n"), body)).otherwise(none), tail, F.lit("\n")).alias("markdown"))


def indents(blocks: DataFrame, step: int = 2, most: int = 8) -> DataFrame:
    """(page_id, pos, indent): by the rank of a heading's level among the page's levels; text stands below its heading."""
    heads = blocks.where("kind = 'h'").select("page_id", "level").distinct()
    rank = heads.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("level")) - 1)
    b = blocks.select("page_id", "pos", "kind", "level").join(rank, ["page_id", "level"], "left")
    own = F.when(F.col("kind") == "h", F.col("rank"))
    last = F.last(own, ignorenulls=True).over(in_page())
    below = F.when(last.isNull(), 0).otherwise(F.least((last + 1) * step, F.lit(most)))
    return b.select("page_id", "pos", F.when(F.col("kind") == "h", F.least(F.col("rank") * step, F.lit(most))).otherwise(below).cast("int").alias("indent"))


def list_marker(marker: Column, level: Column) -> Column:
    """Numbers by depth (1. a. i.), a hyphen for other signs, none for none."""
    n = F.regexp_extract(marker, "^([0-9]+).$", 1).cast("int")
    numbered = F.when(level == 1, F.concat(X.alpha(n), F.lit("."))).when(level == 2, F.concat(X.roman(n), F.lit("."))).otherwise(marker)
    return F.when(marker == "", "").when(is_numbered(marker), numbered).otherwise("-")

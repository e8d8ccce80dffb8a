"""Queries on HTML: the pages are written as HTML and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.catalog_blocks import BLOCKS, _norm
from pagewright.functions import text as X
from pagewright.operators.page_html import to_html
from pagewright.sources import html as H
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


def _html(spark, d) -> DataFrame:
    return to_html(table(spark, d, "page_docs", f"page_id bigint, url string, title string, lang string, {FULL_BLOCKS}, links array<string>"))


@_query(f"WITH {BLOCKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS pos, kind, {_norm('text')} AS norm FROM blk WHERE kind = 'hr' OR regexp_matches(text, '[^\\s\\x{{A0}}\\x{{3000}}]')")
def html_blocks(spark, d):
    """The blocks read back from each page's HTML: their kinds and their letters."""
    b = H.blocks(_html(spark, d), whole=True)
    return b.select("page_id", F.col("pos").cast("bigint"), "kind", X.norm(F.col("text")).alias("norm"))


@_query("SELECT DISTINCT page_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title, coalesce(lang, '') AS lang FROM page_docs")
def html_titles(spark, d):
    """Title and language read back from each page's head."""
    b = H.blocks(_html(spark, d), whole=True).groupBy("page_id").agg(F.first("title").alias("title"), F.first("lang").alias("lang"))
    return b.select("page_id", "title", "lang")


_KINDS = "CASE kind WHEN 'quote' THEN 'blockquote' WHEN 'h' THEN 'h' ELSE kind END"


@_query(f"WITH {BLOCKS} SELECT page_id, {_KINDS} AS tag, CAST(count(*) AS BIGINT) AS n FROM blk WHERE kind IN ('h', 'li', 'quote', 'hr', 'pre', 'table') GROUP BY ALL")
def html_node_counts(spark, d):
    """Elements by tag."""
    n = H.nodes(_html(spark, d)).withColumn("tag", F.when(F.col("tag").rlike("^h[1-6]$"), "h").otherwise(F.col("tag")))
    return n.where(F.col("tag").isin("h", "li", "blockquote", "hr", "pre", "table")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@_query()
def html_link_density(spark, d):
    """Characters and linked characters of every list and landmark, by interval sums."""
    t = H.subtree_totals(H.nodes(_html(spark, d)))
    return t.where(F.col("tag").isin("body", "ul", "ol", "table", "p", "blockquote")).select("page_id", "node_id", "tag", "chars", "linked")


@_query()
def html_main_blocks(spark, d):
    """The main element's blocks of every page."""
    return H.blocks(_html(spark, d)).select("page_id", F.col("pos").cast("bigint"), "kind", "text")


@_query()
def html_roots(spark, d):
    """Per page the deepest element that still holds half of its text."""
    n = H.nodes(_html(spark, d))
    t = H.subtree_totals(n).join(n.select("page_id", "node_id", "depth"), ["page_id", "node_id"])
    whole = F.max("chars").over(W.partitionBy("page_id"))
    return t.withColumn("whole", whole).where("chars * 2 >= whole").groupBy("page_id").agg(F.max_by("tag", F.struct("depth", -F.col("node_id"))).alias("tag"), F.max("depth").cast("bigint").alias("depth"))

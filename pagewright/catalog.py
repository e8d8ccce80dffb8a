"""All queries of the engine's own operators, by name, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright import catalog_blocks, catalog_html, catalog_pages, catalog_state, catalog_text, catalog_urls
from pagewright.operators.markdown import markdown
from pagewright.plans.stages import once
from pagewright.sources.tables import FULL_BLOCKS, table

_PARTS = (catalog_urls, catalog_blocks, catalog_html, catalog_pages, catalog_text, catalog_state)


def flagship(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every page as Markdown, once."""
    pages = table(spark, data_dir, "page_docs", f"page_id bigint, url string, title string, {FULL_BLOCKS}, links array<string>")
    return markdown(once(pages, "page_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"page_markdown": flagship}
    for part in _PARTS:
        out |= part.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}

"""Small tables for the tests."""

from __future__ import annotations

SPAN = "struct<text:string,link:int,image:boolean>"
PAGES = f"page_id bigint, url string, title string, lang string, blocks array<struct<kind:string,level:int,marker:string,spans:array<{SPAN}>,cell_rows:array<array<array<struct<text:string>>>>,caption:boolean>>, site bigint, key string, low boolean"


def block(kind, text, level=0, marker=None, link=None, rows=None, caption=False):
    spans = None if text is None else [(text, link, False)]
    return (kind, level, marker, spans, rows, caption)


def page(page_id, blocks, url="https://a.example/x/p", title="T", lang="en"):
    return (page_id, url, title, lang, blocks, 7, "clash", True)


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def sites(spark, rows=(("a.example", "The Alpha Notes", "en"),)):
    return spark.createDataFrame(list(rows), "host string, site_name string, lang string")


ODD_BLOCKS = [None, (None, None, None, None, None, None), block("p", None), block("p", ""), block("hr", ""), block("table", "", rows=[[[("a",)], None], None]), ("p", 0, None, [None, (None, None, None)], None, None)]

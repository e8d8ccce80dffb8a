"""Pages written as HTML, by one expression over their blocks: the sink that the HTML source reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import escape
from pagewright.plans.stages import once


def _quoted(c: Column) -> Column:
    return F.replace(escape(c), F.lit('"'), F.lit("&quot;"))


def _wrap(t: Column, tag: str, on: Column) -> Column:
    return F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))).otherwise(t)


def _span(s: Column, links: Column) -> Column:
    t = F.coalesce(s["text"], F.lit(""))
    alt = F.regexp_replace(t, r"^［画像: |］$", "")
    image = F.concat(F.lit('<img alt="'), _quoted(alt), F.lit('">'))
    text = F.when(F.coalesce(s["image"], F.lit(False)), image).otherwise(F.replace(escape(t), F.lit("\n"), F.lit("<br>")))
    styled = _wrap(_wrap(_wrap(_wrap(text, "code", s["code"]), "b", s["bold"]), "i", s["italic"]), "s", s["strike"])
    href = _quoted(F.coalesce(F.get(links, s["link"]), F.lit("")))
    return F.when(s["link"].isNotNull(), F.concat(F.lit('<a href="'), href, F.lit('">'), styled, F.lit("</a>"))).otherwise(styled)


def _spans(spans: Column, links: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(spans, lambda s: _span(s, links)), ""), F.lit(""))


def _block(b: Column, links: Column) -> Column:
    body = _spans(b["spans"], links)
    tag = lambda t: F.concat(F.lit(f"<{t}>"), body, F.lit(f"</{t}>"))
    level = F.greatest(F.least(F.coalesce(b["level"], F.lit(0)), F.lit(6)), F.lit(1)).cast("string")
    heading = F.concat(F.lit("<h"), level, F.lit(">"), body, F.lit("</h"), level, F.lit(">"))
    number = F.regexp_extract(F.coalesce(b["marker"], F.lit("")), "^([0-9]+).$", 1)
    item = F.when(number != "", F.concat(F.lit('<ol start="'), number, F.lit('"><li>'), body, F.lit("</li></ol>"))).otherwise(F.concat(F.lit("<ul><li>"), body, F.lit("</li></ul>")))
    rows = F.transform(b["cell_rows"], lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), _spans(c, links), F.lit("</td>"))), ""), F.lit("</tr>")))
    code = F.concat(F.lit("<pre>\n"), escape(F.array_join(F.transform(b["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")), F.lit("</pre>"))
    kind = b["kind"]
    return (
        F.when(kind == "h", heading).when(kind == "li", item).when(kind == "quote", tag("blockquote")).when(kind == "hr", F.lit("<hr>")).when(kind == "pre", code)
        .when(kind == "table", F.concat(F.lit("<table>"), F.coalesce(F.array_join(rows, ""), F.lit("")), F.lit("</table>")))
        .when(F.coalesce(b["caption"], F.lit(False)), tag("figcaption")).otherwise(tag("p"))
    )


def to_html(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) of pages, once each."""
    blocks = F.array_join(F.transform("blocks", lambda b: _block(b, F.col("links"))), "\n")
    head = F.concat(F.lit('<!DOCTYPE html><html lang="'), _quoted(F.coalesce("lang", F.lit(""))), F.lit('"><head><title>'), escape(F.coalesce("title", F.lit(""))), F.lit("</title></head><body>"))
    return once(pages, "page_id").select("page_id", "url", F.concat(head, F.coalesce(blocks, F.lit("")), F.lit("</body></html>")).alias("html"))

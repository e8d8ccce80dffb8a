"""Queries on handwritten pages as sites write them, each filled with the name of every site, with the rows that must
come out as their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources import html as H
from pagewright.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LONG = "The mill by the river was closed for a week, and nobody in the town knew why. " * 4

#: Pages by name; ``@`` stands for the name of a site.
PAGES = {
    "furniture": f"<title>@</title><body><nav><a href=/>Home</a></nav><div class='side-bar'><p>Popular</p></div><div role=banner>Sign</div><main><h1>Head</h1><p>{_LONG}</p><p>Second @</p></main><aside>More</aside><footer>Legal</footer>",
    "never shown": f"<head><style>p{{}}</style></head><article><p>{_LONG}</p><p hidden>a</p><p aria-hidden=true>b</p><p style='color:red; display : none'>c</p><template><p>d</p></template><script>document.write('<p>e</p>')</script><noscript><p>f</p></noscript><p>shown @</p></article>",
    "lists": f"<article><p>{_LONG}</p><ul><li>one<ol start=4><li>four<li>five<ul><li>deep</ul></ol><li>two @</ul><dl><dt>Term<dd>Meaning</dl></article>",
    "unclosed": f"<article><p>{_LONG}<p><b>bold<p>still bold</b> plain<div>@<p>in</div>out</article>",
    "ruby": f"<article><p>{_LONG}</p><p>水<ruby>車<rt>ぐるま</rt></ruby>小屋</p><p><ruby>川<rp>(</rp><rt>かわ</rt><rp>)</rp></ruby>@</p></article>",
    "tables": f"<article><p>{_LONG}</p><table><caption>C</caption><tr><th>Day</th><th>@</th></tr><tbody><tr><td>1<td><a href=/x>2</a></table><table><tr><td><p>laid out</p><table><tr><td>inner<td>cells</table></table></article>",
    "text as is": f"<article><p>{_LONG}</p><pre>\n  a  b\n\n c @\n</pre><blockquote><p>said</p>more</blockquote><p>a&nbsp;&amp;&#x41;<br>next  line</p><hr></article>",
    "pictures": f"<article><p>{_LONG}</p><figure><img alt='A pond' src=data:x data-src=/p.png><figcaption>Under @</figcaption></figure><p><img alt='·'>dot<img src=/none.png></p><img alt=Wide srcset='/s.png 400w,/m.png 900w,/l.png 1800w'></article>",
    "links": f"<article><p>{_LONG}</p><p><a href='?a=1'>q</a> <a href=/t#x>t</a> <a href='javascript:x()'>no</a> <a href='//o.example/@'>o</a> <a href=/t#x>again</a></p></article>",
    "declared": f"<?xml version='1.0'?><!DOCTYPE html><html lang=fr><meta property=og:title content=' Real  @ '><title>Other</title><body><article><p>{_LONG}",
    "forms": "<form action='/s?x=1'><input name=q placeholder='Find @'><input type=hidden name=l value='a b'><select name=c><option value=1>x<option selected>y</select><input type=checkbox name=k checked><input type=radio name=r value=2><button name=go value=1>Go</button></form><form method=POST action=post><textarea name=t></textarea><input type=submit value='Send @'></form><form><input type=submit></form>",
    "script": "<script src=a.js></script><p>Loading @",
    "script asked for": "<script></script><noscript>Enable JavaScript, @</noscript><p>" + "words " * 150,
    "script not needed": "<script type='application/ld+json'>{}</script><p>short @",
    "empty": "<html><body><nav>@</nav></body></html>",
}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page for every site: page_id is the place of the page among PAGES after a hundred for each site."""
    written = F.array(*[F.lit(html) for html in PAGES.values()])
    sites = table(spark, d, "sites").select("site_id", "site_name", F.posexplode(written).alias("n", "html"))
    return sites.select((F.col("site_id") * 100 + F.col("n")).alias("page_id"), F.lit("https://mill.example/road/house").alias("url"), F.replace("html", F.lit("@"), "site_name").alias("html"))


def _rows(rows: list[tuple]) -> str:
    """Rows as SQL, ``@`` in texts replaced by each site's name."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


#: What must come out: page, place, kind, level, marker, text.
BLOCKS = [
    ("furniture", 0, "h", 1, "", "Head"), ("furniture", 1, "p", 0, "", _LONG.strip()), ("furniture", 2, "p", 0, "", "Second @"),
    ("never shown", 0, "p", 0, "", _LONG.strip()), ("never shown", 1, "p", 0, "", "shown @"),
    ("lists", 0, "p", 0, "", _LONG.strip()), ("lists", 1, "li", 0, "・", "one"), ("lists", 2, "li", 1, "4.", "four"), ("lists", 3, "li", 1, "5.", "five"), ("lists", 4, "li", 2, "・", "deep"), ("lists", 5, "li", 0, "・", "two @"), ("lists", 6, "p", 0, "", "Term"), ("lists", 7, "li", 1, "", "Meaning"),
    ("unclosed", 0, "p", 0, "", _LONG.strip()), ("unclosed", 1, "p", 0, "", "bold"), ("unclosed", 2, "p", 0, "", "still bold plain"), ("unclosed", 3, "p", 0, "", "@"), ("unclosed", 4, "p", 0, "", "in"), ("unclosed", 5, "p", 0, "", "out"),
    ("ruby", 0, "p", 0, "", _LONG.strip()), ("ruby", 1, "p", 0, "", "水車（ぐるま）小屋"), ("ruby", 2, "p", 0, "", "川(かわ)@"),
    ("tables", 0, "p", 0, "", _LONG.strip()), ("tables", 1, "table", 0, "", "Day @ / 1 2"), ("tables", 2, "p", 0, "", "laid out"), ("tables", 3, "table", 0, "", "inner cells"),
    ("text as is", 0, "p", 0, "", _LONG.strip()), ("text as is", 1, "pre", 0, "", "  a  b\n\n c @"), ("text as is", 2, "quote", 0, "", "said"), ("text as is", 3, "quote", 0, "", "more"), ("text as is", 4, "p", 0, "", "a &A\nnext line"), ("text as is", 5, "hr", 0, "", ""),
    ("pictures", 0, "p", 0, "", _LONG.strip()), ("pictures", 1, "p", 0, "", "［画像: A pond］"), ("pictures", 2, "p", 0, "", "Under @"), ("pictures", 3, "p", 0, "", "·dot"), ("pictures", 4, "p", 0, "", "［画像: Wide］"),
    ("links", 0, "p", 0, "", _LONG.strip()), ("links", 1, "p", 0, "", "q t no o again"),
    ("declared", 0, "p", 0, "", _LONG.strip()),
    ("script", 0, "p", 0, "", "Loading @"), ("script asked for", 0, "p", 0, "", "words " * 149 + "words"), ("script not needed", 0, "p", 0, "", "short @"),
]
_NAMES = list(PAGES)
_AS_SQL = _rows([(_NAMES.index(p), pos, kind, level, marker, text) for p, pos, kind, level, marker, text in BLOCKS])


@_query(f"SELECT site_id * 100 + n AS page_id, CAST(pos AS BIGINT) AS pos, kind, CAST(level AS BIGINT) AS level, marker, replace(text, '@', site_name) AS text FROM sites, {_AS_SQL} AS b(n, pos, kind, level, marker, text)")
def written_blocks(spark, d):
    """The main blocks of each page."""
    b = H.blocks(_pages(spark, d))
    return b.select("page_id", F.col("pos").cast("bigint"), "kind", F.col("level").cast("bigint"), "marker", "text")


#: What must come out besides: page, title, language, links, pictures, whether scripts are needed, forms sent with "a&b".
_LISTS = {
    "links": (["https://mill.example/road/house?a=1", "https://mill.example/t#x", "https://o.example/@"], []),
    "tables": (["https://mill.example/x"], []),
    "pictures": ([], ["/p.png", "/m.png"]),
}
_FORMS = {"forms": ["https://mill.example/s?q=a%26b&l=a+b&c=y&k=on&go=1 Find @", " Send @"]}
_SCRIPTED = ("never shown", "script", "script asked for")
_ROWS = ", ".join(
    "({}, '{}', '{}', {}::VARCHAR[], {}::VARCHAR[], {}, {}::VARCHAR[])".format(i, {"furniture": "@", "declared": "Real @"}.get(name, ""), "fr" if name == "declared" else "", *_LISTS.get(name, ([], [])), "true" if name in _SCRIPTED else "false", _FORMS.get(name, []))
    for i, name in enumerate(_NAMES)
)
_IN = "list_transform({}, lambda x: replace(x, '@', site_name))"


@_query(f"SELECT site_id * 100 + n AS page_id, replace(title, '@', site_name) AS title, v.lang, {_IN.format('links')} AS links, pictures, scripted AS needs_script, {_IN.format('forms')} AS forms FROM sites, (VALUES {_ROWS}) AS v(n, title, lang, links, pictures, scripted, forms)")
def written_documents(spark, d):
    """Title, language, links, pictures and forms of each page, and whether it shows little without scripts."""
    forms = F.transform("forms", lambda f: F.concat(F.coalesce(f["url"], F.lit("")), F.lit(" "), f["label"]))
    return H.documents(_pages(spark, d), "a&b").withColumn("forms", forms)


_HIT = "<div class='result {c}'><h2><a class='result__a' href='{h}'> Hit <b>{n}</b> of @</a></h2><a class='result__snippet'>About\n {n}</a></div>"
_HITS = [("", "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2F1&rut=x"), ("result--ad", "https://ad.example/"), ("", "https://a.example/2"), ("", "//other.example/l/?uddg=x")]


@_query("SELECT site_id AS page_id, CAST(place AS BIGINT) AS place, 'Hit ' || n || ' of ' || site_name AS title, url, 'About ' || n AS snippet FROM sites, (VALUES (0, 0, 'https://a.example/1'), (1, 2, 'https://a.example/2'), (2, 3, '//other.example/l/?uddg=x')) AS v(place, n, url)")
def written_results(spark, d):
    """The hits of a result page, without advertisements, behind their redirects."""
    html = "<h2>Results</h2>" + "".join(_HIT.format(c=c, h=h, n=n) for n, (c, h) in enumerate(_HITS)) + "<div class='other'><a class='result__a' href='/x'>no</a></div>"
    pages = table(spark, d, "sites").select(F.col("site_id").alias("page_id"), F.replace(F.lit(html), F.lit("@"), "site_name").alias("html"))
    return H.results(pages).select("page_id", F.col("place").cast("bigint"), "title", "url", "snippet")

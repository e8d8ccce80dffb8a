"""Addresses against the standard library and stated rules, on inputs made here."""

from email.message import Message
from itertools import product
from urllib.parse import parse_qs, quote, quote_plus, unquote, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from pagewright.functions import urls as U

TEXTS = ["plain", "two words", "ö/ü?&=#+", "50% off %2", "%zz%4", "山の小屋 (2)", "a%20b", "", "~-._*"]
BASES = ["https://mill.example/road/house.html?door=3#roof", "http://mill.example", "https://mill.example/road/", "https://mill.example:81/a;p/b"]
REFS = ["garden.html", "./x/./y", "../../up", "?door=4", "#cellar", "//pond.example/q", "/", "", "mailto:a@b.example", "https://pond.example/a/../b"]


def values(spark, rows, schema, col):
    """The values of an expression for rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row int, {schema}")
    return [r["v"] for r in df.select("row", col.alias("v")).orderBy("row").collect()]


def test_joining_is_that_of_the_library(spark):
    pairs = list(product(BASES, REFS))
    assert values(spark, pairs, "base string, ref string", U.url_join("base", "ref")) == [urljoin(*p) for p in pairs]


def test_quoting_is_that_of_the_library(spark):
    rows = [(t,) for t in TEXTS]
    assert values(spark, rows, "t string", U.quote_plus(F.col("t"))) == [quote_plus(t) for t in TEXTS]


def test_unquoting_is_that_of_the_library(spark):
    texts = TEXTS + [quote(t) for t in TEXTS] + ["%E5%B1%B1%", "%C3%BC%GG", "a+b%2B", "%e3%81%82%E3"]
    assert values(spark, [(t,) for t in texts], "t string", U.unquote(F.col("t"))) == [unquote(t) for t in texts]


def test_parameters_are_those_of_the_library(spark):
    queries = ["a=1&b=2", "k=" + quote_plus("ö & ü") + "&k=2", "x&y=", "=v", "&&a==b", "n%61me=v+w&name=z", ""]
    urls = [(f"https://mill.example/s?{q}",) for q in queries]
    for keep in (False, True):
        got = values(spark, urls, "u string", U.first_values(U.query_pairs(F.col("u"), keep)))
        assert [{p["k"]: p["v"] for p in ps} for ps in got] == [{k: v[0] for k, v in parse_qs(q, keep_blank_values=keep).items()} for q in queries]


@pytest.mark.parametrize("name", [U.TRACKING_PREFIX + "any", *U.TRACKING_PARAMETERS[::6]])
def test_tracking_parameters_go(spark, name):
    urls = [("https://mill.example/p?" + q + f,) for q in (f"{name}=1", f"{name}", f"page=2&{name}=x&lang=de", f"a={name}") for f in ("", "#part")]
    want = ["https://mill.example/p", "https://mill.example/p#part"] * 2 + ["https://mill.example/p?page=2&lang=de", "https://mill.example/p?page=2&lang=de#part", *(u for (u,) in urls[-2:])]
    assert values(spark, urls, "u string", U.without_trackers(F.col("u"))) == want


def test_hosts_and_ports(spark):
    urls = ["https://Mill.Example/x", "http://mill.example", "http://joe:secret@mill.example:8081/a:b", "https://[fe80::1]:444/", "https://[fe80::1]/"]
    rows = [(u,) for u in urls]
    bare = [h.strip("[]") for h in values(spark, rows, "u string", U.host(F.col("u")))]
    assert bare == [urlsplit(u).hostname for u in urls]
    assert values(spark, rows, "u string", U.port(F.col("u"))) == [urlsplit(u).port or {"http": 80}.get(urlsplit(u).scheme, 443) for u in urls]


RELATIONS = [  # address, relation to the page, what the page tells it
    ("https://shop.mill.co.uk/b", "same-origin", "https://shop.mill.co.uk/a?x=1"),
    ("https://SHOP.mill.co.uk/", "same-origin", "https://shop.mill.co.uk/a?x=1"),
    ("https://img.mill.co.uk/c", "same-site", "https://shop.mill.co.uk/"),
    ("https://shop.mill.co.uk:444/", "same-site", "https://shop.mill.co.uk/"),
    ("https://shop.mill.co.uk:443/", "same-site", "https://shop.mill.co.uk/"),
    ("https://pond.co.uk/", "cross-site", "https://shop.mill.co.uk/"),
    ("http://shop.mill.co.uk/b", "cross-site", None),
]


def test_relations_and_referers(spark):
    page = F.lit("https://ann:pw@Shop.Mill.co.uk/a?x=1#y")
    rows = [(u,) for u, _, _ in RELATIONS]
    assert values(spark, rows, "u string", U.site_relation(page, F.col("u"))) == [r for _, r, _ in RELATIONS]
    assert values(spark, rows, "u string", U.referer(page, F.col("u"))) == [r for _, _, r in RELATIONS]
    assert values(spark, [("https://a.example/",), ("about:x",)], "u string", U.referer(F.lit("about:blank"), F.col("u"))) == [None, None]


def test_redirects_are_unwrapped(spark):
    target = "https://pond.example/a b?c=d&e"
    q = f"{U.REDIRECT_PARAMETER}={quote_plus(target)}"
    urls = [f"https://{U.REDIRECT_HOST}/l/?x=1&{q}", f"//html.{U.REDIRECT_HOST}/l/y?{q}", f"http://{U.REDIRECT_ONION}/l/?{q}"]
    same = [f"https://{U.REDIRECT_HOST}/?{q}", f"https://{U.REDIRECT_HOST}/l/?x=1", f"http://other.onion/l/?{q}", "https://pond.example/"]
    assert values(spark, [(u,) for u in urls + same], "u string", U.redirect_target(F.col("u"))) == [target] * len(urls) + same


def test_file_names_of_addresses(spark):
    want = {"https://a.example/x/y.pdf?z=/q": "y.pdf", "https://a.example/x/": "x", "https://a.example": "download", "https://a.example/%E5%B1%B1%20b.txt#c/d": "山 b.txt", "https://a.example/p%2Fq": "q"}
    assert values(spark, [(u,) for u in want], "u string", U.file_name(F.col("u"))) == list(want.values())


def test_file_names_of_headers(spark):
    def header(name, charset=None):
        m = Message()
        m.add_header("Content-Disposition", "attachment", filename=name if charset is None else (charset, "", name))
        return m["Content-Disposition"]

    rows = {header("list.csv"): "list.csv", header('say "hi".txt'): 'say "hi".txt', header("山.pdf", "utf-8"): "山.pdf", "attachment; filename*0=par; filename*1=t.txt": "part.txt"}
    rows |= {"inline; filename=\"/etc/x.txt\"": "x.txt", "attachment; filename=a.txt; filename*=UTF-8''b.txt": "a.txt", "attachment": "page", "": "page", None: "page"}
    got = values(spark, [(h,) for h in rows], "h string", U.download_name(F.lit("https://a.example/page"), F.col("h")))
    assert got == list(rows.values())


def test_what_is_an_address(spark):
    want = {"http://a b": True, "mill.example": True, "mill": False, "two words.example": False, "山.example": False, "...": False, "ftp://x": True}
    assert values(spark, [(t,) for t in want], "t string", U.looks_like_url(F.col("t"))) == list(want.values())


def test_parents(spark):
    want = {"https://a.example/x/y/z?q#f": "https://a.example/x/y/", "https://a.example/x/y/": "https://a.example/x/", "https://a.example/": "https://a.example/", "https://a.example": "https://a.example/"}
    assert values(spark, [(u,) for u in want], "u string", U.parent(F.col("u"))) == list(want.values())
    assert set(values(spark, [(u,) for u in want], "u string", U.site_root(F.col("u")))) == {"https://a.example/"}


def test_null_addresses_stay_null(spark):
    rows = [(None,)]
    for f in (U.host, U.without_trackers, U.unquote, U.redirect_target, U.query_pairs):
        assert values(spark, rows, "u string", f(F.col("u"))) == [None]

"""URL algebra as column expressions.

``parse_url`` rejects addresses with non-ASCII characters, so one anchored pattern takes an address apart. Joining and
the names in a Content-Disposition follow the standard library and run in Arrow batches; the rest stays in the JVM.
"""

from __future__ import annotations

from email.message import Message
from email.utils import collapse_rfc2231_value
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: scheme, //netloc, path, ?query, #fragment
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# fixed values: query parameters that only track a visitor, and the prefix of a family of them
TRACKING_PREFIX = "utm_"
TRACKING_PARAMETERS = [
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "igshid", "mc_cid", "mc_eid",
    "_hsenc", "_hsmi", "mkt_tok", "oly_anon_id", "oly_enc_id", "vero_id", "_openstat", "ttclid", "li_fat_id", "s_cid", "wickedid",
]

# fixed values: hosts of advertising and affiliate services; their subdomains count too
AD_DOMAINS = [
    "doubleclick.net", "googleadservices.com", "googlesyndication.com", "adservice.google.com", "adservice.google.co.jp",
    "amazon-adsystem.com", "adnxs.com", "criteo.com", "criteo.net", "rubiconproject.com", "pubmatic.com", "openx.net",
    "smartadserver.com", "advertising.com", "adform.net", "yieldmo.com", "teads.tv", "media.net", "zedo.com", "ad.yieldmanager.com",
    "taboola.com", "outbrain.com", "revcontent.com", "mgid.com", "zergnet.com", "popin.cc", "logly.co.jp", "uzou.jp",
    "i-mobile.co.jp", "microad.jp", "ad-stir.com", "adingo.jp", "fluct.jp", "impact-ad.jp", "yads.yahoo.co.jp", "ads.yahoo.com",
    "a8.net", "af.moshimo.com", "valuecommerce.com", "valuecommerce.ne.jp", "accesstrade.net", "afi-b.com", "felmat.net",
    "hb.afl.rakuten.co.jp", "linksynergy.com", "click.linksynergy.com", "rentracks.jp", "xmax.jp", "affiliate-b.com",
    "awin1.com", "shareasale.com", "commission-junction.com", "anrdoezrs.net", "jdoqocy.com", "tkqlhce.com", "dpbolvw.net",
]


def cleaned(url: Column) -> Column:
    """Without leading control characters and blanks, and without tabs and line breaks."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(cleaned(url), PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def host(url: Column) -> Column:
    """Lower case, without user and port; the brackets of a numeric address stay."""
    return F.lower(F.regexp_extract(F.regexp_replace(netloc(url), r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """The explicit port, else that of the scheme: 80 for http, 443 otherwise."""
    explicit = F.regexp_extract(netloc(url), r":(\d+)$", 1)
    return F.when(explicit != "", explicit.cast("int")).when(scheme(url) == "http", 80).otherwise(443)


def unsplit(scheme_: Column, netloc_: Column, path_: Column, query_: Column, fragment_: Column) -> Column:
    slash = F.when((netloc_ != "") & (path_ != "") & ~path_.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc_ != "", F.concat(F.lit("//"), netloc_)).otherwise(F.lit("")),
        slash,
        path_,
        F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit("")),
        F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(F.lit("")),
    )


def defragmented(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def site_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/"))


def parent(url: Column) -> Column:
    """The directory above: query and fragment dropped, the last part of the path cut."""
    above = F.regexp_replace(F.regexp_replace(path(url), r"/+$", ""), r"[^/]*$", "")
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.when(above == "", F.lit("/")).otherwise(above))


def quote_plus(c: Column) -> Column:
    """Form encoding that keeps letters, digits and _ . - ~"""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquote(c: Column) -> Column:
    """Percent escapes of UTF-8 undone; a percent sign that begins none stays, bytes that are no text become U+FFFD."""
    escaped = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.instr(c, "%") == 0, c).otherwise(F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))))


def unquote_plus(c: Column) -> Column:
    """The same, with a plus for a blank."""
    return unquote(F.replace(c, F.lit("+"), F.lit(" ")))


def query_pairs(url: Column, keep_blank: bool = False) -> Column:
    """array<struct<k,v>> of the query's parameters, decoded, in order; empty values go unless kept."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    split = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit("")).alias("v")))
    kept = split if keep_blank else F.filter(split, lambda p: p["v"] != "")
    return F.transform(kept, lambda p: F.struct(unquote_plus(p["k"]).alias("k"), unquote_plus(p["v"]).alias("v")))


def first_values(pairs: Column) -> Column:
    """The first pair of each name, in order."""
    names = lambda ps: F.transform(ps, lambda p: p["k"])
    return F.filter(pairs, lambda p, i: F.array_position(names(pairs), p["k"]) == i + 1)


def is_tracking(name: Column) -> Column:
    return name.startswith(TRACKING_PREFIX) | name.isin(TRACKING_PARAMETERS)


def without_trackers(url: Column) -> Column:
    """Tracking parameters and empty pairs removed; the question mark goes with the last of them, the fragment stays."""
    base = F.substring_index(url, "#", 1)
    frag = F.substring(url, F.length(base) + 1, F.length(url))
    path_ = F.substring_index(base, "?", 1)
    query_ = F.substring(base, F.length(path_) + 2, F.length(base))
    kept = F.array_join(F.filter(F.split(query_, "&"), lambda p: (p != "") & ~is_tracking(F.substring_index(p, "=", 1))), "&")
    return F.when(F.instr(base, "?") == 0, url).otherwise(F.concat(path_, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), frag))


def host_suffixes(h: Column) -> Column:
    """The host and every domain above it: what an equi join with a table of domains needs."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def registrable(h: Column) -> Column:
    """The last two labels, three below a second-level suffix such as co.jp: an approximation of the public suffixes."""
    three = h.rlike(r"\.(?:co|ne|or|ac|go|com|net|org|gov|edu)\.[a-z]{2}$")
    return F.when(three, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def authority(url: Column) -> Column:
    """Host and port as they are written, in lower case and without a user: with the scheme, an origin."""
    return F.lower(F.regexp_replace(netloc(url), r"^.*@", ""))


def same_origin(page: Column, url: Column) -> Column:
    return (scheme(page) == scheme(url)) & (authority(page) == authority(url))


def site_relation(page: Column, url: Column) -> Column:
    """same-origin, same-site or cross-site."""
    site = (scheme(page) == scheme(url)) & ((host(page) == host(url)) | (registrable(host(page)) == registrable(host(url))))
    return F.when(same_origin(page, url), "same-origin").when(site, "same-site").otherwise("cross-site")


def referer(page: Column, url: Column) -> Column:
    """strict-origin-when-cross-origin: the page without user and fragment within its origin, its origin elsewhere, none
    from https to http, and none of a page that is neither."""
    origin = F.concat(scheme(page), F.lit("://"), authority(page))
    own = F.concat(origin, path(page), F.when(query(page) != "", F.concat(F.lit("?"), query(page))).otherwise(F.lit("")))
    none = ~scheme(page).isin("http", "https") | (scheme(page) == "https") & (scheme(url) != "https")
    return F.when(none, F.lit(None).cast("string")).when(same_origin(page, url), own).otherwise(F.concat(origin, F.lit("/")))


def private_upgrade(url: Column) -> Column:
    """http turned into https, except for hosts under .onion."""
    onion = host(url).endswith(".onion")
    return F.when((scheme(url) == "http") & ~onion, F.regexp_replace(cleaned(url), "^[hH][tT][tT][pP]:", "https:")).otherwise(url)


def private_allowed(url: Column) -> Column:
    return (scheme(url) == "https") | host(url).endswith(".onion")


def looks_like_url(text: Column) -> Column:
    """An address rather than words to search for: a scheme, or one word of ASCII with a stop inside."""
    inner = F.regexp_replace(text, r"^\.+|\.+$", "")
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://") | ((F.instr(text, " ") == 0) & ~text.rlike(r"[^\x00-\x7F]") & (F.instr(inner, ".") > 0))


def to_url(text: Column) -> Column:
    return F.when(F.instr(text, "://") > 0, text).otherwise(F.concat(F.lit("https://"), text))


# fixed values: the hosts whose /l/ addresses lead elsewhere, and the parameter that says where
REDIRECT_HOST = "duckduckgo.com"
REDIRECT_ONION = "duckduckgogg42xjoc72x3sjasowoarfbgcmvfimaftt6twagswzczad.onion"
REDIRECT_PARAMETER = "uddg"


def redirect_target(url: Column) -> Column:
    """The target of a search engine's redirect link, which may lack its scheme; else the address itself."""
    full = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("https:"), url))
    leads = (netloc(full).endswith(REDIRECT_HOST) | (netloc(full) == REDIRECT_ONION)) & path(full).startswith("/l/")
    value = F.filter(query_pairs(full), lambda p: p["k"] == REDIRECT_PARAMETER)
    return F.when(leads & (F.size(value) > 0), F.get(value, F.lit(0))["v"]).otherwise(url)


def last_component(c: Column) -> Column:
    """What follows the last slash but those at the end."""
    return F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)


def file_name(url: Column) -> Column:
    """The last part of the decoded path, or "download"."""
    last = last_component(unquote(path(url)))
    return F.when(last == "", "download").otherwise(last)


def download_name(url: Column, disposition: Column) -> Column:
    """The name that a Content-Disposition gives, without folders, else that of the address."""
    given = last_component(F.coalesce(disposition_name(disposition), F.lit("")))
    return F.when(given == "", file_name(url)).otherwise(given)


@F.arrow_udf(T.StringType())
def disposition_name(header: pa.Array) -> pa.Array:
    """The file name in a Content-Disposition: ``filename``, else the pieces of ``filename*``; null without one."""

    def one(value):
        if not value or "filename" not in value.lower():
            return None
        m = Message()
        m["Content-Disposition"] = value.replace("\r", " ").replace("\n", " ")
        plain = next((v for k, v in m.get_params(header="content-disposition") or [] if k.lower() == "filename" and isinstance(v, str)), None)
        return plain if plain is not None else collapse_rfc2231_value(m.get_filename("")) or None

    return pa.array([one(v) for v in header.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def url_join(base: pa.Array, ref: pa.Array) -> pa.Array:
    def one(b, r):
        try:
            return urljoin(b, r)
        except ValueError:
            return None

    return pa.array([None if b is None or r is None else one(b, r) for b, r in zip(base.to_pylist(), ref.to_pylist())], pa.string())


@F.arrow_udf(T.StringType())
def url_defrag(url: pa.Array) -> pa.Array:
    return pa.array([None if u is None else urldefrag(u)[0] for u in url.to_pylist()], pa.string())

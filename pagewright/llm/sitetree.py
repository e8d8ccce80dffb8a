"""Problem 4: the main body of a page, by a site style tree.

The pages of a host are merged into one tree: its branches are what stands before the title heading, the title, and
what follows, where a heading opens a branch of its own; its nodes are blocks of a presentation (kind, level, link
or not) with a content. The importance of a content that stands on m of a host's N pages is 1 - log m / log N: 1 if it
is unique, 0 if every page has it. The presentations of the part before the title, in their order, are a style node of
the host; the importance of that part's presentation is the entropy of its style nodes over the host's pages, in units
of log N. Counts are exact cardinalities of united page bitmaps (``bitmaps``). A node of low importance is removed; a
branch goes as a whole if its importance is low: of the part before the title, the importance of its presentation and
the mean of its contents, weighed as one to four; of another, that of the heading that opens it. Hosts with few pages
borrow the contents that are of low importance among all hosts of their language.

Presentations are headings, captions, and items or paragraphs that are mostly link or not; a list of links is one node, low if
half its items are. A node's content is its letters in the folded text, with the site's own name as one sign; for a block that is mostly
link, its unlinked letters; the digits too where a block is a row of figures. The short line under the title that names
the site has its presentation for a content: who wrote a page differs, that it is told there is the host's template.

Defined results: null blocks, spans and texts count as empty; blocks without text and of kind hr never come out as
boilerplate; a page without a title heading has no part before it; a page without a usable url is judged by the
contents known for all hosts; a redelivered page counts once; an empty table gives none.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.bitmaps import cardinalities
from pagewright.llm.common import PAGE_SCHEMA, Flat, host_of, line_key, pages
from pagewright.llm.repeats import CACHE, hash64
from pagewright.plans.stages import materialize
from pagewright.sources.tables import table

#: A content of lower importance is boilerplate if it also stands on this part of the pages.
IMPORTANCE = 0.6
LEAST_SHARE = 0.01
LEAST_PAGES = 4
#: The same among all hosts of a language.
POOL_SHARE = 0.02
POOL_PAGES = 5
#: The part before the title is a low branch up to this importance, of which its presentation makes this part.
LEAD, STYLE_WEIGHT = 0.75, 0.2
#: Low contents that are held by every task at most; beyond it they travel with their host's pages.
HELD = 300_000
#: Sites whose name is held by every task at most; beyond it names are looked up in mapped files.
NAMES = 200_000

BEFORE, TITLE, AFTER, STYLE = 0, 1, 2, 3
#: A site with more of all pages than this part is hot: its pages are spread over ``SALTS`` tasks in a join.
HOT, SALTS = 1 / 1000, 64
KINDS = {"h": 0, "p": 1, "li": 2, "pre": 3, "quote": 4, "table": 5, "hr": 6}

#: Blocks of a page as parallel arrays: kind, level, flags (1 has text, 2 names the site in a short line, 4 mostly
#: link, 8 has a marker), content. ``style``: the presentations before the title. ``as_site``: the host itself or, without a url, the one whose name the page bears.
FIELDS = "page_id bigint, site bigint, as_site bigint, first int, style bigint, kinds array<int>, levels array<int>, flags array<int>, keys array<bigint>"

_LOOKS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD)
_PARTS = re.compile(r"\s+[|·•:—–\-]\s+|[|｜]")
_DIGITS = re.compile(r"\d+")
_FIGURES = re.compile(r"[;|\t]")
_LEAD_IN = re.compile(r"\s*([^:：\n]{2,30})[:：]\s*\S[^\n]{3,130}(?<![.!?。！？”»」])\s*\Z")
_TRIM = " |·•»›>-–—…!.\n"
_contents: dict[tuple[str, str], tuple[int, bool]] = {}
_BYLINE = hash64("\n@")  # no content has a line break


def _content(text: str, name: str) -> tuple[int, bool]:
    """The content of a node as a hash (0 without letters), and whether it names the site."""
    known = _contents.get((text, name))
    if known is None:
        key = line_key(text)
        names = bool(name) and name in key
        if names:
            key = key.replace(name, "@")
        if key and not names and ((digits := _DIGITS.findall(text)) and len(digits) > 1 or _FIGURES.search(text.strip(_TRIM))):
            key += "".join(digits)
        known = (hash64(key) if key else 0, names)
        if len(text) < 120:
            if len(_contents) >= CACHE:
                _contents.clear()
            _contents[text, name] = known
    return known


class PageBlocks:
    """One page's blocks in a batch: places a..b of the flat arrays, and the place of its title heading (-1: none)."""

    __slots__ = ("a", "b", "title")

    def __init__(self, flat: Flat, a: int, b: int):
        self.a, self.b, self.title = a, b, -1
        for i in range(a, b):
            if flat.kind[i] == "h" and flat.level[i] == 1 and flat.text[i].strip():
                self.title = i - a
                break


class Names:
    """The letters of each site's name by host, and the host of a name (the first of several), held in memory."""

    def __init__(self, names: dict[str, str]):
        self.names = names
        self.hosts: dict[str, str] = {}
        self.sizes: dict[str, set[int]] = {}
        for host in sorted(names, reverse=True):
            self.hosts[names[host]] = host
            self.sizes.setdefault(names[host][:3], set()).add(len(names[host]))

    def name(self, host: str) -> str:
        return self.names.get(host, "")

    def host(self, name: str) -> str | None:
        return self.hosts.get(name)

    def _within(self, key: str) -> set[str]:
        """The names that stand in a key."""
        return {n for i in range(len(key) - 2) for size in self.sizes.get(key[i : i + 3], ()) if (n := key[i : i + size]) in self.hosts}

    def longest(self, key: str) -> str | None:
        """The host of the longest name in a key."""
        best = min(self._within(key), key=lambda n: (-len(n), n), default=None)
        return None if best is None else self.host(best)


class StoredNames(Names):
    """The same of any number of sites: sorted hashes in files that every executor has and its workers map."""

    def __init__(self, names: DataFrame):
        """``names``: (host, name), each host once."""
        spark = names.sparkSession
        self.stem = f"names-{uuid.uuid4().hex}"
        self.size_list = sorted(r["size"] for r in names.select(F.length("name").alias("size")).distinct().collect())
        hashed = materialize(names.mapInArrow(_hashed_names, "host string, name string, h bigint, n bigint, p bigint"), "names")
        folder = tempfile.mkdtemp(prefix="pagewright-names-")  # executors fetch from it until the session ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        for part, rows in (
            ("h", hashed.select("h", F.col("name").alias("v"))),
            ("n", hashed.groupBy("n").agg(F.min("host").alias("v")).select(F.col("n").alias("h"), "v")),
            ("p", hashed.select(F.col("p").alias("h"), F.lit("").alias("v")).distinct()),
        ):
            paths = [os.path.join(folder, f"{self.stem}-{part}{x}") for x in "kov"]
            with open(paths[0], "wb") as keys, open(paths[1], "wb") as ends, open(paths[2], "wb") as values:
                ends.write(bytes(8))
                for r in rows.sort("h").toLocalIterator():  # passes through the driver, none is held
                    values.write(r["v"].encode())
                    keys.write(struct.pack("<q", r["h"]))
                    ends.write(struct.pack("<q", values.tell()))
                values.write(b" ")  # an empty file can't be mapped
            for path in paths:
                spark.sparkContext.addFile(path)
        self.maps: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return {"stem": self.stem, "size_list": self.size_list, "maps": {}}

    def _map(self, part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if part not in self.maps:
            at = SparkFiles.get(f"{self.stem}-{part}")
            self.maps[part] = tuple(np.memmap(at + x, t, "r") for x, t in (("k", "<i8"), ("o", "<i8"), ("v", "u1")))
        return self.maps[part]

    def _known(self, part: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes of texts are in a part, and whether they are."""
        keys, h = self._map(part)[0], np.array([hash64(t) for t in texts], np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def _value(self, part: str, text: str) -> str | None:
        at, there = self._known(part, [text])
        if not there[0]:
            return None
        _, ends, values = self._map(part)
        return values[ends[at[0]] : ends[at[0] + 1]].tobytes().decode()

    def name(self, host: str) -> str:
        return self._value("h", host) or ""

    def host(self, name: str) -> str | None:
        return self._value("n", name)

    def _within(self, key: str) -> set[str]:
        starts = np.flatnonzero(self._known("p", [key[i : i + 3] for i in range(len(key) - 2)])[1]).tolist() if len(key) > 2 else []
        texts = list({key[i : i + size] for i in starts for size in self.size_list if i + size <= len(key)})
        return {t for t, there in zip(texts, self._known("n", texts)[1].tolist()) if there} if texts else set()


def _hashed_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
        hashes = [pa.array(list(map(hash64, x)), pa.int64()) for x in (hosts, names, [n[:3] for n in names])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *hashes], ["host", "name", "h", "n", "p"])


def _named(title: str | None, texts: list[str], names: Names) -> str | None:
    """The host whose name is a part of the title, or stands in most of the short texts that hold one."""
    for part in _PARTS.split(title or ""):
        if (host := names.host(line_key(part))) is not None:
            return host
    seen: Counter[str] = Counter()
    for text in texts:
        if 0 < len(text) < 150 and (host := names.longest(line_key(text))):
            seen[host] += 1
    return seen.most_common(1)[0][0] if seen else None


@lru_cache(1 << 16)
def _style(nodes: tuple[tuple[int, int], ...]) -> int:
    """The presentations (kind, mostly link or not) of blocks in their order, runs as one, as a hash."""
    looks = [f"{kind}{flag & 4}" for kind, flag in nodes]
    return hash64("".join(x for x, before in zip(looks, ["", *looks]) if x != before))


def structure(batch: pa.RecordBatch, flat: Flat, names: Names) -> tuple[list[tuple], list[PageBlocks]]:
    """FIELDS of every page of a batch (page_id, url, ... , blocks)."""
    ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
    titles = batch.column("title").to_pylist()
    rows, parts = [], []
    starts = flat.starts.tolist()
    n, linked, level = flat.n.tolist(), flat.linked.tolist(), flat.level.tolist()
    for page, (a, b) in enumerate(pairwise(starts)):
        host = host_of(urls[page])
        as_host = host or _named(titles[page], flat.text[a:b], names)
        name = names.name(as_host) if as_host else ""
        part = PageBlocks(flat, a, b)
        kinds, flags, keys = [], [], []
        for i in range(a, b):
            kind, text = flat.kind[i], flat.text[i]
            flag = 8 if flat.marker[i] else 0
            key = 0
            if kind == "table":
                flag |= 1
            elif kind != "hr" and text and not text.isspace():
                flag |= 1
                if linked[i] * 2 >= n[i]:
                    flag |= 4
                if kind == "p" and flag & 4 and linked[i] < n[i]:
                    s0, s1 = flat.span_starts[i], flat.span_starts[i + 1]
                    key, names_site = _content("".join(t for t, k in zip(flat.span_texts[s0:s1], flat.span_linked[s0:s1]) if not k), name)
                    look = 1
                elif kind == "p" and n[i] < 160 and not level[i] and not flat.caption[i] and not flat.image[i] and (m := _LEAD_IN.match(text)):
                    key, names_site = _content(m.group(1), name)  # a lead-in and what it points to, its link lost
                    look = 1
                else:
                    key, names_site = _content(text, name)
                    look = 3 if flat.caption[i] else 2 if level[i] > 0 and kind in ("h", "p") else (flag >> 2 & 1) + (4 if kind == "li" else 0)
                if names_site and n[i] < 100:
                    flag |= 2
                    if i - a == part.title + 1 and part.title >= 0 and kind != "h":
                        key = _BYLINE
                if key:  # as a node of its presentation
                    key = key ^ _LOOKS[look] or 1
            kinds.append(KINDS.get(kind, 1))
            flags.append(flag)
            keys.append(key)
        style = _style(tuple(zip(kinds, flags[: max(part.title, 0)])))
        rows.append((ids[page], hash64(host) if host else 0, hash64(as_host) if as_host else 0, part.title, style, kinds, level[a:b], flags, keys))
        parts.append(part)
    return rows, parts


def _arrow(rows: list[tuple]) -> list[pa.Array]:
    c = list(zip(*rows))
    offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in c[5]])].astype(np.int32))
    flat = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(np.array([v for r in x for v in r], dtype=t)))
    return [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64()), flat(c[5], np.int32), flat(c[6], np.int32), flat(c[7], np.int32), flat(c[8], np.int64)]


Extra = Callable[[pa.RecordBatch, Flat, list[PageBlocks]], list[pa.Array]]


def analyse(page_docs: DataFrame, names: Names, extra: Extra | None = None, fields: str = "", keep: str = "") -> DataFrame:
    """FIELDS of every page, in one pass over the texts; ``extra`` adds columns ``fields`` of the same pass, ``keep``
    names columns (DDL) that come along."""
    kept = [f.split()[0] for f in keep.split(", ") if f]
    columns = [f.split()[0] for f in FIELDS.split(", ")] + [f.split()[0] for f in fields.split(", ") if f] + kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the many small tuples of a batch hold no cycles
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                flat = Flat(b)
                rows, parts = structure(b, flat, names)
                yield pa.RecordBatch.from_arrays(_arrow(rows) + (extra(b, flat, parts) if extra else []) + [b.column(k) for k in kept], columns)

    return page_docs.mapInArrow(run, ", ".join(x for x in (FIELDS, fields, keep) if x))


def site_names(sites: DataFrame) -> Names:
    """The letters of each site's name by host (the first of several names): held for up to ``NAMES`` sites, else stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(host_of("//" + h), line_key(n)) for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if h and n]
            rows = [r for r in rows if r[0] and len(r[1]) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.string())], ["host", "name"])

    names = sites.select("host", "site_name").mapInArrow(run, "host string, name string").groupBy("host").agg(F.min("name").alias("name"))
    rows = names.limit(NAMES + 1).collect()
    return StoredNames(names) if len(rows) > NAMES else Names({r["host"]: r["name"] for r in rows})


def low_contents(structured: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, key): contents of low importance by host; site 0 holds those that are low among a language's hosts, and
    key 0 marks a host whose part before the title is a low branch."""
    zone = F.when(F.col("n") < F.col("first"), BEFORE).when(F.col("n") == F.col("first"), TITLE).otherwise(AFTER)
    nodes = structured.select("page_id", "site", "first", F.posexplode("keys").alias("n", "key")).where("key <> 0")
    page = structured.where("site <> 0").select("page_id", "site", F.lit(TITLE).alias("zone"), F.lit(0).cast("bigint").alias("key"))
    styles = structured.where("site <> 0").select("page_id", "site", F.lit(STYLE).alias("zone"), F.col("style").alias("key"))
    postings = nodes.where("site <> 0").select("page_id", "site", zone.alias("zone"), "key").where(F.col("zone") != TITLE).unionByName(page).unionByName(styles)
    counts = materialize(cardinalities(postings.withColumn("variant", F.col("key"))), "contents")

    host = counts.where("key = 0").select("site", F.col("pages").alias("total"))
    contents = counts.where((F.col("key") != 0) & (F.col("zone") != STYLE))
    often = contents.where(F.col("pages") >= LEAST_PAGES).groupBy("site", "key").agg(F.max("pages").alias("pages"))
    importance = 1 - F.log("pages") / F.log("total")
    by_host = often.join(host, "site").where((importance <= IMPORTANCE) & (F.col("pages") >= LEAST_SHARE * F.col("total"))).select("site", "key")

    # the part before the title: the entropy of its style nodes over the pages, and the mean importance of its contents
    log_n = F.log(F.greatest("total", F.lit(2)))
    share = F.col("pages") / F.col("total")
    presented = counts.where(F.col("zone") == STYLE).join(host, "site").groupBy("site").agg((-F.sum(share * F.log(share)) / F.max(log_n)).alias("presentation"))
    told = contents.where(F.col("zone") == BEFORE).join(host, "site").groupBy("site").agg((F.sum(F.col("pages") * (1 - F.log("pages") / log_n)) / F.sum("pages")).alias("content"))
    lead = told.join(presented, "site").where(STYLE_WEIGHT * F.col("presentation") + (1 - STYLE_WEIGHT) * F.col("content") <= LEAD)
    low_lead = lead.select("site", F.lit(0).cast("bigint").alias("key"))

    known = counts.where(F.col("zone") != STYLE).join(site_langs(sites), "site")
    pool = known.where("key = 0").groupBy("lang").agg(F.sum("pages").alias("total"))
    shared = known.where("key <> 0").groupBy("lang", "key").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= POOL_PAGES)
    by_lang = shared.join(pool, "lang").where((importance <= IMPORTANCE) & (F.col("pages") >= POOL_SHARE * F.col("total")))
    return by_host.unionByName(low_lead).unionByName(by_lang.select(F.lit(0).cast("bigint").alias("site"), "key").distinct())


def site_langs(sites: DataFrame) -> DataFrame:
    """(site, lang) of the table of sites."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = [host_of("//" + h) if h else None for h in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hash64(h) if h else 0 for h in hosts], pa.int64()), b.column(1)], ["site", "lang"])

    return sites.select("host", F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(run, "site bigint, lang string").where("site <> 0").dropDuplicates(["site"])


def body_flags(first: int, kinds: list[int], levels: list[int], flags: list[int], keys: list[int], low: Callable[[int], bool], lead_low: bool) -> list[bool]:
    """Which blocks of a page are its main body."""
    out = []
    tail = False
    lows = [k != 0 and low(k) for k in keys]
    # a list of links is one node
    i = 0
    while i < len(kinds):
        j = i + 1
        if kinds[i] == 2 and flags[i] & 4:
            while j < len(kinds) and kinds[j] == 2 and flags[j] & 4:
                j += 1
            lows[i:j] = [sum(lows[i:j]) * 2 >= j - i and (j - i > 1 or not flags[i] & 8)] * (j - i)
        i = j
    for i, (kind, level) in enumerate(zip(kinds, levels)):
        if i < first and lead_low:
            out.append(False)
            continue
        if i == first:
            out.append(True)
            continue
        is_low = lows[i]
        heading = kind == 0 or kind == 1 and level > 0
        if heading and i > first:
            tail = is_low or tail and not (kind == 0 and level > 0)
        keep = not (tail or is_low)
        out.append(keep)
    return out


class Low:
    """The low contents for the pages of a partition: of all sites, or of the languages' pool only."""

    def __init__(self, held: dict[int, frozenset[int]], joined: bool = False):
        self.held, self.joined = held, joined

    def of(self, site: int, own: list[int] | None) -> tuple[Callable[[int], bool], bool]:
        shared = self.held.get(0, frozenset())
        mine = (None if own is None else frozenset(own)) if self.joined else self.held.get(site)
        few = site == 0 or mine is None
        mine = mine or frozenset()
        return (lambda k: k in mine or k in shared), 0 in mine or few


def with_low(structured: DataFrame, low: DataFrame) -> tuple[DataFrame, Low]:
    """The pages ready for ``body_flags``: low contents held by every task if their count allows it, else joined to
    the pages of their host (bounded for a host: a content needs ``LEAST_SHARE`` of its pages), and only the pool held
    (bounded for a language: ``POOL_SHARE``)."""
    low = materialize(low, "low")
    rows = low.limit(HELD + 1).collect()
    joined = len(rows) > HELD
    held: dict[int, set[int]] = {}
    for r in low.where("site = 0").collect() if joined else rows:
        held.setdefault(r["site"], set()).add(r["key"])
    known = Low({k: frozenset(v) for k, v in held.items()}, joined)
    if not joined:
        return structured.withColumn("low", F.lit(None).cast("array<bigint>")), known
    own = low.where("site <> 0").groupBy(F.col("site").alias("as_site")).agg(F.collect_set("key").alias("low"))
    # the pages of a hot site (fewer than 1 / HOT of them), and those of no site, are spread
    sizes = materialize(structured.groupBy("as_site").count(), "sizes")
    least = (sizes.agg(F.sum("count")).first()[0] or 0) * HOT
    hot = F.broadcast(sizes.where((F.col("count") > least) | (F.col("as_site") == 0)).select("as_site", F.lit(SALTS).alias("salts")))
    salt = F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1)))
    pages_ = structured.join(hot, "as_site", "left").withColumn("salt", salt).drop("salts")
    spread = own.join(hot, "as_site", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    return pages_.join(spread, ["as_site", "salt"], "left").drop("salt"), known


def _boilerplate(batches: Iterator[pa.RecordBatch], low: Low) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, pos = [], []
        for page_id, as_site, first, kinds, levels, flags, keys, own in zip(*(c.to_pylist() for c in b.columns)):
            is_low, lead_low = low.of(as_site, own)
            body = body_flags(first, kinds, levels, flags, keys, is_low, lead_low)
            gone = [i for i, (k, f) in enumerate(zip(body, flags)) if not k and f & 1]
            ids.extend([page_id] * len(gone))
            pos.extend(gone)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int64())], ["page_id", "pos"])


def boilerplate(page_docs: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, pos) of every block with text that is not part of its page's main body."""
    structured = materialize(analyse(page_docs.select("page_id", "url", "title", "blocks"), site_names(sites)), "structure")
    ready, low = with_low(structured, low_contents(structured, sites))
    ready = ready.select("page_id", "as_site", "first", "kinds", "levels", "flags", "keys", "low")
    return ready.mapInArrow(lambda it: _boilerplate(it, low), "page_id bigint, pos bigint").dropDuplicates()


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p4_found."""
    return boilerplate(pages(spark, data_dir, PAGE_SCHEMA), table(spark, data_dir, "sites"))

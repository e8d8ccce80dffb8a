"""Problem 3: lines that one site repeats too often, and pages without them.

Every line of a block (tables have none) is reduced to its letters in the folded text. Postings (site, line, variant,
page) become compressed bitmaps; the bitmaps of a line's variants are united and their exact cardinalities compared
with the site's number of pages. A line is deleted from a page if the page is in the bitmap of a repeated line of its
site: the bitmaps of the repeated lines are held by every task up to ``HELD`` containers and ``HELD_BYTES`` (counted
first), and the pages pass by in one go. Beyond that the lines meet the bitmaps by (site, line, container), which
spreads a line of the largest site over its containers.

Defined results: a page without a usable url belongs to no site; a line without letters is ignored; null blocks,
spans and texts count as empty; a redelivered page counts once; an empty table has no repeated line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.bitmaps import Lookup, cardinalities, united
from pagewright.llm.common import Flat, host_of, line_key, pages
from pagewright.plans.stages import join_small, materialize, once

#: A repeated line stands on at least so many pages of its site, and on at least this percentage of them.
LEAST_PAGES = 5
LEAST_PERCENT = 10
PAGES = "page_id bigint, url string, blocks array<struct<kind:string,level:int,marker:string,spans:array<struct<text:string,link:int,image:boolean>>>>"
PAGES_WITH_CELLS = PAGES.replace(",image:boolean>>>>", ",image:boolean>>,cell_rows:array<array<array<struct<text:string>>>>>>")
CACHE = 200_000
#: Containers of repeated lines' bitmaps, and their bytes, that every task holds at most.
HELD, HELD_BYTES = 1_000_000, 1 << 26
#: Redelivered pages' ids that are broadcast at most (16 bytes each).
ID_ROWS = 4_000_000
SCHEMA = "page_id bigint, site bigint, pos int, line_no int, key bigint, variant bigint"


def hash64(s: str) -> int:
    """A signed 64-bit hash of a text, never 0 (0 stands for the page itself)."""
    return (xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)) or 1


_lines: dict[str, tuple[int, int]] = {}


def _line(text: str) -> tuple[int, int]:
    known = _lines.get(text)
    if known is None:
        key = line_key(text)
        known = (hash64(key), hash64(text)) if key else (0, 0)
        if len(text) < 120:
            if len(_lines) >= CACHE:
                _lines.clear()
            _lines[text] = known
    return known


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            flat = Flat(b)
            ids = b.column(0).to_pylist()
            sites = [hash64(h) if (h := host_of(u)) else None for u in b.column(1).to_pylist()]
            rows: list[tuple[int, int, int, int, int, int]] = [(i, s, -1, -1, 0, 0) for i, s in zip(ids, sites) if s is not None and i is not None]
            for page, pos, kind, text in zip(flat.page.tolist(), flat.pos.tolist(), flat.kind, flat.text):
                if sites[page] is None or not text or kind == "table" or ids[page] is None:
                    continue
                for n, line in enumerate(text.split("\n")):
                    key, variant = _line(line)
                    if key:
                        rows.append((ids[page], sites[page], pos, n, key, variant))
            if rows:
                cols = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4]), pa.array(cols[5])],
                    ["page_id", "site", "pos", "line_no", "key", "variant"],
                )


def lines(page_docs: DataFrame) -> DataFrame:
    """The lines of pages (page_id, url, blocks) as hashes; a row with key 0 stands for the page itself."""
    return page_docs.select("page_id", "url", "blocks").mapInArrow(_page_lines, SCHEMA)


def repeated(found_lines: DataFrame, least_pages: int = LEAST_PAGES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(site, key, high, bits): the bitmaps of the lines of ``found_lines`` that their site repeats too often."""
    bitmaps = materialize(united(found_lines.withColumn("zone", F.lit(0))), "line-bitmaps")
    counts = materialize(cardinalities(found_lines, bitmaps).where((F.col("key") == 0) | (F.col("pages") >= least_pages)), "line-counts")
    sites = counts.where("key = 0").select("site", F.col("pages").alias("site_pages"))
    often = counts.where("key <> 0").join(sites, "site").where(F.col("pages") * 100 >= F.col("site_pages") * least_percent)
    return materialize(join_small(bitmaps.select("site", "key", "high", "bits"), often.select("site", "key"), ["site", "key"]), "repeated")


def held(bitmaps: DataFrame) -> Lookup | None:
    """The bitmaps for every task, if they are few and small enough."""
    size = bitmaps.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("bytes")).first()
    if size["n"] > HELD or size["bytes"] > HELD_BYTES:
        return None
    rows = bitmaps.collect()
    return Lookup(*(np.array([r[c] for r in rows], np.int64) for c in ("site", "key", "high")), [bytes(r["bits"]) for r in rows])


def _hits(all_lines: DataFrame, bitmaps: DataFrame, lookup: Lookup | None) -> DataFrame:
    """(page_id, pos, line_no) of the lines whose page is in the bitmap of a repeated line."""
    rows = all_lines.where("key <> 0").select("page_id", "site", "pos", "line_no", "key")
    if lookup is None:  # a page whose line and container are there is in the bitmap: it was built of these lines
        return rows.join(bitmaps.select("site", "key", "high"), (F.shiftright(rows["page_id"], 16) == bitmaps["high"]) & (rows["site"] == bitmaps["site"]) & (rows["key"] == bitmaps["key"])).select(rows["page_id"], "pos", "line_no")
    shared = all_lines.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = shared.value.has(*(np.asarray(b.column(c)) for c in ("site", "key", "page_id")))
            yield b.select(["page_id", "pos", "line_no"]).filter(pa.array(gone))

    return rows.mapInArrow(run, "page_id bigint, pos int, line_no int")


def find(page_docs: DataFrame) -> DataFrame:
    """(page_id, pos, line_no) of every occurrence of a repeated line."""
    all_lines = materialize(lines(page_docs), "lines")
    bitmaps = repeated(all_lines)
    hits = _hits(all_lines, bitmaps, held(bitmaps))
    return hits.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("line_no").cast("bigint").alias("line_no")).dropDuplicates()


CLEAN = "page_id bigint, pos bigint, text string"


def _clean(b: pa.RecordBatch, flat: Flat, gone: Callable[[int, int, list[str]], list[bool]]) -> pa.RecordBatch | None:
    """CLEAN of a batch of pages; ``gone`` tells which lines of a block (page in the batch, place of the block, lines) go."""
    ids = b.column("page_id").to_pylist()
    rows = []
    for i, (page, pos, kind, text) in enumerate(zip(flat.page.tolist(), flat.pos.tolist(), flat.kind, flat.text)):
        if kind == "table":
            if (cells := flat.table_text(i)).strip():
                rows.append((page, ids[page], pos, cells))
        elif text:
            all_ = text.split("\n")
            kept = [x for x, g in zip(all_, gone(page, pos, all_)) if not g]
            if kept:
                rows.append((page, ids[page], pos, "\n".join(kept)))
    full = {r[0] for r in rows}
    rows.extend((page, i, -1, "") for page, i in enumerate(ids) if page not in full)
    if not rows:
        return None
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["page_id", "pos", "text"])


def clean(page_docs: DataFrame, lookup: Lookup) -> DataFrame:
    """CLEAN of every page in one pass: its lines are looked up in the bitmaps of the repeated lines; no page is shuffled
    but the redelivered ones."""
    shared = page_docs.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                flat = Flat(b)
                ids = b.column("page_id").to_pylist()
                sites = [hash64(h) if (h := host_of(u)) else None for u in b.column("url").to_pylist()]
                asked = []
                for page, pos, kind, text in zip(flat.page.tolist(), flat.pos.tolist(), flat.kind, flat.text):
                    if text and kind != "table" and sites[page] is not None and ids[page] is not None:
                        asked.extend((sites[page], k, ids[page], page, pos, n) for n, line in enumerate(text.split("\n")) if (k := _line(line)[0]))
                goes: set[tuple[int, int, int]] = set()
                if asked:
                    c = np.array(asked, np.int64).T
                    goes = set(map(tuple, c[3:, shared.value.has(c[0], c[1], c[2])].T.tolist()))
                out = _clean(b, flat, lambda page, pos, all_: [(page, pos, n) in goes for n in range(len(all_))])
                if out is not None:
                    yield out

    return once(page_docs.select("page_id", "url", "blocks"), "page_id", ID_ROWS).mapInArrow(run, CLEAN)


def without(page_docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(page_id, pos, text): the text of every block that has one, without the lines of ``hits``; a page counts once.

    A block that consists of such lines only is left out; a table has its cells as text, a line for each row, and loses none.
    A page of which nothing is left is one row of pos -1 and an empty text.
    """
    drop = hits.groupBy("page_id").agg(F.collect_list(F.struct("pos", "line_no")).alias("drop"))  # of one page: bounded by its lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            goes = [{(d["pos"], d["line_no"]) for d in ds} if ds else set() for ds in b.column("drop").to_pylist()]
            out = _clean(b, Flat(b), lambda page, pos, all_: [(pos, n) in goes[page] for n in range(len(all_))])
            if out is not None:
                yield out

    return once(page_docs.select("page_id", "blocks"), "page_id", ID_ROWS).join(drop, "page_id", "left").select("page_id", "blocks", "drop").mapInArrow(run, CLEAN)


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p3_found."""
    return find(pages(spark, data_dir, PAGES))


def cleaned(spark: SparkSession, data_dir: str) -> DataFrame:
    """p3_pages: every page's text without the lines that its site repeats."""
    page_docs = pages(spark, data_dir, PAGES_WITH_CELLS)
    all_lines = materialize(lines(pages(spark, data_dir, PAGES)), "lines")
    bitmaps = repeated(all_lines)
    lookup = held(bitmaps)
    return without(page_docs, _hits(all_lines, bitmaps, None).distinct()) if lookup is None else clean(page_docs, lookup)

"""Compressed bitmaps of pages, built in partitions, united after one shuffle.

A bitmap is kept as containers of 65,536 page ids: a sorted array of 16-bit places while it has fewer than 4,096, a
bit set of 8 KB from there on. Partitions build the containers of their own pages for every variant of a line;
containers of the same line, whatever its variant or partition, are united by (site, zone, key, container), so a
line that stands on every page of the largest site still reaches many tasks, each with bounded memory. United bitmaps
may be kept and looked up: ``Lookup`` holds those of a bounded number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRAY_MOST = 4095
BITSET = 8192
FLUSH_ROWS = 500_000

_GROUP = ["site", "zone", "key", "high"]


def pack(site: np.ndarray, zone: np.ndarray, key: np.ndarray, variant: np.ndarray, page: np.ndarray) -> pa.RecordBatch | None:
    """The containers of postings: a row for each (site, zone, key, variant, page id // 65,536)."""
    if not len(page):
        return None
    with np.errstate(over="ignore"):
        mixed = (key ^ (site * np.int64(0x9E3779B97F4A7C1)) ^ (variant * np.int64(0x2545F4914F6CDD1D))) * np.int64(31) + zone
    order = np.lexsort((page, mixed))
    site, zone, key, variant, page, mixed = site[order], zone[order], key[order], variant[order], page[order], mixed[order]
    same = np.zeros(len(page), bool)
    same[1:] = (mixed[1:] == mixed[:-1]) & (key[1:] == key[:-1]) & (site[1:] == site[:-1]) & (zone[1:] == zone[:-1]) & (variant[1:] == variant[:-1])
    keep = ~same
    keep[1:] |= page[1:] != page[:-1]  # a page counts once
    high = page >> 16
    first = keep & ~same
    first[1:] |= keep[1:] & (high[1:] != high[:-1])
    starts = np.flatnonzero(first[keep])
    low = (page[keep] & 0xFFFF).astype(np.uint16)
    sizes = np.diff(np.r_[starts, len(low)])
    at = np.flatnonzero(first)
    if (sizes <= ARRAY_MOST).all():
        offsets = np.r_[starts, len(low)].astype(np.int32) * 2
        payload = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low))])
    else:
        out = []
        for a, n in zip(starts.tolist(), sizes.tolist()):
            part = low[a : a + n]
            if n > ARRAY_MOST:
                bits = np.zeros(65536, np.uint8)
                bits[part] = 1
                part = np.packbits(bits)
            out.append(part.tobytes())
        payload = pa.array(out, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(site[at]), pa.array(zone[at].astype(np.int32)), pa.array(key[at]), pa.array(high[at]), payload], [*_GROUP, "bits"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        out = pack(*(np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("site", "zone", "key", "variant", "page_id")))
        held.clear()
        if out is not None:
            for a in range(0, out.num_rows, 50_000):
                yield out.slice(a, 50_000)

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= FLUSH_ROWS:
            yield from flush()
            rows = 0
    if rows:
        yield from flush()


def _containers(group: np.ndarray, low: np.ndarray, groups: int) -> pa.Array:
    """The payload of each group's container, of its sorted members."""
    sizes = np.bincount(group, minlength=groups)
    ends = np.r_[0, np.cumsum(sizes)]
    low = np.ascontiguousarray(low.astype(np.uint16))
    if (sizes <= ARRAY_MOST).all():
        return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(low)])
    out = []
    for a, z in zip(ends.tolist(), ends[1:].tolist()):
        part = low[a:z]
        if z - a > ARRAY_MOST:
            bits = np.zeros(65536, np.uint8)
            bits[part] = 1
            part = np.packbits(bits)
        out.append(part.tobytes())
    return pa.array(out, pa.binary())


def _counts(t: pa.Table) -> pa.RecordBatch:
    """The union of each group's containers and its exact cardinality, of rows sorted by group."""
    cols = [np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in _GROUP]
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    group = np.cumsum(new) - 1
    bits = t.column("bits").combine_chunks()
    length = np.diff(np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1])
    arrays = np.flatnonzero(length != BITSET)
    taken = bits.take(pa.array(arrays))
    values = np.frombuffer(taken.buffers()[2], np.uint16, count=int(length[arrays].sum()) // 2) if len(arrays) else np.zeros(0, np.uint16)
    members = [np.repeat(group[arrays], length[arrays] // 2) << 16 | values]
    for i in np.flatnonzero(length == BITSET).tolist():
        members.append(group[i] << 16 | np.flatnonzero(np.unpackbits(np.frombuffer(bits[i].as_buffer(), np.uint8))))
    united = np.unique(np.concatenate(members))
    groups = int(group[-1]) + 1
    pages = np.bincount(united >> 16, minlength=groups)
    at = np.flatnonzero(new)
    payload = _containers(united >> 16, united & 0xFFFF, groups)
    return pa.RecordBatch.from_arrays([pa.array(cols[0][at]), pa.array(cols[1][at].astype(np.int32)), pa.array(cols[2][at]), pa.array(cols[3][at]), pa.array(pages), payload], UNITED_COLUMNS)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cardinalities of a partition sorted by group; a group's rows may run across batches."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        last = [t.column(c)[-1].as_py() for c in _GROUP]
        same = np.ones(t.num_rows, bool)
        for c, v in zip(_GROUP, last):
            same &= np.asarray(t.column(c)) == v
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = t.slice(cut)
        if cut:
            yield _counts(t.slice(0, cut))
    if held is not None and held.num_rows:
        yield _counts(held)


UNITED = "site bigint, zone int, key bigint, high bigint, pages bigint, bits binary"
UNITED_COLUMNS = [f.split()[0] for f in UNITED.split(", ")]


def united(postings: DataFrame) -> DataFrame:
    """UNITED: the united bitmap of each line's pages, by container, of postings (site, zone, key, variant, page_id).
    Repeated postings, of redelivered pages too, count once."""
    packed = postings.select("site", F.col("zone").cast("int"), "key", "variant", "page_id").mapInArrow(_packed, "site bigint, zone int, key bigint, high bigint, bits binary")
    return packed.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_united, UNITED)


def cardinalities(postings: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """(site, zone, key, pages): on how many distinct pages of its site a line stands, of postings or of their ``bitmaps``."""
    # a line of one container is complete in its row; only the counts of larger ones are summed
    return (united(postings) if bitmaps is None else bitmaps).groupBy("site", "zone", "key").agg(F.sum("pages").alias("pages"))


class Lookup:
    """Whether a page is in the bitmap of a line of a site, for arrays of them; of a bounded number of containers."""

    def __init__(self, site: np.ndarray, key: np.ndarray, high: np.ndarray, bits: list[bytes]):
        order = np.lexsort((high, key, site))
        self.site, self.key, self.high = site[order], key[order], high[order]
        mixed = self._mix(self.site, self.key, self.high)
        by_hash = np.argsort(mixed, kind="stable")
        self.mixed, self.place = mixed[by_hash], by_hash
        self.same = int(np.diff(np.flatnonzero(np.r_[True, self.mixed[1:] != self.mixed[:-1], True])).max(initial=1))  # hashes that meet
        dense = np.array([len(bits[i]) == BITSET for i in order], bool)
        self.dense = np.where(dense, np.cumsum(dense) - 1, -1)
        self.words = np.frombuffer(b"".join(bits[i] for i in order[dense]), np.uint8)
        few = np.flatnonzero(~dense)
        self.members = np.concatenate([np.zeros(0, np.int64), *(at << 16 | np.frombuffer(bits[order[at]], np.uint16).astype(np.int64) for at in few)])

    @staticmethod
    def _mix(site: np.ndarray, key: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((site * np.int64(0x9E3779B97F4A7C1)) ^ key) * np.int64(0x2545F4914F6CDD1D) + high

    def has(self, site: np.ndarray, key: np.ndarray, page: np.ndarray) -> np.ndarray:
        out = np.zeros(len(site), bool)
        if not len(self.mixed) or not len(site):
            return out
        high, low = page >> 16, page & 0xFFFF
        first = np.searchsorted(self.mixed, self._mix(site, key, high))
        for step in range(self.same):
            at = self.place[np.minimum(first + step, len(self.mixed) - 1)]
            hit = np.flatnonzero((self.site[at] == site) & (self.key[at] == key) & (self.high[at] == high))
            at = at[hit]
            dense = self.dense[at] >= 0
            d, i = at[dense], hit[dense]
            out[i] |= self.words[self.dense[d] * BITSET + (low[i] >> 3)] >> (7 - (low[i] & 7)).astype(np.uint8) & 1 == 1
            d, i = at[~dense], hit[~dense]
            if len(self.members):
                member = d << 16 | low[i]
                out[i] |= self.members[np.minimum(np.searchsorted(self.members, member), len(self.members) - 1)] == member
        return out

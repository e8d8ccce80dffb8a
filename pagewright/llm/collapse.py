"""Problem 6: records that differ only in formatting, collapsed into one each with the number of copies.

The canonical form of a record keeps its letters, marks, digits and symbols in lower case, words apart by one blank;
the parameters of a url and the parts of a title around a separator are sorted. It is computed once and kept in a
table of the shared folder. Bloom filters are of canonical hashes, of those seen once and those seen again: partitions
emit the bits that they set, chunk by chunk, as a list of places while there are few; merging two partitions' chunks, a
bit that both have seen once counts as seen again. Only rows whose bits were all seen again are shuffled and grouped
by their exact canonical form; every other row is a record of its own.

The filters grow with the rows: the hashes are divided into ranges, each with a filter of its own of ``MOST_BITS`` bits
at most and ``BITS_PER_ROW`` a row at any number of rows. ``HELD`` ranges at a time are broadcast; the canonical forms
are written into a folder for each such group of ranges, so every row is read once and meets its own range only.

Defined results: a null kind or target counts as empty, a null title as an empty one; a title of punctuation only is
empty; a redelivered row (same item_id) counts once; texts of any length are compared whole; an empty table gives
none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.stages import materialize
from pagewright.sources.tables import table

BITS_PER_ROW = 16
#: Bits of one range's filter at most, a power of two, and ranges whose filters a task holds at a time (256 MB).
MOST_BITS = 1 << 28
HELD = 8
PROBES = 3
CHUNK = 1 << 20
FLUSH_ROWS = 500_000
#: A record with more rows than this part of all rows is hot; so there are at most ``1 / HOT`` of them.
HOT = 1 / 1000

#: Characters between words: punctuation, blanks, controls and the signs used as separators.
_BETWEEN = r"[\p{P}\p{Z}\p{C}\s|｜¦~^`´¨<>=+]+"
#: A separator of a title's parts: a bar anywhere, another sign between blanks.
_SEPARATOR = r"\s*[|｜¦]\s*|\s+[·•:：‧∙»›>/\-‐‑‒–—―]+\s+"


def words(c: Column) -> Column:
    """The words of a text in lower case (ß as ss, its form in capitals), one blank between them."""
    low = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.trim(F.regexp_replace(low, _BETWEEN, " "))


def _sorted_parts(parts: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.transform(parts, words), lambda p: p != "")), " ")


def canonical_target(kind: Column, target: Column) -> Column:
    target = F.coalesce(target, F.lit(""))
    address = F.split(target, "#", 2)
    fragment = F.coalesce(F.get(address, F.lit(1)), F.lit(""))
    query = F.split(F.get(address, F.lit(0)), r"\?", 2)
    fields = _sorted_parts(F.split(F.coalesce(F.get(query, F.lit(1)), F.lit("")), "[&;]"))
    url = F.concat_ws("\n", words(F.get(query, F.lit(0))), fields, words(fragment))
    return F.when(kind == "url", url).otherwise(words(target))


def canonical_title(title: Column) -> Column:
    return _sorted_parts(F.split(F.coalesce(title, F.lit("")), _SEPARATOR))


def keyed(items: DataFrame) -> DataFrame:
    """(item_id, kind, target_key, title_key, h): each item's canonical form and its 64-bit hash."""
    kind = F.coalesce(F.lower(F.trim("kind")), F.lit(""))
    out = items.select("item_id", kind.alias("kind"), canonical_target(kind, F.col("target")).alias("target_key"), canonical_title(F.col("title")).alias("title_key"))
    return out.withColumn("h", F.xxhash64("kind", "target_key", "title_key"))


class Layout(NamedTuple):
    """How the hashes are divided: ``ranges`` filters of ``bits`` bits, ``HELD`` of them to a group."""

    bits: int
    ranges: int

    @classmethod
    def of(cls, rows: int, most_bits: int) -> Layout:
        bits = 1 << 13
        while bits < min(BITS_PER_ROW * rows, most_bits):
            bits *= 2
        return cls(bits, max(1, -(-BITS_PER_ROW * rows // bits)))

    @property
    def groups(self) -> int:
        return -(-self.ranges // HELD)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The bits of each hash among all ranges' filters, one after another: double hashing on its two halves."""
        u = h.view(np.uint64)
        a, b = u >> np.uint64(32), (u & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        mix = a * np.uint64(0x9E3779B1) + b
        inside = np.stack([(mix + np.uint64(i) * b + (a << np.uint64(i))) % np.uint64(self.bits) for i in range(PROBES)], axis=1).astype(np.int64)
        return inside + (np.mod(h, self.ranges) * self.bits)[:, None]


def _or_into(packed: np.ndarray, places: np.ndarray) -> None:
    """Set bits given by sorted, distinct places."""
    if len(places):
        byte = places >> 3
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        packed[byte[first]] |= np.bitwise_or.reduceat((1 << (places & 7)).astype(np.uint8), first)


def _has(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _pieces(h: np.ndarray, layout: Layout) -> Iterator[tuple[int, bytes, bytes]]:
    """The chunks of the filters of some hashes: (chunk, bits seen, bits seen again), few bits as a list of places."""
    # a place counts once a row, so that two probes of one row that meet do not look like two rows
    places = np.sort(layout.places(h), axis=1)
    fresh = np.ones(places.shape, bool)
    fresh[:, 1:] = places[:, 1:] != places[:, :-1]
    place, count = np.unique(places[fresh], return_counts=True)
    chunk = place // (CHUNK * 8)
    starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(place) else []
    for a, z in zip(starts, [*starts[1:], len(place)]):
        inside = place[a:z] - chunk[a] * CHUNK * 8
        yield int(chunk[a]), _written(inside), _written(inside[count[a:z] > 1])


def _written(places: np.ndarray) -> bytes:
    if len(places) * 4 < CHUNK:
        return places.astype(np.uint32).tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    _or_into(bits, places)
    return bits.tobytes()


def _bits(piece: pa.Buffer) -> np.ndarray:
    if piece.size == CHUNK:
        return np.frombuffer(piece, np.uint8)
    bits = np.zeros(CHUNK, np.uint8)
    _or_into(bits, np.frombuffer(piece, np.uint32).astype(np.int64))
    return bits


def _partition_filters(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for chunk, once, again in _pieces(np.concatenate(held), layout):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([once], pa.binary()), pa.array([again], pa.binary())], ["chunk", "once", "again"])
        held.clear()

    for b in batches:
        held.append(np.asarray(b.column(0)))
        rows += b.num_rows
        if rows >= FLUSH_ROWS:
            yield from flush()
            rows = 0
    if rows:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filters of all partitions, chunk by chunk (rows sorted by chunk): what two saw once was seen again."""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([merged[1].tobytes()], pa.binary())], ["chunk", "again"])

    at, merged = None, None
    for b in batches:
        for chunk, once, again in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            if chunk != at:
                if merged is not None:
                    yield done()
                at, merged = chunk, [np.zeros(CHUNK, np.uint8), np.zeros(CHUNK, np.uint8)]
            seen = _bits(once.as_buffer())
            merged[1] |= _bits(again.as_buffer()) | (merged[0] & seen)
            merged[0] |= seen
    if merged is not None:
        yield done()


def merged_filters(hashes: DataFrame, layout: Layout) -> DataFrame:
    """(chunk, again): the bits of all filters that were seen more than once."""
    parts = hashes.select("h").mapInArrow(lambda it: _partition_filters(it, layout), "chunk bigint, once binary, again binary")
    chunks = -(-layout.bits * layout.ranges // 8 // CHUNK)
    return parts.repartition(min(chunks, 512), "chunk").sortWithinPartitions("chunk").mapInArrow(_merge, "chunk bigint, again binary")


def _marked(keys: DataFrame, filters: DataFrame, layout: Layout, group: int) -> DataFrame:
    """The keyed items of a group of ranges, with whether they may be repeated."""
    spark = keys.sparkSession
    first = group * HELD * layout.bits
    last = min((group + 1) * HELD, layout.ranges) * layout.bits
    held = np.zeros((last - first) // 8, np.uint8)  # bounded by HELD filters
    own = filters.where((F.col("chunk") >= first // 8 // CHUNK) & (F.col("chunk") <= (last // 8 - 1) // CHUNK))
    for r in own.toLocalIterator():
        at = r["chunk"] * CHUNK - first // 8  # a chunk may begin before the group or end after it
        part = np.frombuffer(r["again"], np.uint8)[max(0, -at) : max(0, len(held) - at)]
        held[max(0, at) : max(0, at) + len(part)] = part
    again = spark.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def repeated(h: pa.Array) -> pa.Array:
        places = layout.places(np.asarray(h)) - first
        return pa.array(_has(again.value, places.ravel()).reshape(places.shape).all(axis=1))

    return keys.where(F.col("part") == group).withColumn("repeated", repeated("h"))


def split_repeats(items: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(possible repeats, singletons) of keyed items."""
    layout = Layout.of(items.count(), most_bits)
    part = F.floor(F.pmod("h", F.lit(layout.ranges)) / HELD).cast("int") if layout.groups > 1 else F.lit(0)
    keys = materialize(keyed(items).withColumn("part", part), "records", "part" if layout.groups > 1 else None)
    filters = materialize(merged_filters(keys, layout), "filters")
    marked = reduce(DataFrame.unionByName, [_marked(keys, filters, layout, g) for g in range(layout.groups)])
    return marked.where("repeated").drop("repeated", "part"), marked.where("NOT repeated").drop("repeated", "part")


KEY = ["kind", "target_key", "title_key"]


def _grouped(possible: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = materialize(possible.select("item_id", *KEY).distinct(), "repeats")
    return rows, rows.groupBy(KEY).agg(F.min("item_id").alias("keep_id"), F.count("*").alias("copies"))


def collapse(items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(keep_id, copies): one row per record, with how many items it was."""
    possible, single = split_repeats(items, most_bits)
    _, groups = _grouped(possible)
    return groups.select("keep_id", "copies").unionByName(single.select(F.col("item_id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies")))


def copies(items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(keep_id, copy_id): every copy with its record's smallest item."""
    possible, _ = split_repeats(items, most_bits)
    rows, groups = _grouped(possible)
    groups = groups.where("copies > 1")
    # the few hot records meet their rows by broadcast (at most 1 / HOT rows), so no task gets all rows of one
    least = max(1, int(rows.count() * HOT))
    hot = F.broadcast(groups.where(F.col("copies") > least))
    cold = rows.join(hot.select(KEY), KEY, "left_anti").join(groups.where(F.col("copies") <= least), KEY)
    out = rows.join(hot, KEY).select("keep_id", "item_id").unionByName(cold.select("keep_id", "item_id"))
    return out.where("item_id <> keep_id").select("keep_id", F.col("item_id").alias("copy_id"))


def found(spark: SparkSession, data_dir: str) -> DataFrame:
    """p6_found."""
    return copies(table(spark, data_dir, "items", "item_id bigint, kind string, target string, title string"))

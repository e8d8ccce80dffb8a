"""Problem 9: filling containers of fixed capacity by linear grouping.

Sizes are whole numbers up to the capacity, so their histogram is bounded by the capacity and all that the driver
plans on is that histogram. The large sizes are cut into groups of equal cardinality and rounded up to the largest
of their group; configurations of these few sizes are optimised one after another (the fullest that the remaining
counts allow, used as often as they allow). The actual documents then take the slots of their group in falling
order, and the small ones go by best fit into the space that the actual sizes leave. The plan is a list of intervals
(size, ranks, first bin, items a bin); executors number the documents of a size by buckets and look their bin up.

Defined results: null and empty texts need no place; a document above the capacity is cut into consecutive pieces,
all full but the last; ties are numbered by doc_id; repeated rows each need a place; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm import tokenize
from pagewright.plans.stages import join_small, materialize
from pagewright.sources.tables import table

CAPACITY = 2048
#: A size above this part of the capacity is large.
LARGE = 1 / 8
#: Groups of the large sizes.
GROUPS = 24
#: Rows numbered together at most, for sizes that are no more frequent than a third.
BUCKET_ROWS = 200_000


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """The multiset of group sizes, within what is left, that fills a bin best (bounded subset sums)."""
    reach = np.full(capacity + 1, -1, np.int64)  # the group whose item reaches a sum last, with the count used of it
    used = np.zeros(capacity + 1, np.int64)
    reach[0] = len(sizes)
    for g, s in enumerate(sizes):
        if not left[g]:
            continue
        count = np.where(reach >= 0, 0, -1)
        for total in range(s, capacity + 1):
            if reach[total] < 0 and 0 <= count[total - s] < left[g]:
                count[total] = count[total - s] + 1
                reach[total], used[total] = g, count[total]
    total = int(np.flatnonzero(reach >= 0)[-1])
    config = [0] * len(sizes)
    while total:
        g = int(reach[total])
        config[g] += int(used[total])
        total -= int(used[total]) * sizes[g]
    return config


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (size, first rank, last rank + 1, first bin, items a bin) and the number of bins."""
    out: list[tuple[int, int, int, int, int]] = []
    bins = histogram.get(capacity, 0)
    if bins:
        out.append((capacity, 0, bins, 0, 1))
    cut = int(capacity * large)
    big = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if cut < s < capacity and histogram[s]]
    # linear grouping: equal cardinality; a size that lies across a border belongs to both its groups
    total = sum(n for _, n in big)
    per = -(-total // groups) if total else 1
    members: list[list[tuple[int, int, int]]] = []  # of a group: size, first rank within the size, count
    room = 0
    for s, n in big:
        at = 0
        while at < n:
            if not room:
                members.append([])
                room = per
            take = min(room, n - at)
            members[-1].append((s, at, take))
            at, room = at + take, room - take
    rounded = [m[0][0] for m in members]
    left = [sum(n for *_, n in m) for m in members]
    configs: list[tuple[list[int], int, int]] = []  # configuration, first bin, bins
    while any(left):
        config = _configuration(rounded, left, capacity)
        times = min(n // k for n, k in zip(left, config) if k)
        configs.append((config, bins, times))
        bins += times
        left = [n - k * times for n, k in zip(left, config)]
    # substitution: the slots of a group, in the order of the bins, take its documents in falling order
    edges: list[dict[int, list[tuple[int, int, int]]]] = []
    base = [0] * len(members)
    free: list[list[int]] = []  # free space, first bin, bins
    runs = [np.cumsum([0] + [n for *_, n in m]) for m in members]
    for config, first, times in configs:
        borders = {0, times}
        for g, k in enumerate(config):
            if not k:
                continue
            lo, hi = base[g], base[g] + k * times
            for i, (s, at, n) in enumerate(members[g]):
                a, b = max(lo, int(runs[g][i])), min(hi, int(runs[g][i + 1]))
                if a >= b:
                    continue
                r = at - int(runs[g][i])  # rank within the size of slot 0
                q0, q1 = (a - lo) // k, -(-(b - lo) // k)
                borders.update((q0, q1, -(-(a - lo) // k), (b - lo) // k))
                # whole bins by one interval, the ends of a shared bin by their own
                x = a
                while x < b:
                    q = (x - lo) // k
                    if x == lo + q * k and b - x >= k:
                        y = x + (b - x) // k * k
                        out.append((s, r + x, r + y, first + q, k))
                    else:
                        y = min(b, lo + (q + 1) * k)
                        out.append((s, r + x, r + y, first + q, y - x))
                    x = y
        cuts = sorted(borders)
        for q0, q1 in zip(cuts, cuts[1:]):
            used = 0
            for g, k in enumerate(config):
                for j in range(k):
                    slot = base[g] + q0 * k + j
                    used += members[g][int(np.searchsorted(runs[g], slot, "right")) - 1][0]
            free.append([capacity - used, first + q0, q1 - q0])
        for g, k in enumerate(config):
            base[g] += k * times
    del edges
    # best fit of the small sizes into the free space, in bulk: segments of bins with the same space
    segments = sorted((f, first, n) for f, first, n in free if f)
    for s in sorted((s for s in histogram if 0 < s <= cut), reverse=True):
        rank, n = 0, histogram[s]
        while n:
            i = bisect_left(segments, (s,))
            if i == len(segments):
                need = -(-n // (capacity // s))
                insort(segments, (capacity, bins, need))
                bins += need
                continue
            f, first, count = segments.pop(i)
            q = f // s
            whole = min(count, n // q)
            if whole:
                out.append((s, rank, rank + whole * q, first, q))
                rank, n = rank + whole * q, n - whole * q
                if f - q * s:
                    insort(segments, (f - q * s, first, whole))
            if whole < count:
                if 0 < n < q:
                    out.append((s, rank, rank + n, first + whole, n))
                    if f - n * s:
                        insort(segments, (f - n * s, first + whole, 1))
                    rank, n, whole = rank + n, 0, whole + 1
                if whole < count:
                    insort(segments, (f, first + whole, count - whole))
    return sorted(out), bins


def sizes(documents: DataFrame, capacity: int = CAPACITY, folder: str = tokenize.TOKENIZERS, name: str = tokenize.NAME) -> DataFrame:
    """(doc_id, piece, size): the pieces of every document with a token."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(tokenize.read_vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, split = tokenize.load(vocabulary.value)
        get, find = words.__getitem__, split.findall
        for b in batches:
            n = np.array([sum(map(len, map(get, find(t)))) if t else 0 for t in b.column(1).to_pylist()], np.int64)
            pieces = -(-n // capacity)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), pieces)))
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(np.repeat(n, pieces) - piece * capacity, capacity)
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece), pa.array(size)], ["doc_id", "piece", "size"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, piece bigint, size bigint")


def fill(sized: DataFrame, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> DataFrame:
    """(bin, doc_id, piece, size) of rows (doc_id, piece, size); rows without size or without room need no place."""
    spark = sized.sparkSession
    sized = materialize(sized.where(F.col("size").between(1, capacity)).select("doc_id", "piece", "size"), "sized")
    counted = sized.groupBy("size").count()
    histogram = {r["size"]: r["count"] for r in counted.collect()}  # at most as many rows as the capacity
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    intervals, _ = plan(histogram, capacity, large, groups)
    table_ = spark.sparkContext.broadcast(np.array(intervals or [(0, 0, 0, 0, 1)], np.int64))

    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = sized.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("size", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = sized.withColumn("nth", F.row_number().over(W.partitionBy("size", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = join_small(ranked, before, ["size", "bucket"]).select("doc_id", "piece", "size", (F.col("before") + F.col("nth")).cast("bigint").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table_.value
        wide = 1 << 42
        keys = t[:, 0] * wide + t[:, 1]
        for b in batches:
            size, rank = np.asarray(b.column(2)), np.asarray(b.column(3))
            i = np.searchsorted(keys, size * wide + rank, "right") - 1
            at = t[i, 3] + (rank - t[i, 1]) // t[i, 4]
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), b.column(1), b.column(2)], ["bin", "doc_id", "piece", "size"])

    return ranked.mapInArrow(place, "bin bigint, doc_id bigint, piece bigint, size bigint")


def containers(spark: SparkSession, data_dir: str) -> DataFrame:
    """p9_containers: the bin of every piece of every text, in tokens of byte_bpe_50k."""
    return fill(sizes(table(spark, data_dir, "documents", "doc_id bigint, text string")))

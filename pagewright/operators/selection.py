"""Choice of a page's main blocks against a reference text, and between two extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators import blocks as B

# thresholds
COVERED = 0.5
MIN_REFERENCE = 50
SWITCH_PROSE, SWITCH_RATIO, SWITCH_OVERLAP = 300, 1.5, 0.3
HEAD = 20


def selected(blocks: DataFrame, reference: DataFrame) -> DataFrame:
    """(page_id, pos) of the blocks that a reference text covers: matched ones of the heaviest run, and undecided ones
    between matched neighbours. ``blocks``: page_id, pos, kind, spans, text; ``reference``: page_id, ref (normalised)."""
    b = blocks.withColumn("norm", X.norm(F.col("text"))).withColumn("blank", (F.col("text") == "") | B.image_only(F.col("spans")))
    ref = reference.where(F.length("ref") >= MIN_REFERENCE)
    hits = B.coverage(b.where(~F.col("blank") & (F.length("norm") >= 4)), ref)
    b = b.join(ref, "page_id").join(hits, ["page_id", "pos"], "left")
    short = F.contains("ref", "norm")
    match = F.when(F.col("blank") | (F.col("norm") == ""), F.lit(None).cast("boolean")).when(F.length("norm") < 4, short).otherwise(F.col("matched") >= COVERED * F.col("shingles"))
    b = b.select("page_id", "pos", match.alias("match"), F.length("norm").alias("n"))
    weight = F.when(F.col("match").isNull(), 0).when(F.col("match"), F.col("n")).otherwise(-F.col("n"))
    run = B.max_run(b.select("page_id", "pos", weight.alias("weight")))
    inside = b.join(run, "page_id").where("pos BETWEEN first AND last")
    order = W.partitionBy("page_id").orderBy("pos")
    before = F.last("match", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("match", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    return inside.withColumn("before", before).withColumn("after", after).where(F.coalesce("match", F.col("before") & F.col("after"))).select("page_id", "pos")


def prefer_own(own: DataFrame, other: DataFrame) -> DataFrame:
    """(page_id, own_chars, other_chars, common_chars, prefer): whether the own extraction's prose is enough, half more
    than the other's, and mostly not in it. Both sides: (page_id, sentence)."""
    text = other.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(X.norm(F.col("sentence")))), "\n").alias("there"), F.sum(F.length("sentence")).alias("other_chars"))
    s = own.join(text, "page_id", "left").withColumn("size", F.length("sentence"))
    known = F.coalesce(F.contains("there", F.substring(X.norm(F.col("sentence")), 1, HEAD)), F.lit(False))
    out = s.groupBy("page_id").agg(F.sum("size").alias("own_chars"), F.coalesce(F.first("other_chars"), F.lit(0)).alias("other_chars"), F.sum(F.when(known, F.col("size")).otherwise(0)).alias("common_chars"))
    prefer = (F.col("own_chars") >= SWITCH_PROSE) & (F.col("own_chars") >= SWITCH_RATIO * F.col("other_chars")) & (F.col("common_chars") < SWITCH_OVERLAP * F.col("own_chars"))
    return out.withColumn("prefer", prefer)


def cleaned(blocks: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, pos, removed, unlinked): blocks of text that consist of links to listed hosts go; elsewhere such spans
    lose their link. ``listed``: (page_id, link)."""
    s = blocks.select("page_id", "pos", "kind", F.posexplode("spans").alias("n", "s"))
    s = s.select("page_id", "pos", "kind", "n", F.col("s.link").alias("link"), (X.solid_length(F.coalesce("s.text", F.lit(""))) == 0).alias("blank"))
    s = s.join(listed.select("page_id", "link").distinct().withColumn("hit", F.lit(True)), ["page_id", "link"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    g = s.groupBy("page_id", "pos").agg(F.first("kind").alias("kind"), F.bool_and(F.col("hit") | F.col("blank")).alias("only"), F.sum(F.col("hit").cast("int")).alias("hits"))
    g = g.where("hits > 0")
    removed = F.col("kind").isin("p", "li", "quote") & F.col("only")
    return g.select("page_id", "pos", removed.alias("removed"), F.when(removed, 0).otherwise(F.col("hits")).cast("bigint").alias("unlinked"))

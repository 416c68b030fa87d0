"""Counting how often two items occur together, exactly, whatever the largest basket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.skew import broadcast_if_small, salted_join
from lodestream.scratch import written

#: Baskets of more items than this are counted by lookup instead of by listing their pairs, where that is possible.
WIDE = 1_000
#: Wide baskets up to which a pair's common ones are read off bit masks, of 62 baskets each, instead of looked up.
MASKED = 16 * 62


def sorted_numbers(items: DataFrame) -> DataFrame:
    """``items`` (column ``i``, distinct) with ``x``: longs in the order of ``i``."""
    return written(items.orderBy("i").withColumn("x", F.monotonically_increasing_id()))


def in_enough_baskets(rows: DataFrame, least: int) -> DataFrame:
    """The rows (s, i) of items with at least ``least`` rows; no other item is in that many baskets."""
    if least <= 1:
        return rows
    often = rows.groupBy("i").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("i")
    return rows.join(broadcast_if_small(often), "i", "left_semi").select("s", "i")


def basket_pairs(rows: DataFrame, wide: int = WIDE) -> DataFrame:
    """s, a, b: every pair a < b of each basket. ``rows``: distinct (s, i).

    A basket of more than ``wide`` items is dealt to several tasks: its items by ``a``, with a copy of all of them as
    ``b`` in each, so no task holds more than ``wide`` items against the basket's own.
    """
    a, b = rows.select("s", F.col("i").alias("a")), rows.select("s", F.col("i").alias("b"))
    return salted_join(a, b, ["s"], F.xxhash64("a"), threshold=wide).filter("a < b").select("s", "a", "b")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"))


def _listed(rows: DataFrame) -> DataFrame:
    """Pairs of each basket, counted; no basket is wide."""
    a, b = rows.select("s", F.col("i").alias("a")), rows.select("s", F.col("i").alias("b"))
    return _counted(a.join(b.hint("merge"), "s").filter("a < b"))


def _masked(narrow: DataFrame, big: DataFrame, wide_baskets: DataFrame, w: int, least: int) -> DataFrame:
    """a, b, common of the pairs that share a narrow basket and reach ``least``.

    Each item carries its wide baskets as bits, so the wide ones a pair shares are known where it is listed. A pair that
    misses ``least`` even if it shared all narrow baskets of its rarer item is dropped there.
    """
    places = F.broadcast(written(wide_baskets.select("s", (F.row_number().over(W.partitionBy().orderBy("s")) - 1).alias("p"))))  # at most MASKED rows
    words = range(-(-w // 62))
    bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("p") / 62) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 62).cast("int")))), F.lit(0).cast("bigint")).alias(f"m{k}") for k in words]
    masks = big.join(places, "s").groupBy("i").agg(*bits)
    known = narrow.groupBy("i").agg(F.count("*").alias("n")).join(masks, "i", "left").select("i", "n", *[F.coalesce(f"m{k}", F.lit(0).cast("bigint")).alias(f"m{k}") for k in words])
    rows = written(narrow.join(known, "i"))
    side = lambda x: rows.select("s", F.col("i").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ["n", *[f"m{k}" for k in words]]])
    shared = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"a_m{k}").bitwiseAND(F.col(f"b_m{k}"))) for k in words])
    pairs = side("a").join(side("b").hint("merge"), "s").filter("a < b").withColumn("more", shared).filter(F.least("a_n", "b_n") + F.col("more") >= least)
    return pairs.groupBy("a", "b").agg((F.count("*") + F.first("more")).alias("common")).filter(F.col("common") >= least)


def pair_counts(kept: DataFrame, least: int, wide: int = WIDE) -> DataFrame:
    """Exact number of common baskets of every pair (a < b) that has at least ``least``. ``kept``: distinct (s, i).

    Pairs of baskets up to ``wide`` items are listed and counted: at most ``wide / 2`` pairs a row. The pairs of wider
    baskets, of which there are at most ``rows / wide``, are not listed. Let W be their number. A pair that reaches
    ``least`` shares a narrow basket, or at least ``least`` wide ones. For the former, the wide baskets of both items are
    compared as bits where the pair is listed; if there are more than ``MASKED``, they are looked up for the pairs listed
    already (if ``W < least``, for those with ``least - W`` narrow baskets). For the latter, only items in at least
    ``least`` wide baskets are paired, and not at all if ``W < least``.
    """
    sizes = kept.groupBy("s").agg(F.count("*").alias("k")).filter(F.col("k") > wide)
    wide_baskets = written(sizes.select("s"))
    w = wide_baskets.count()
    if not w:
        return _listed(kept).filter(F.col("common") >= least)
    big = written(kept.join(wide_baskets, "s", "left_semi"))
    narrow = kept.join(wide_baskets, "s", "left_anti")
    if w <= MASKED:
        listed = total = written(_masked(narrow, big, wide_baskets, w, least))
    else:
        listed = written(_listed(narrow).filter(F.col("common") >= max(1, least - w)))
        with_a = listed.join(big.select("s", F.col("i").alias("a")), "a")
        more = with_a.join(big.select("s", F.col("i").alias("b")), ["s", "b"]).groupBy("a", "b").agg(F.count("*").alias("more"))
        total = listed.join(more, ["a", "b"], "left").select("a", "b", (F.col("common") + F.coalesce("more", F.lit(0))).alias("common"))
    if w >= least:
        often = big.groupBy("i").agg(F.count("*").alias("k")).filter(F.col("k") >= least).select("i")
        only_wide = _counted(basket_pairs(big.join(often, "i", "left_semi"), wide)).filter(F.col("common") >= least).join(listed, ["a", "b"], "left_anti")
        total = total.unionByName(only_wide)
    return total.filter(F.col("common") >= least)

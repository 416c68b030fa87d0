"""Frequent itemsets: counting by levels with Apriori candidates, optional bucket filter, and FP-growth.

The two-pass partition scheme of the classic algorithm serves to bound local memory; its result is exactly the frequent
itemsets. Here each level is a distributed join and count, so there is no local pass to bound: level k joins the
frequent (k-1)-sets that share all but their last item, prunes those with an infrequent subset, and counts the rest in
the baskets of their rarest subset of k-1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.pairs import basket_pairs, in_enough_baskets, pair_counts, sorted_numbers
from lodestream.operators.skew import broadcast_if_small
from lodestream.operators.sketches import text_modulo
from lodestream.scratch import forget, is_written, written

#: Buckets of the pair filter (a fixed value).
BUCKETS = 1_000


def baskets(df: DataFrame, basket: str, item: str, larger_than: int = 0, support: int = 1) -> DataFrame:
    """Distinct (s, i) with both present, of baskets with strictly more than ``larger_than`` different items.

    ``support``: items in fewer rows, which are in fewer baskets too, may be left out before the rows are made distinct;
    with ``larger_than`` they are kept, as they count for the size of a basket.
    """
    rows = df.select(F.col(basket).alias("s"), F.col(item).alias("i")).filter("s is not null and i is not null")
    if larger_than < 1:
        return in_enough_baskets(rows, support).distinct()
    rows = rows.distinct()
    big = rows.groupBy("s").agg(F.count("*").alias("k")).filter(F.col("k") > larger_than).select("s")
    return rows.join(big, "s", "left_semi")


def frequent_items(rows: DataFrame, support: int) -> DataFrame:
    """items (array of one), support."""
    return rows.groupBy("i").agg(F.count("*").alias("support")).filter(F.col("support") >= support).select(F.array("i").alias("items"), "support")


#: Different items up to which a basket is counted as a bit mask.
BITS = 62


def item_number(item: str) -> Column:
    """The number of an item. One that is no whole number goes by its bytes' number."""
    return F.coalesce(F.col(item).try_cast("bigint"), text_modulo(item))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """a, b, bucket, n: pairs a < b of the baskets, the xor of both items' numbers as bucket, in how many baskets.

    A pair may come several times. ``rows``: (s, i), written; a row may be repeated. The number of each different item is
    made once. With at most ``BITS`` items a basket is a mask, and baskets of the same items are one from then on.
    """
    items = written(rows.select("i").distinct().withColumn("h", item_number("i")))
    if items.limit(BITS + 1).count() <= BITS:
        places = F.broadcast(written(items.select("i", "h", (F.row_number().over(W.partitionBy().orderBy("i")) - 1).alias("p"))))
        masks = rows.join(places, "i").groupBy("s").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p"))).alias("m"))
        sets = written(masks.groupBy("m").agg(F.count("*").alias("n")))
        held = sets.select("m", "n", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("p")).filter(F.call_function("shiftright", F.col("m"), F.col("p")).bitwiseAND(F.lit(1)) == 1).join(places, "p")
        a, b = held.select("m", "n", F.col("i").alias("a"), F.col("h").alias("ha")), held.select("m", F.col("i").alias("b"), F.col("h").alias("hb"))
        pairs = a.join(b, "m").filter("a < b").groupBy("a", "b", "ha", "hb").agg(F.sum("n").alias("n"))
    else:
        known = broadcast_if_small(items)
        pairs = basket_pairs(rows.distinct()).withColumn("n", F.lit(1).cast("bigint"))
        for c in ("a", "b"):
            pairs = pairs.join(known.select(F.col("i").alias(c), F.col("h").alias(f"h{c}")), c)
    return pairs.select("a", "b", F.pmod(F.col("ha").bitwiseXOR(F.col("hb")), F.lit(buckets)).alias("bucket"), "n")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many pairs of each basket fall into each hash bucket."""
    return _bucketed(rows if is_written(rows) else written(rows), buckets).groupBy("bucket").agg(F.sum("n").alias("n"))


def pcy_pairs(rows: DataFrame, support: int, buckets: int = BUCKETS) -> DataFrame:
    """items (sorted array of two), support of the frequent pairs, counted in two passes over the baskets.

    The first counts items and buckets; the second counts only pairs of frequent items in buckets that hold at least
    ``support`` pairs, which no frequent pair's bucket can miss. The list of such buckets is at most ``buckets`` long and
    broadcast. Worth it where the buckets are many against the pairs, so that few of them are full. ``rows``: (s, i), a
    row may be repeated; items in fewer rows than the support are in fewer baskets too.
    """
    rows = rows if is_written(rows) else written(rows)
    full = F.broadcast(bucket_counts(rows, buckets).filter(F.col("n") >= support).select("bucket"))
    tried = _bucketed(written(in_enough_baskets(rows, support)), buckets).join(full, "bucket", "left_semi")
    counted = tried.groupBy("a", "b").agg(F.sum("n").alias("support")).filter(F.col("support") >= support)
    return counted.select(F.array("a", "b").alias("items"), "support")


def candidates(level: DataFrame, k: int) -> DataFrame:
    """Sorted k-sets all of whose (k-1)-subsets are in ``level`` (id, items: sorted arrays of k-1, support).

    Columns items, parent (id of the subset of least support), last (the item that one lacks).
    """
    left = level.select(F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("x"))
    right = left.select("prefix", F.col("x").alias("last"))
    joined = left.join(right, "prefix").filter("x < last").select(F.concat("prefix", F.array("x", "last")).alias("items"))
    subsets = joined.select("items", F.posexplode("items").alias("drop", "last")).select("items", "last", F.filter("items", lambda x, i: i != F.col("drop")).alias("sub"))
    have = subsets.join(level.select(F.col("items").alias("sub"), "id", "support"), "sub")
    best = have.groupBy("items").agg(F.count("*").alias("_n"), F.min(F.struct("support", "id", "last")).alias("_m"))
    return best.filter(F.col("_n") == k).select("items", F.col("_m.id").alias("parent"), F.col("_m.last").alias("last"))


def tried_sets(found: DataFrame) -> DataFrame:
    """items of every set that the levels of ``found`` (items, support; complete) make a candidate, of any size.

    The frequent items themselves, all pairs of them, and of k items those whose subsets of k - 1 are all frequent.
    """
    out = found.filter(F.size("items") == 1).select("items")
    single = written(out.select(F.col("items")[0].alias("a")))
    out = out.unionByName(single.crossJoin(broadcast_if_small(single).withColumnRenamed("a", "b")).filter("a < b").select(F.array("a", "b").alias("items")))
    k = 3
    while True:
        level = _numbered(found.filter(F.size("items") == k - 1).select("items", F.lit(0).alias("support")))
        if level.isEmpty():
            return out
        out = out.unionByName(candidates(level, k).select("items"))
        k += 1


def _numbered(df: DataFrame) -> DataFrame:
    return written(df.withColumn("id", F.monotonically_increasing_id()))


def _named(level: DataFrame, items: DataFrame) -> DataFrame:
    """items, support of sets of numbers, with the items themselves."""
    parts = level.select("id", "support", F.posexplode("items").alias("_p", "x")).join(items.select("x", "i"), "x")
    return parts.groupBy("id", "support").agg(F.array_sort(F.collect_list(F.struct("_p", "i"))).alias("_l")).select(F.col("_l.i").alias("items"), "support")


def pair_ends(level: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, i, last of each pair of ``level`` (id, items): its rarer item and the other one. ``sizes``: i, n."""
    a, b = F.col("items")[0], F.col("items")[1]
    both = level.select("id", a.alias("a"), b.alias("b")).join(sizes.select(F.col("i").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b")
    first = F.col("na") <= F.col("nb")
    return both.select("id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("i"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("last"))


def pair_baskets(ends: DataFrame, kept: DataFrame) -> DataFrame:
    """id, s: the baskets of each pair, looked up from those of its rarer item."""
    return ends.join(kept, "i").select("id", "last", "s").join(kept.withColumnRenamed("i", "last"), ["s", "last"]).select("id", "s")


def frequent_itemsets(rows: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """items (sorted array), support of every itemset in at least ``support`` baskets, up to ``most`` items.

    ``rows``: distinct (s, i). Frequent items are numbered in their order, and sets are of numbers until the end. Pairs
    are counted with :func:`lodestream.operators.pairs.pair_counts`, which does not list the pairs of very wide baskets.
    From then on each level keeps where its sets occur: a candidate is looked for only in the baskets of its rarest
    subset. Empty input gives no rows.
    """
    own = not is_written(rows)
    rows = written(rows) if own else rows
    items = sorted_numbers(rows.groupBy("i").agg(F.count("*").alias("support")).filter(F.col("support") >= support))
    levels = [items.select(F.array("i").alias("items"), "support")]
    if most == 1:
        return levels[0]
    kept = written(rows.join(broadcast_if_small(items.select("i", "x")), "i").select("s", F.col("x").alias("i")))
    forget(rows if own else None)
    level = _numbered(pair_counts(kept, support).select(F.array("a", "b").alias("items"), F.col("common").alias("support")))
    found: DataFrame | None = None  # id, s: where the sets of the level occur
    k = 2
    while not level.isEmpty():
        levels.append(_named(level, items))
        k += 1
        if most is not None and k > most:
            break
        cands = _numbered(candidates(level, k))
        if cands.isEmpty():
            break
        if found is None:
            parents = level.join(cands.select(F.col("parent").alias("id")), "id", "left_semi")
            found = written(pair_baskets(pair_ends(parents, items.select(F.col("x").alias("i"), F.col("support").alias("n"))), kept))
        tried = cands.select("id", F.col("parent"), "last").join(found.select(F.col("id").alias("parent"), "s"), "parent").select("id", "last", "s")
        past, hits = found, written(tried.join(kept.withColumnRenamed("i", "last"), ["s", "last"]).select("id", "s"))
        counted = hits.groupBy("id").agg(F.count("*").alias("support")).filter(F.col("support") >= support)
        level = written(cands.select("id", "items").join(counted, "id"))
        found = written(hits.join(level.select("id"), "id", "left_semi"))
        forget(past, hits)
    return reduce(DataFrame.unionByName, levels)


def fp_growth(rows: DataFrame, support: int) -> DataFrame:
    """The same itemsets by Spark's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    lists = written(rows.groupBy("s").agg(F.collect_set("i").alias("items")))
    n = lists.count()
    if not n:
        return lists.select("items", F.lit(0).cast("long").alias("support"))
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(lists).freqItemsets
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))

"""Jaccard similarity of sets with MinHash signatures and bands, verified exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.prefix import prefix_sums
from lodestream.operators.skew import salted_join

#: Prime of the hash family (a fixed value); coefficients are below it.
PRIME = 16_777_619
#: Signature length, bands and rows a band (fixed values).
HASHES, BANDS, ROWS = 50, 25, 2
#: Sets of one bucket beyond which it is dealt to several tasks.
HOT_BUCKET = 1_000


def hash_parameters(n: int = HASHES) -> list[tuple[int, int]]:
    """(a, b) of hash ``(a * x + b) % PRIME``: successive values of a linear congruential sequence, a never 0."""
    x, out = 42, []
    for _ in range(n):
        x = (1_103_515_245 * x + 12_345) % (1 << 31)
        a = x % (PRIME - 1) + 1
        x = (1_103_515_245 * x + 12_345) % (1 << 31)
        out.append((a, x % PRIME))
    return out


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """(key, out): the place, from 0, of each different key in sorted order. Distributed: no single sort task."""
    keys = df.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(keys, [], [key], "_one", out).select(key, (F.col(out) - 1).alias(out))


def signatures(members: DataFrame, params: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """s, sig: array of the least hash of each function over the set's item indexes. ``members``: distinct (s, x).

    All hashes are aggregates of one pass with partial combining, so nothing is exploded by hash function.
    """
    params = params or hash_parameters()
    least = [F.min((F.lit(a) * F.col("x") + F.lit(b)) % F.lit(PRIME)).alias(f"h{i}") for i, (a, b) in enumerate(params)]
    return members.groupBy("s").agg(*least).select("s", F.array(*[f"h{i}" for i in range(len(params))]).alias("sig"))


def band_pairs(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Distinct (a, b), a < b, that agree in all rows of some band.

    A bucket of more than ``HOT_BUCKET`` sets is dealt to several tasks; its pairs are candidates all the same.
    """
    cut = F.array(*[F.struct(F.lit(i).alias("band"), F.slice("sig", i * rows + 1, rows).alias("part")) for i in range(bands)])
    keyed = sigs.select("s", F.explode(cut).alias("k")).select("s", "k.*")
    keyed = keyed.select("s", F.xxhash64("band", "part").alias("key"))
    left, right = keyed.withColumnRenamed("s", "a"), keyed.withColumnRenamed("s", "b")
    return salted_join(left, right, ["key"], F.xxhash64("a"), threshold=HOT_BUCKET).filter("a < b").select("a", "b").distinct()


def jaccard(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Adds common and similarity to pairs (a, b); pairs without a common item are left out.

    The smaller set of a pair is looked up in the larger one, so hot sets cost what their partners cost.
    """
    sizes = members.groupBy("s").agg(F.count("*").alias("n"))
    both = pairs.join(sizes.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    first = F.col("na") <= F.col("nb")
    ordered = both.select("a", "b", "na", "nb", F.when(first, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("q"))
    items = ordered.join(members.select(F.col("s").alias("p"), "x"), "p")
    hits = items.join(members.select(F.col("s").alias("q"), "x"), ["q", "x"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return hits.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))


def similar_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs found by the bands whose exact similarity reaches the threshold."""
    return jaccard(band_pairs(signatures(members)), members).filter(F.col("similarity") >= threshold)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")

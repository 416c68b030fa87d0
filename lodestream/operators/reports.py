"""Review statistics, top-k reports and partitioning analysis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.rounding import half_up


def top_k(df: DataFrame, key: str, k: int = 10, count: str = "n") -> DataFrame:
    """The ``k`` keys with the most rows; ties go to the smaller key. Null keys are left out.

    One partial aggregate and a bounded heap per task (TakeOrderedAndProject); nothing is sorted as a whole.
    """
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key).limit(k)


def in_year(df: DataFrame, date: str, year: int) -> DataFrame:
    """Rows whose date string begins with the year, as a prefix predicate that can be pushed to the scan."""
    return df.filter(F.col(date).startswith(f"{year:04d}"))


def review_statistics(reviews: DataFrame, year: int) -> DataFrame:
    """One row: n_review, n_review_<year>, n_user, n_business. Several counts in one pass; null ids are not counted."""
    return reviews.agg(F.count("*").alias("n_review"), F.count_if(F.coalesce(F.col("date").startswith(f"{year:04d}"), F.lit(False))).alias(f"n_review_{year}"), F.count_distinct("user_id").alias("n_user"), F.count_distinct("business_id").alias("n_business"))


def review_report(reviews: DataFrame, year: int, k: int = 10) -> DataFrame:
    """One row with the statistics and the two top-k lists as arrays of (id, n), in order."""

    def as_list(key: str) -> DataFrame:
        rows = top_k(reviews, key, k)
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), F.col(key).alias("id"))))
        return rows.agg(F.transform(ordered, lambda e: F.struct(e["id"].alias("id"), (-e["_o"]).alias("n"))).alias(f"top{k}_{key.removesuffix('_id')}"))

    return review_statistics(reviews, year).join(as_list("user_id")).join(as_list("business_id"))


def rows_per_partition(df: DataFrame) -> DataFrame:
    """partition, n_items of the physical partitions; empty ones do not appear."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))


def partition_report(df: DataFrame, key: str, n: int) -> DataFrame:
    """Partitioning by default, by hash of ``key`` into ``n``, and at random into ``n``: layout, n_partition, n_items,
    n_keys (summed over partitions), most.

    ``most`` is the share of the fullest partition; a hot key shows as a value far above ``1 / n``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"one": [1]})

    def report(name: str, laid: DataFrame) -> DataFrame:
        parts = laid.select(key).mapInArrow(counted, "one long").agg(F.count("*").cast("int").alias("n_partition"))  # a row for each, empty or not
        per = laid.groupBy(F.spark_partition_id().alias("p"), key).agg(F.count("*").alias("c")).groupBy("p").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"))
        one = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_items"), F.sum("k").alias("n_keys"), (F.max("c") / F.sum("c")).alias("most"))
        return one.join(F.broadcast(parts)).select(F.lit(name).alias("layout"), "n_partition", "n_items", "n_keys", "most")

    return report("default", df).unionByName(report("customized", df.repartition(n, key))).unionByName(report("random", df.repartition(n)))


def average_by(df: DataFrame, keys: Sequence[str], value: str, out: str, places: int = 2) -> DataFrame:
    """Mean of ``value`` per key, rounded half up; keys without any value are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(half_up(F.avg(value), places).alias(out))


def city_average_stars(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """city, stars: mean stars of the reviews of the city's businesses, best first, then by city; null cities left out."""
    placed = reviews.select("business_id", "stars").join(businesses.filter(F.col("city").isNotNull()).select("business_id", "city"), "business_id")
    return average_by(placed, ["city"], "stars", "stars").orderBy(F.desc("stars"), "city")

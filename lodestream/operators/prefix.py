"""Running sums and dense positions over tables too large for one sort task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.scratch import written


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str = "prefix", parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over this row and all earlier ones of its group in ``order``.

    The rows are range-partitioned by (group, order), so a group of any size spreads over many tasks. Only one total
    per range and group crosses between ranges: at most ``parts + number of groups`` rows. ``order`` should end in a
    unique column; ties get an arbitrary order. Null values count as 0, null groups form a group.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    totals = ranged.groupBy(*group, "_part").agg(F.sum(v).alias("_sum"))
    before = totals.withColumn("_before", F.sum("_sum").over(W.partitionBy(*group).orderBy("_part")) - F.col("_sum")).drop("_sum")
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in [*group, "_part"]]
    named = before.select(*[F.col(c).alias(f"_b_{c}") for c in [*group, "_part"]], "_before")
    joined = ranged.join(named, same, "left").drop(*[f"_b_{c}" for c in [*group, "_part"]])
    local = F.sum(v).over(W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(out, local + F.col("_before")).drop("_part", "_before")

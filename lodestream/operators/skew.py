"""Hot keys: finding, salting, and value-frequency compression.

A key that holds a large share of the rows makes one task run far longer than the others. Two remedies are here:

* ``compress`` groups by key *and value* before anything is grouped by key. Spark combines both steps on the map
  side, so a hot key reaches its final task as at most one row per map task and distinct value.
* ``with_salt`` splits the rows of keys above a threshold over several salts, for operators that need a key's rows
  themselves. The list of such keys has at most ``rows / threshold`` entries; it is broadcast if it is short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.scratch import is_written, written


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is.

    At most ``most + 1`` rows are written to be counted, and a small ``df`` is read from there, so what lies before it
    runs once. A table that is written already is counted where it is.
    """
    some = df if is_written(df) else written(df.limit(most + 1))
    return F.broadcast(some) if some.limit(most + 1).count() <= most else df


def hot_keys(df: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """Keys with more than ``threshold`` rows, with their row counts in ``_rows``."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > threshold)


def with_salt(df: DataFrame, keys: Sequence[str], spread: Column, threshold: int, salt: str = "_salt", ways: str | None = None) -> DataFrame:
    """Adds ``salt``: 0 for ordinary keys, ``pmod(spread, ceil(rows / threshold))`` for hot ones.

    ``spread`` must be an integral column that varies within a key. Rows with a null key get salt 0. ``ways`` names a
    column for the number of salts of a hot key (null for others), if that is wanted.
    """
    hot = written(hot_keys(df, keys, threshold).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_rows") / threshold).alias("_ways")))
    on = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    return df.join(broadcast_if_small(hot), on, "left").withColumn(salt, F.coalesce(F.pmod(spread, F.col("_ways")), F.lit(0)).cast("int")).withColumnRenamed("_ways", ways or "_ways").drop(*[] if ways else ["_ways"], *[f"_hot_{k}" for k in keys])


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", threshold: int = 100_000) -> DataFrame:
    """``big`` joined to ``small`` by ``keys`` (names of both), ``how`` being ``inner`` or ``left``.

    Rows of ``big`` whose key has more than ``threshold`` rows are dealt to several tasks by ``spread`` (integral); the
    rows of ``small`` with that key are copied to each. Keys below it are joined as usual.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a salted join is inner or left, not {how}")
    hot = written(hot_keys(big, keys, threshold).select(*keys, F.ceil(F.col("_rows") / threshold).cast("int").alias("_ways")))
    if hot.isEmpty():
        return big.join(small, list(keys), how)
    hot = broadcast_if_small(hot)
    dealt = big.join(hot, list(keys), "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_ways")), F.lit(0)).cast("int")).drop("_ways")
    copied = small.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ways") - 1, F.lit(0))))).drop("_ways")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def compress(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "value", weight: str = "weight") -> DataFrame:
    """One row per key and distinct value with its number of rows. A null value is a value of its own."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys, v.alias(name)).agg(F.count("*").alias(weight))


def weighted_summary(weighted: DataFrame, keys: Sequence[str], name: str = "value", weight: str = "weight", percentiles: Sequence[float] = (0.5,), most: int = 100_000) -> DataFrame:
    """Per key, from weighted values: rows, distinct values, sum, mode and exact percentiles.

    The values of one key are combined into a list of value and weight; its size is the number of *different* values,
    so this is for values of small domain (ratings, categories), and a key with more than ``most`` of them is an error.
    For ids use :func:`distinct_per_key`. Null values
    count in ``rows`` only. Ties of the mode go to the smallest value. A percentile q is the smallest value whose
    cumulative weight reaches q times the total. Keys without any value get nulls.
    """
    v, w = F.col(name), F.col(weight)
    some = v.isNotNull()
    # counted first, so that too many values are found before they are put into one list
    weighted = weighted if is_written(weighted) else written(weighted)
    few = weighted.groupBy(*keys).agg(F.count(v).alias("_k")).filter(F.col("_k") > most).limit(1).count() == 0
    if not few:
        raise ValueError(f"a key has more than {most} different values of {name}; summaries of lists are for small domains")
    entries = F.array_sort(F.collect_list(F.when(some, F.struct(v.alias("v"), w.alias("w")))))
    out = weighted.groupBy(*keys).agg(
        F.sum(w).alias("rows"),
        F.coalesce(F.sum(F.when(some, w)), F.lit(0)).alias("rows_with_value"),
        F.count(v).alias("distinct_values"),
        F.sum(v * w).alias("value_sum"),
        F.min(F.when(some, F.struct((-w).alias("w"), v.alias("v"))))["v"].alias("mode"),
        entries.alias("_entries"),
    )
    for q in percentiles:
        out = out.withColumn(f"p{int(q * 100)}", _weighted_percentile(q, weighted.schema[name].dataType))
    return out.drop("_entries")


def _weighted_percentile(q: float, kind: T.DataType) -> Column:
    need = F.lit(float(q)) * F.col("rows_with_value")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(kind).alias("v"))

    def step(acc: Column, e: Column) -> Column:
        seen = acc["seen"] + e["w"]
        return F.when(acc["v"].isNotNull(), acc).otherwise(F.struct(seen.alias("seen"), F.when(seen >= need, e["v"]).alias("v")))

    return F.aggregate("_entries", start, step, lambda acc: acc["v"])


def distinct_per_key(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact number of different non-null values per key in two map-side combined steps."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("_one").alias(name))

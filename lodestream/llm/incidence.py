"""Two-sided membership (set id, item id) as pairs of 64-bit hashes, each pair once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.skew import with_salt

#: Rows of one set beyond which its rows are spread over several tasks.
HOT_ROWS = 200_000


def pairs(df: DataFrame, set_col: str, item_col: str, hot: int = HOT_ROWS) -> DataFrame:
    """Distinct (s, i) hash pairs of rows with both ids, sorted and kept together by ``s``.

    Sets of more than ``hot`` rows are split by item over several tasks; ``split`` marks their rows.

    The hashes stand for the ids: among n ids two share a 64-bit hash with a chance of about n^2 / 2^65 (for a
    billion ids 3 %), in which case these two count as one.
    """
    rows = df.filter(F.col(set_col).isNotNull() & F.col(item_col).isNotNull()).select(F.xxhash64(set_col).alias("s"), F.xxhash64(item_col).alias("i"))
    salted = with_salt(rows, ["s"], F.col("i"), hot, ways="_ways")
    return salted.repartition("s", "_salt").dropDuplicates(["s", "_salt", "i"]).select("s", "i", F.coalesce(F.col("_ways") > 1, F.lit(False)).alias("split")).sortWithinPartitions("s")


def names(df: DataFrame, col: str) -> DataFrame:
    """The id of each hash: h, id."""
    return df.filter(F.col(col).isNotNull()).select(F.col(col).alias("id")).distinct().select(F.xxhash64("id").alias("h"), "id")


def with_names(found: DataFrame, ids: DataFrame, a: str, b: str, out_a: str, out_b: str) -> DataFrame:
    """Replaces the hashes in columns ``a`` and ``b`` by ids, the smaller id (byte order) first."""
    x = found.join(ids.select(F.col("h").alias(a), F.col("id").alias("_x")), a).join(ids.select(F.col("h").alias(b), F.col("id").alias("_y")), b)
    return x.select(F.least("_x", "_y").alias(out_a), F.greatest("_x", "_y").alias(out_b), *[c for c in found.columns if c not in (a, b)])

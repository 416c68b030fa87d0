"""Distinct counts with fixed bitmaps (linear counting).

An id sets one of ``m`` bits, chosen by its hash. Two bitmaps of the same ``m`` merge by bitwise union, so partial
results of days, shards or late deliveries combine without the ids. From the number of bits still empty, the number
of different ids is estimated as ``m * ln(m / empty)``.

Each *kind* of cell (the dimensions it keeps) has an ``m`` of its own, sized for the largest cell of that kind. A
bitmap is kept as blocks of 1,024 bits, one row with an array of 16 words each: a cell takes at most ``m / 8`` bytes
plus its keys, however many ids it has, and blocks of one cell spread over many tasks. Blocks are united on the map
side first, so a cell holding a third of all rows reaches the shuffle as at most ``m / 1024`` rows a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.scratch import written

#: Words of 64 bits in a block; the smallest bitmap is one block.
WORDS = 16
LEAST_BITS = WORDS * 64
#: Largest bitmap of one cell, in bits (128 GB).
MOST_BITS = 1 << 40
#: A coarser cell reads this for a dimension it does not use.
ALL = "ALL"


def standard_error(n: float, m: int) -> float:
    """Relative standard error of the estimate for ``n`` ids in ``m`` bits (Whang et al., 1990)."""
    t = n / m
    return math.inf if t > 700 else math.sqrt(m * (math.expm1(t) - t)) / n if n else 0.0


def bits_for(n: int, error: float) -> int:
    """Smallest power of two that holds ``n`` ids with relative standard error ``error`` and leaves bits empty.

    The second condition (at least 30 empty bits expected) keeps a full bitmap out of reach. Where ``MOST_BITS`` do not
    suffice, the error could not be met: that is raised.
    """
    m = LEAST_BITS
    while standard_error(n, m) > error or m * math.exp(-n / m) < 30:
        m *= 2
        if m > MOST_BITS:
            raise ValueError(f"{n} ids need more than {MOST_BITS} bits for an error of {error}; split the ids by ranges of their hash and add up")
    return m


def _kinds(dims: Sequence[str], cells: Sequence[Sequence[str]], *more: Sequence[Column]) -> Column:
    """One struct per kind of cell: kind (its place), dims, and the kind's columns of ``more``."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *[(F.col(d) if d in cell else F.lit(ALL)).alias(d) for d in dims], *[m[k] for m in more]) for k, cell in enumerate(cells)]))


def sizes_for(df: DataFrame, dims: Sequence[str], cells: Sequence[Sequence[str]], id_col: str, error: float) -> list[int]:
    """``m`` of each kind, from the rows of its largest cell, an upper bound on the cell's ids; one row a kind is collected."""
    fine = df.filter(F.col(id_col).isNotNull()).groupBy(*dims).agg(F.count("*").alias("n"))
    per = fine.select(_kinds(dims, cells).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).groupBy("c.kind").agg(F.max("n").alias("n"))
    most = {r["kind"]: r["n"] for r in per.collect()}
    return [bits_for(most.get(k, 0), error) for k in range(len(cells))]


def partials(df: DataFrame, dims: Sequence[str], cells: Sequence[Sequence[str]], id_col: str, sizes: Sequence[int]) -> DataFrame:
    """Blocks of all cells: kind, dims, block, bits (16 words), rows. Rows with a null id are left out; null dims form a cell."""
    place = [F.xxhash64(id_col).bitwiseAND(F.lit(m - 1)).alias("_at") for m in sizes]
    each = df.filter(F.col(id_col).isNotNull()).select(_kinds(dims, cells, place).alias("_c")).select("_c.*")
    keyed = each.select("kind", *dims, F.shiftright("_at", 10).alias("block"), F.shiftright("_at", 6).bitwiseAND(F.lit(WORDS - 1)).alias("_word"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("_bit"))
    words = [F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"_{w}") for w in range(WORDS)]
    return _packed(keyed.groupBy("kind", *dims, "block").agg(*words, F.count("*").alias("rows")), dims)


def _packed(wide: DataFrame, dims: Sequence[str]) -> DataFrame:
    return wide.select("kind", *dims, "block", F.array(*[f"_{w}" for w in range(WORDS)]).alias("bits"), "rows")


def merge(*parts: DataFrame) -> DataFrame:
    """Union of partial results with the same dims, kinds and sizes."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    dims = [c for c in out.columns if c not in ("kind", "block", "bits", "rows")]
    words = [F.bit_or(F.col("bits")[w]).alias(f"_{w}") for w in range(WORDS)]
    return _packed(out.groupBy("kind", *dims, "block").agg(*words, F.sum("rows").alias("rows")), dims)


def fold(part: DataFrame, sizes: Sequence[int], to: Sequence[int]) -> DataFrame:
    """The same ids in smaller bitmaps of ``to`` bits a kind, for merging with bitmaps of that size."""
    if any(b > a or a % b or b % LEAST_BITS for a, b in zip(sizes, to, strict=True)):
        raise ValueError(f"a bitmap folds to a smaller power of two of at least {LEAST_BITS} bits")
    mask = F.array(*[F.lit(b // LEAST_BITS - 1).cast("long") for b in to])
    return merge(part.withColumn("block", F.col("block").bitwiseAND(F.get(mask, F.col("kind")))))


def roll_up(part: DataFrame, over: Sequence[str]) -> DataFrame:
    """Union over all values of the dimensions ``over``, which then read ``ALL`` (cells of a month from those of days)."""
    return merge(part.withColumns({d: F.lit(ALL) for d in over}))


def estimates(part: DataFrame, dims: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """Per cell: kind, dims, rows, estimated distinct ids, its standard error (in ids) and the relative 95 % bound.

    A bitmap without an empty bit has no estimate; it gets null, never a wrong number.
    """
    ones = F.aggregate("bits", F.lit(0), lambda a, w: a + F.bit_count(w))
    cells = part.groupBy("kind", *dims).agg(F.sum(ones).alias("_ones"), F.sum("rows").alias("rows")).withColumn("_m", F.get(F.array(*[F.lit(float(m)) for m in sizes]), F.col("kind")))
    empty = F.col("_m") - F.col("_ones")
    out = cells.withColumn("estimate", F.when(empty > 0, F.col("_m") * F.log(F.col("_m") / empty)))
    t = F.col("estimate") / F.col("_m")
    out = out.withColumn("std_error", F.sqrt(F.col("_m") * F.greatest(F.expm1(t) - t, F.lit(0.0))))
    return out.withColumn("bound_95", F.when(F.col("estimate") > 0, 1.96 * F.col("std_error") / F.col("estimate"))).drop("_ones", "_m")


def distinct_cells(df: DataFrame, dims: Sequence[str], cells: Sequence[Sequence[str]], id_col: str, error: float) -> tuple[DataFrame, DataFrame, list[int]]:
    """(estimates of every cell of every kind in ``cells``, the blocks they come from, written, and the sizes).

    No cell errs by more than ``error`` (relative standard error), as ``m`` is sized for the largest of its kind.
    """
    sizes = sizes_for(df, dims, cells, id_col, error)
    blocks = written(partials(df, dims, cells, id_col, sizes))
    return estimates(blocks, dims, sizes), blocks, sizes


def below_share(cells: DataFrame, share: float, sigmas: float = 6.0, slack: float = 2.0) -> DataFrame:
    """Adds ``below``: whether the distinct ids of a cell are fewer than ``share`` of its rows, as far as the estimate
    tells: null where it is within ``sigmas`` standard errors and ``slack`` ids of the line, or missing."""
    line, far = F.col("rows") * F.lit(float(share)), F.lit(float(sigmas)) * F.col("std_error") + F.lit(float(slack))
    return cells.withColumn("below", F.when(F.col("estimate") + far < line, True).when(F.col("estimate") - far >= line, False))


def exact_cells(df: DataFrame, dims: Sequence[str], cells: Sequence[Sequence[str]], id_col: str, wanted: DataFrame) -> DataFrame:
    """kind, dims, ids: exact distinct ids of the cells in ``wanted`` (kind, dims); the others' rows are dropped on the
    map side where ``wanted`` is small enough to broadcast."""
    from lodestream.operators.skew import broadcast_if_small

    each = df.filter(F.col(id_col).isNotNull()).select(_kinds(dims, cells).alias("_c"), F.col(id_col).alias("_id")).select("_c.*", "_id")
    same = [each["kind"] == F.col("_w.kind"), *[each[d].eqNullSafe(F.col(f"_w.{d}")) for d in dims]]
    kept = each.join(broadcast_if_small(wanted.select("kind", *dims)).alias("_w"), same, "left_semi")
    return kept.groupBy("kind", *dims, "_id").agg(F.lit(1).alias("_one")).groupBy("kind", *dims).agg(F.count("_one").alias("ids"))

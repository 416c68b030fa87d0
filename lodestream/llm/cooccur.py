"""How often pairs of items share a basket, and how surprising that is.

Counts are exact. The null model is the bipartite configuration model fitted to the item frequencies and basket
sizes: basket u holds item i with chance ``x_u y_i / (1 + x_u y_i)``, where equal sizes share an x and equal
frequencies a y. Under it the number of common baskets of two items is Poisson-binomial; its upper tail gives the
surprise, and the Benjamini-Hochberg procedure over all pairs of kept items the pairs that stand out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators.pairs import WIDE, pair_counts
from lodestream.scratch import written

#: Degrees above this are put into classes of 1 % width, which keeps the fitted table at a few thousand entries.
EXACT_DEGREES = 1_000


def usable_items(baskets: DataFrame, n_baskets: int, least: int, lift: float) -> DataFrame:
    """Items (i, n) that can be in a pair with ``least`` common baskets and that lift.

    A pair's lift is at most ``n_baskets / max(nA, nB)``, so items in more than ``n_baskets / lift`` baskets cannot
    take part; this is where the hottest items leave, exactly.
    """
    return baskets.groupBy("i").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") * F.lit(float(lift)) <= F.lit(float(n_baskets))))


def common_baskets(baskets: DataFrame, least: int, lift: float, wide: int = WIDE) -> tuple[DataFrame, int, DataFrame]:
    """(pairs a, b, common, na, nb, lift with at least ``least`` common baskets and that lift; number of baskets; items)."""
    n = baskets.select("s").distinct().count()
    items = written(usable_items(baskets, n, least, lift))
    kept = baskets.select("s", "i").join(items.select("i"), "i", "left_semi")
    counts = pair_counts(written(kept.repartition("s")), least, wide)
    na, nb = items.select(F.col("i").alias("a"), F.col("n").alias("na")), items.select(F.col("i").alias("b"), F.col("n").alias("nb"))
    both = counts.join(na, "a").join(nb, "b")
    value = F.col("common") * F.lit(float(n)) / (F.col("na") * F.col("nb"))
    enough = F.col("common") * F.lit(n) >= F.lit(float(lift)) * F.col("na") * F.col("nb")
    return both.withColumn("lift", value).filter(enough), n, items


def degree_class(col: str):
    """A degree itself up to ``EXACT_DEGREES``, beyond it the geometric class of 1 % width."""
    c = F.col(col).cast("double")
    return F.when(c <= EXACT_DEGREES, c).otherwise(F.round(F.exp(F.round(F.log(c) / math.log(1.01)) * math.log(1.01))))


def degree_table(baskets: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """(degree, number of nodes with it) over classes; bounded by ``EXACT_DEGREES`` plus 70 classes a decimal digit."""
    degrees = baskets.groupBy(col).agg(F.count("*").alias("k")).groupBy(degree_class("k").alias("k")).agg(F.count("*").alias("c"), F.avg("k").alias("m"))
    rows = degrees.orderBy("k").collect()
    return np.array([r["m"] for r in rows], float), np.array([r["c"] for r in rows], float)


def fit_null(sizes: tuple[np.ndarray, np.ndarray], frequencies: tuple[np.ndarray, np.ndarray], rounds: int = 2_000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses x per size class and y per frequency class whose expected degrees are the given ones.

    A fit that has not settled to ``tolerance`` (relative change) after ``rounds`` rounds is raised, never returned.
    """
    (k, ck), (f, cf) = sizes, frequencies
    edges = max(float((k * ck).sum()), 1.0)
    x, y = k / math.sqrt(edges), f / math.sqrt(edges)
    for _ in range(rounds):
        nx = k / (y * cf / (1 + np.outer(x, y))).sum(axis=1)
        ny = f / (nx[:, None] * ck[:, None] / (1 + np.outer(nx, y))).sum(axis=0)
        change = max(np.abs(nx / x - 1).max(initial=0), np.abs(ny / y - 1).max(initial=0))
        x, y = nx, ny
        if change < tolerance:
            return x, y
    raise RuntimeError(f"the null model did not settle in {rounds} rounds: fitnesses still change by {change:.2g}")


def _mills(w: np.ndarray) -> np.ndarray:
    """Upper tail of the normal over its density."""
    small = np.minimum(w, 8.0)
    near = np.array([math.erfc(v / math.sqrt(2)) * math.exp(v * v / 2) for v in small]) * math.sqrt(math.pi / 2)
    v = np.maximum(w, 8.0)
    far = (1 - 1 / v**2 + 3 / v**4 - 15 / v**6 + 105 / v**8) / v
    return np.where(w < 8, near, far)


def log10_tail(p: np.ndarray, count: np.ndarray, at_least: np.ndarray) -> np.ndarray:
    """log10 P(X >= ``at_least``) of sums of ``count[k]`` Bernoulli(``p[row, k]``): Poisson-binomial, by saddlepoint.

    The continuity-corrected Lugannani-Rice formula keeps its relative accuracy far out in the tail, where sums of
    probabilities cancel. At or below the mean the answer is 0 (nothing surprising); a value no draw can reach gets
    minus infinity.
    """
    x = at_least.astype(float)
    mean, most = (count * p).sum(axis=1), (count * (p > 0)).sum(axis=1)
    out = np.zeros(len(x))
    out[x > most] = -np.inf
    rows = np.flatnonzero((x > mean + 0.5) & (x < most))
    edge = (x == most) & (x > mean + 0.5)
    out[edge] = (count * np.log10(np.where(p[edge] > 0, p[edge], 1.0))).sum(axis=1)
    if not len(rows):
        return out
    p, x = p[rows], x[rows]
    t = np.log(x / mean[rows])
    for _ in range(60):
        e = p * np.exp(t)[:, None]
        q = e / (1 - p + e)
        k1, k2 = (count * q).sum(axis=1), (count * q * (1 - q)).sum(axis=1)
        step = np.clip((x - k1) / np.maximum(k2, 1e-300), -1, 1)
        t = t + step
        if np.abs(step).max() < 1e-12:
            break
    e = p * np.exp(t)[:, None]
    q = e / (1 - p + e)
    k2 = (count * q * (1 - q)).sum(axis=1)
    k0 = (count * np.log1p(p * np.expm1(t)[:, None])).sum(axis=1)
    w = np.sqrt(np.maximum(2 * (t * x - k0), 1e-12))
    u = -np.expm1(-t) * np.sqrt(k2)
    ratio = np.maximum(_mills(w) + 1 / u - 1 / w, 1e-300)
    out[rows] = np.minimum((-w * w / 2 - 0.5 * math.log(2 * math.pi) + np.log(ratio)) / math.log(10), 0.0)
    return out


def scored_pairs(baskets: DataFrame, least: int, lift: float) -> tuple[DataFrame, int]:
    """(pairs with at least ``least`` common baskets and that lift, with expected and surprise under the null fitted to
    all of ``baskets``, written; the number of different items, of which all pairs are tested)."""
    pairs, _, _ = common_baskets(baskets, least, lift)
    sizes, frequencies = degree_table(baskets, "s"), degree_table(baskets, "i")
    x, y = fit_null(sizes, frequencies)
    return written(surprise(written(pairs), sizes, frequencies, x, y)), int(frequencies[1].sum())


def surprise(pairs: DataFrame, sizes: tuple[np.ndarray, np.ndarray], frequencies: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> DataFrame:
    """Adds expected (common baskets under the null) and surprise (-log10 of the tail)."""
    _, ck = sizes
    f, _ = frequencies
    log_f, log_y = np.log(f), np.log(y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 2_000):
                pdf = whole.iloc[lo : lo + 2_000].copy()
                # pairs of the same degrees and count have the same tail
                cases, case = np.unique(pdf[["na", "nb", "common"]].to_numpy(np.int64), axis=0, return_inverse=True)
                case = case.reshape(-1)
                ya, yb = (np.exp(np.interp(np.log(cases[:, c].astype(float)), log_f, log_y)) for c in (0, 1))
                pa, pb = (np.outer(v, x) / (1 + np.outer(v, x)) for v in (ya, yb))
                pdf["expected"] = (ck * pa * pb).sum(axis=1)[case]
                pdf["surprise"] = -log10_tail(pa * pb, ck, cases[:, 2])[case]
                yield pdf

    schema = T.StructType([*pairs.schema.fields, T.StructField("expected", T.DoubleType()), T.StructField("surprise", T.DoubleType())])
    return pairs.mapInPandas(run, schema)


def discoveries(scored: DataFrame, tests: int, rate: float = 0.05) -> DataFrame:
    """Adds ``significant``: Benjamini-Hochberg at false-discovery ``rate`` among ``tests`` pairs.

    Surprises are counted in bins of 0.01 (at most 40,001 of them reach the driver), each taken at its least surprise,
    which can only make the procedure stricter.
    """
    bins = scored.groupBy(F.floor(F.least(F.col("surprise"), F.lit(400.0)) * 100).alias("bin")).agg(F.count("*").alias("c")).orderBy(F.desc("bin")).collect()
    rank, threshold = 0, math.inf
    for r in bins:
        rank += r["c"]
        if 10 ** (-r["bin"] / 100) <= rate * rank / max(tests, 1):
            threshold = r["bin"] / 100
    return scored.withColumn("significant", F.col("surprise") >= F.lit(threshold))

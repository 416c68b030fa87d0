"""Clusters of records by the position of their centroid sum / n.

The records are vectors and belong together by Euclidean distance. They are made sets for the named pipeline: the set of
a record holds the cells it falls into in ``GRIDS`` randomly shifted grids, so the nearer two records, the more cells
they share and the higher the Jaccard similarity of their sets. MinHash bands over these sets generate candidates, the
exact Jaccard similarity of the sets and then the distance verify them, connected components form the groups, and groups
that are loose are split around their highest-degree medoids.

Records in one cell of a grid so fine that its diagonal is below the radius belong together without any comparison.
They are merged first, so a hot group enters the banding as a handful of cells, however many rows it has: a group of
diameter r covers at most 4^8 fine cells, at any size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.components import connected_components
from lodestream.scratch import written

#: Shifted grids, the width of their cells in radii, and the bands, of one MinHash value each, over a record's cells.
GRIDS, WIDTH, BANDS = 24, 8.0, 36
#: Similarity of the sets below which a candidate is dropped: no pair within the radius is, but for ``band_recall``.
LEAST_JACCARD = 0.1
#: Banded rows per group of the linking step; members up to which a group is split in one pass with exact degrees.
GROUP_ROWS, SMALL_GROUP = 50_000, 2_000
#: Pairs compared at once.
BLOCK_PAIRS = 200_000
SEED = 20_160_104


def band_recall(distance: float, radius: float, dims: int) -> float:
    """Least chance that two points at that distance become verified candidates (distance spread evenly over dims)."""
    p = max(0.0, 1 - distance / math.sqrt(dims) / (WIDTH * radius)) ** dims
    total = 0.0
    for c in range(GRIDS + 1):
        similar = c / (2 * GRIDS - c)
        if similar >= LEAST_JACCARD:
            total += math.comb(GRIDS, c) * p**c * (1 - p) ** (GRIDS - c) * (1 - (1 - similar) ** BANDS)
    return total


def _shifts(radius: float, dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).uniform(0, WIDTH * radius, (GRIDS, dims))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def cell_sets(x: np.ndarray, radius: float) -> np.ndarray:
    """The set of each point: hashes of its cell in every shifted grid, [point, grid]."""
    out = np.empty((len(x), GRIDS), np.uint64)
    for k, shift in enumerate(_shifts(radius, x.shape[1])):
        corner = np.floor((x + shift) / (WIDTH * radius)).astype(np.int64).astype(np.uint64)
        h = np.full(len(x), k + 1, np.uint64)
        for j in range(x.shape[1]):
            h = _mixed(h * np.uint64(31) + corner[:, j])
        out[:, k] = h
    return out


def bands(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band by band the key of each set, its MinHash value under that band's hash, and the grid of the cell that has it."""
    keys, grids, rows = np.empty((len(sets), BANDS), np.uint64), np.empty((len(sets), BANDS), np.uint8), np.arange(len(sets))
    for b in range(BANDS):
        h = _mixed(sets + np.uint64((b + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        grids[:, b] = least = h.argmin(axis=1)
        keys[:, b] = _mixed(h[rows, least] + np.uint64(b))
    return keys, grids


def band_keys(sets: np.ndarray) -> np.ndarray:
    """Band by band the key of each set, [point, band]."""
    return bands(sets)[0]


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact similarity of sets row by row; a cell is shared only within its grid."""
    common = (a == b).sum(axis=1)
    return common / (2 * GRIDS - common)


def valid_records(df: DataFrame, dims: int) -> DataFrame:
    """stat_id, n, centroid of valid records, each stat_id once (its earliest valid delivery).

    Valid: stat_id present, n >= 1, ``sum`` of exactly ``dims`` finite entries.
    """
    finite = F.forall("sum", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = df.filter(F.col("stat_id").isNotNull() & (F.col("n") >= 1) & (F.size("sum") == dims) & F.coalesce(finite, F.lit(False)))
    first = ok.groupBy("stat_id").agg(F.min(F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", "n", "sum")).alias("r"))
    return first.select("stat_id", "r.n", F.transform("r.sum", lambda x: x / F.col("r.n")).alias("centroid"))


def fine_cells(records: DataFrame, radius: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """(records with their cell, cells): ``cell`` is a grid cell with a diagonal below ``radius``.

    Of a cell: lead (smallest stat_id), rep (the lead's centroid), records, points.
    """
    width = radius / math.sqrt(dims) * (1 - 1e-9)
    placed = records.withColumn("cell", F.transform("centroid", lambda x: F.floor(x / width)))
    cells = placed.groupBy("cell").agg(F.min(F.struct("stat_id", "centroid")).alias("m"), F.count("*").alias("records"), F.sum("n").alias("points"))
    return placed, cells.select("cell", F.col("m.stat_id").alias("lead"), F.col("m.centroid").alias("rep"), "records", "points")


def _banded(radius: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                keys, grids = bands(cell_sets(np.stack(pdf["rep"].to_numpy()), radius))
                yield pd.DataFrame({"lead": pdf["lead"], "rep": pdf["rep"], "keys": list(keys.astype(np.int64)), "grids": [g.tobytes() for g in grids]})

    return run


def _pairs(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j < end[i] in blocks of about ``BLOCK_PAIRS``."""
    count = end - np.arange(len(end)) - 1
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - count[lo] + BLOCK_PAIRS, "right")))
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        yield i, np.arange(len(i)) - np.repeat(total[lo:hi] - count[lo:hi] - total[lo] + count[lo], count[lo:hi]) + i + 1
        lo = hi


def _met(sets: np.ndarray, grids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sets share the key of one of the bands of ``grids``: they do if its cell is of one grid and the same."""
    same = grids[i] == grids[j]
    grid = grids[i, same.argmax(axis=1)]  # most pairs are settled by the first band of one grid
    met = same.any(axis=1) & (sets[i, grid] == sets[j, grid])
    rest = np.flatnonzero(~met)
    i, j = i[rest], j[rest]
    met[rest] = (same[rest] & np.take_along_axis(sets[i] == sets[j], grids[i].astype(np.intp), axis=1)).any(axis=1)
    return met


def _near_pairs(radius: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Every pair of a band that is similar and near enough, unless the two share the key of an earlier band."""
        pdf = pdf[pdf.duplicated(["band", "key"], keep=False)].sort_values(["band", "key", "lead"], kind="stable")
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(pdf):
            all_x = np.stack(pdf["rep"].to_numpy())
            all_sets, band, edges = cell_sets(all_x, radius), pdf["band"].to_numpy(), np.arange(BANDS + 1)
            for b, lo, hi in zip(edges[:-1], *np.searchsorted(band, [edges[:-1], edges[1:]]), strict=True):
                lead, key, x, sets = pdf["lead"].to_numpy()[lo:hi], pdf["key"].to_numpy()[lo:hi], all_x[lo:hi], all_sets[lo:hi]
                grids = np.frombuffer(b"".join(pdf["earlier"].iloc[lo:hi]), np.uint8).reshape(hi - lo, b)
                for i, j in _pairs(np.searchsorted(key, key, "right")):
                    if b:
                        new = ~_met(sets, grids, i, j)
                        i, j = i[new], j[new]
                    near = ((x[i] - x[j]) ** 2).sum(axis=1) <= radius * radius
                    i, j = i[near], j[near]
                    similar = jaccard(sets[i], sets[j]) >= LEAST_JACCARD
                    src.append(lead[j[similar]])
                    dst.append(lead[i[similar]])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return run


def links(cells: DataFrame, radius: float, n_cells: int) -> DataFrame:
    """Verified links (src, dst), src > dst, between cells' leads: every candidate pair that is similar and within the radius.

    A pair that shares several bands is listed by the first of them, so none is listed twice: a row of a band carries the
    grids its keys of the earlier bands are from. A group of rows in one task holds whole bands' keys and about
    ``GROUP_ROWS`` rows, its pairs are compared in blocks.
    """
    keyed = cells.select("lead", "rep").mapInPandas(_banded(radius), "lead long, rep array<double>, keys array<long>, grids binary")
    keyed = keyed.select("lead", "rep", "grids", F.posexplode("keys").alias("band", "key")).withColumn("earlier", F.expr("substring(grids, 1, band)")).drop("grids")
    groups = max(1, math.ceil(n_cells * BANDS / GROUP_ROWS))
    return keyed.withColumn("g", F.pmod("key", F.lit(groups))).groupBy("g").applyInPandas(_near_pairs(radius), "src long, dst long")


def _split_small(radius: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Every component of the group around its medoids, by exact degrees: all neighbours within the radius."""
        pdf = pdf.sort_values(["component", "lead"], kind="stable")
        lead, component = pdf["lead"].to_numpy(), pdf["component"].to_numpy()
        x = np.stack(pdf["rep"].to_numpy()) if len(pdf) else np.empty((0, 1))
        cluster = lead.copy()
        edges = np.flatnonzero(np.r_[True, component[1:] != component[:-1], True]) if len(pdf) else np.zeros(1, int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            square = (x[lo:hi] ** 2).sum(axis=1)
            gap = square[:, None] + square[None, :] - 2 * x[lo:hi] @ x[lo:hi].T
            near = gap <= radius * radius + 1e-9 * (1 + square.max())
            degree, rest = near.sum(axis=1), np.arange(hi - lo)
            while len(rest):
                medoid = rest[np.argmax(degree[rest])]  # the first, that is the smallest lead, on a tie
                mine = near[medoid, rest]
                cluster[lo + rest[mine]] = lead[lo + medoid]
                rest = rest[~mine]
        return pd.DataFrame({"lead": lead, "cluster": cluster})

    return run


def split_loose(members: DataFrame, found: DataFrame, radius: float) -> DataFrame:
    """(lead, cluster) with every cluster within ``radius`` of a medoid.

    ``members``: lead, rep, component; ``found``: the links. The medoid of a group is its lead of highest degree (ties:
    smallest); members within the radius stay with it, the others form a group of their own and are treated again, until
    none is left. Components of at most ``SMALL_GROUP`` leads are done in one grouped pass, which counts their degrees
    itself. Larger ones go through rounds, one medoid a component each, with the links of a lead in either direction as
    its degree, so these must be all links; a round takes all that is within the radius, so a group as it should be takes
    one.
    """
    sizes = written(members.groupBy("component").agg(F.count("*").alias("_k")))
    sized = members.join(sizes, "component")
    groups = max(1, math.ceil((sizes.filter(F.col("_k") <= SMALL_GROUP).agg(F.sum("_k")).first()[0] or 0) / GROUP_ROWS))
    small = sized.filter(F.col("_k") <= SMALL_GROUP).withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups)))
    done = small.groupBy("g").applyInPandas(_split_small(radius), "lead long, cluster long")
    large = sized.filter(F.col("_k") > SMALL_GROUP).drop("_k")
    if sizes.filter(F.col("_k") > SMALL_GROUP).isEmpty():
        return done
    degrees = found.select(F.explode(F.array("src", "dst")).alias("lead")).groupBy("lead").agg(F.count("*").alias("degree"))
    rest = large.join(degrees, "lead", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    while True:
        medoid = rest.groupBy("component").agg(F.max(F.struct("degree", (-F.col("lead")).alias("l"), "rep")).alias("m")).select("component", (-F.col("m.l")).alias("medoid"), F.col("m.rep").alias("mrep"))
        far = F.sqrt(F.aggregate(F.zip_with("rep", "mrep", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        dealt = written(rest.join(medoid, "component").withColumn("near", far <= radius))
        done = done.unionByName(dealt.filter("near").select("lead", F.col("medoid").alias("cluster")))
        rest = dealt.filter("not near").select("lead", "rep", "component", "degree")
        if rest.isEmpty():
            return done


def cluster_records(df: DataFrame, radius: float, dims: int = 8) -> DataFrame:
    """stat_id, n, centroid, lead_id of all valid records; lead_id is the smallest stat_id of the record's cluster.

    Where "within the radius" is transitive, clusters are its classes up to the banding's recall (``band_recall``: above
    0.999999 per pair at the radius itself, and more links than one lead to a group). Where it is not, components of all
    links between leads are split so that every fine cell's lead lies within the radius of its cluster's medoid.
    """
    records = written(valid_records(df, dims))
    placed, cells = fine_cells(records, radius, dims)
    cells = written(cells)
    found = written(links(cells, radius, cells.count()))
    groups = cells.select("lead", "rep").join(connected_components(found).select(F.col("id").alias("lead"), "component"), "lead", "left").withColumn("component", F.coalesce("component", "lead"))
    several = groups.join(found.select(F.col("dst").alias("component")).distinct(), "component", "left_semi")
    whole = groups.join(several.select("lead"), "lead", "left_anti").select("lead", F.col("lead").alias("cluster"))
    clusters = split_loose(several, found, radius).unionByName(whole)
    named = written(cells.select("cell", "lead").join(clusters, "lead").select("cell", "lead", "cluster"))
    lead_of = named.groupBy("cluster").agg(F.min("lead").alias("lead_id"))
    return placed.join(named.join(lead_of, "cluster").select("cell", "lead_id"), "cell").select("stat_id", "n", "centroid", "lead_id")


def describe(clustered: DataFrame, dims: int = 8, typical: int = 3) -> DataFrame:
    """lead_id, records, points, spread (largest distance from the centre) and the ``typical`` members nearest to it.

    The centre is the mean centroid. Ties in distance (at nine decimals) go to the smaller stat_id.
    """
    centre = clustered.groupBy("lead_id").agg(F.count("*").alias("records"), F.sum("n").alias("points"), F.array(*[F.avg(F.col("centroid")[i]) for i in range(dims)]).alias("centre"))
    d = F.sqrt(F.aggregate(F.zip_with("centroid", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    ranked = clustered.join(centre.select("lead_id", "centre"), "lead_id").withColumn("distance", F.round(d, 9))
    spread = ranked.groupBy("lead_id").agg(F.max("distance").alias("spread"))
    top = ranked.select("lead_id", "stat_id", "distance", F.row_number().over(W.partitionBy("lead_id").orderBy("distance", "stat_id")).alias("k")).filter(F.col("k") <= typical)
    names = top.groupBy("lead_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "stat_id"))), lambda e: e["stat_id"]).alias("typical"))
    return centre.select("lead_id", "records", "points").join(spread, "lead_id").join(names, "lead_id")

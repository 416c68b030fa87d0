"""Clustering points by summaries in fixed memory (BFR), with the pieces it is made of.

``points``: id, features (array of doubles, all of one length). A cluster is summed up by n, sum and sumsq; the driver
holds only summaries, whose number is bounded by the parameter k, never points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.prefix import prefix_sums
from lodestream.scratch import written

#: Chunks of the input, factor of the fine clustering, and the distance bound in multiples of sqrt(dimensions).
CHUNKS, FINE, BOUND = 5, 5, 2.0


def summaries(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, n, sum, sumsq (arrays) of assigned points; merging two summaries is adding them up."""
    flat = assigned.select(cluster, F.posexplode("features").alias("j", "x")).groupBy(cluster, "j").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    rows = flat.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "s", "q"))).alias("_v"))
    return rows.select(cluster, "n", F.transform("_v", lambda e: e["s"]).alias("sum"), F.transform("_v", lambda e: e["q"]).alias("sumsq"))


def merge_summaries(*parts: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Summaries of the same clusters added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    flat = out.select(cluster, "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("j", "v")).groupBy(cluster, "j").agg(F.sum("n").alias("n"), F.sum("v.sum").alias("s"), F.sum("v.sumsq").alias("q"))
    rows = flat.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "s", "q"))).alias("_v"))
    return rows.select(cluster, "n", F.transform("_v", lambda e: e["s"]).alias("sum"), F.transform("_v", lambda e: e["q"]).alias("sumsq"))


class Summaries:
    """A bounded list of cluster summaries on the driver."""

    def __init__(self, dims: int) -> None:
        self.n, self.s, self.q = np.zeros(0), np.zeros((0, dims)), np.zeros((0, dims))

    def __len__(self) -> int:
        return len(self.n)

    def add(self, n: float, s: np.ndarray, q: np.ndarray) -> None:
        self.n, self.s, self.q = np.append(self.n, n), np.vstack([self.s, s]), np.vstack([self.q, q])

    def grow(self, at: int, n: float, s: np.ndarray, q: np.ndarray) -> None:
        self.n[at] += n
        self.s[at] += s
        self.q[at] += q

    def centres(self) -> np.ndarray:
        return self.s / self.n[:, None]

    def spreads(self) -> np.ndarray:
        """Standard deviations; a variance that rounding made negative is 0."""
        return np.sqrt(np.maximum(self.q / self.n[:, None] - self.centres() ** 2, 0.0))


def normalised_distance(x: np.ndarray, centres: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """Distances [point, cluster] in standard deviations; dimensions without spread are skipped, infinite if all are."""
    out = np.empty((len(x), len(centres)))
    for j, (c, s) in enumerate(zip(centres, spreads, strict=True)):
        some = s > 1e-12
        out[:, j] = np.sqrt((((x[:, some] - c[some]) / s[some]) ** 2).sum(axis=1)) if some.any() else np.inf
    return out


def nearest(points: DataFrame, summary: Summaries, bound: float) -> DataFrame:
    """points with cluster: the nearest summary (ties: the earlier) if nearer than ``bound``, else null."""
    centres, spreads = summary.centres(), summary.spreads()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(centres) and len(pdf):
                d = normalised_distance(np.stack(pdf["features"].to_numpy()), centres, spreads)
                at, best = d.argmin(axis=1), d.min(axis=1)
                pdf["cluster"] = pd.array(np.where(best < bound, at, -1), dtype="Int64")
                pdf.loc[pdf["cluster"] < 0, "cluster"] = pd.NA
            else:
                pdf["cluster"] = pd.array([pd.NA] * len(pdf), dtype="Int64")
            yield pdf

    return points.select("id", "features").mapInPandas(run, "id long, features array<double>, cluster long")


def k_means(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """points with cluster by k-means; with at most k points every one is a cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    if n <= max(k, 1):
        return points.select("id", "features", F.xxhash64("id").alias("cluster"))
    vectors = points.select("id", "features", array_to_vector("features").alias("_v"))
    model = KMeans(k=k, seed=seed, maxIter=20, featuresCol="_v", predictionCol="_c").fit(vectors)
    return model.transform(vectors).select("id", "features", F.col("_c").cast("long").alias("cluster"))


def _split(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points in clusters of two or more, single points)."""
    several = clustered.groupBy("cluster").agg(F.count("*").alias("_n")).filter("_n > 1").select("cluster")
    return clustered.join(several, "cluster", "left_semi"), clustered.join(several, "cluster", "left_anti")


def chunk(points: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """Adds chunk 1..chunks, of equal size but for one point, in the order of a hash of the id."""
    placed = prefix_sums(points.withColumns({"_h": F.xxhash64("id"), "_one": F.lit(1).cast("long")}), [], ["_h", "id"], "_one", "_at")
    total = F.broadcast(placed.agg(F.max("_at").alias("_all")))  # one row
    return placed.join(total).withColumn("chunk", F.floor((F.col("_at") - 1) * chunks / F.col("_all") + 1).cast("int")).drop("_h", "_one", "_at", "_all")


def bfr(points: DataFrame, k: int, chunks: int = CHUNKS) -> tuple[DataFrame, DataFrame]:
    """(assignments id, cluster with -1 for outliers; rounds round, ds_points, cs_clusters, cs_points, rs_points).

    Chunk 1: fine k-means, points of single-point clusters are retained, k-means of the rest starts the discard
    clusters; retained points are clustered finely into compression clusters. Later chunks: each point goes to the
    nearest discard cluster within the bound, else to the nearest compression cluster, else is retained; statistics are
    updated once a chunk. Retained points of the chunk (at least FINE * k) are clustered finely, close compression
    clusters merged, and after the last chunk compression clusters close to a discard cluster join it; what is left of
    compression and retained points are outliers. Points with null features are left out; an empty input gives no rows.
    """
    spark = points.sparkSession
    pts = written(chunk(points.select("id", "features").filter("id is not null and features is not null and size(features) > 0"), chunks))
    first = pts.first()
    if first is None:
        return spark.createDataFrame([], "id long, cluster int"), spark.createDataFrame([], "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")
    dims = len(first["features"])
    bound = BOUND * math.sqrt(dims)
    ds, cs = Summaries(dims), Summaries(dims)
    cs_home: list[int] = []  # compression cluster -> the one it was merged into
    pieces: list[DataFrame] = []  # id, kind, cluster
    rounds, retained, ds_points = [], 0, 0

    def absorb(target: Summaries, assigned: DataFrame) -> None:
        for r in summaries(assigned).orderBy("cluster").collect():  # bounded by the number of summaries
            target.grow(int(r["cluster"]), r["n"], np.array(r["sum"]), np.array(r["sumsq"]))

    def start(target: Summaries, clustered: DataFrame) -> DataFrame:
        """New summaries of the clusters; the points with the places of theirs."""
        places = []
        for r in summaries(clustered).orderBy("cluster").collect():  # at most FINE * k
            places.append((r["cluster"], len(target)))
            target.add(r["n"], np.array(r["sum"]), np.array(r["sumsq"]))
        at = spark.createDataFrame(places, "cluster long, place long")
        return clustered.join(F.broadcast(at), "cluster").select("id", F.col("place").alias("cluster"))

    def compress(rest: DataFrame) -> None:
        nonlocal retained
        if rest.count() >= FINE * k:
            groups, single = _split(written(k_means(rest, FINE * k)))
            before = len(cs)
            new = written(start(cs, groups))
            cs_home.extend(range(before, len(cs)))
            pieces.append(new.select("id", F.lit("cs").alias("kind"), "cluster"))
            rest = single
        rest = written(rest.select("id"))
        retained += rest.count()
        pieces.append(rest.select("id", F.lit("rs").alias("kind"), F.lit(-1).cast("long").alias("cluster")))

    for number in range(1, chunks + 1):
        part = pts.filter(F.col("chunk") == number).select("id", "features")
        if not len(ds):
            groups, single = _split(written(k_means(part, FINE * k)))
            fine = written(k_means(written(groups.select("id", "features")), k))
            placed = written(start(ds, fine))
            pieces.append(placed.select("id", F.lit("ds").alias("kind"), "cluster"))
            compress(written(single.select("id", "features")))
        else:
            to_ds = written(nearest(part, ds, bound))
            in_ds = to_ds.filter("cluster is not null")
            to_cs = written(nearest(to_ds.filter("cluster is null"), _alive(cs, cs_home), bound))
            in_cs = to_cs.filter("cluster is not null")
            absorb(ds, in_ds)
            absorb(cs, in_cs)
            pieces += [in_ds.select("id", F.lit("ds").alias("kind"), "cluster"), in_cs.select("id", F.lit("cs").alias("kind"), "cluster")]
            compress(to_cs.filter("cluster is null").select("id", "features"))
            _merge_close(cs, cs_home, bound)
        ds_points = int(ds.n.sum())
        joined = _join_discard(cs, cs_home, ds, bound) if number == chunks else {}
        ds_points += int(sum(cs.n[c] for c in joined))
        alive = [c for c in range(len(cs)) if cs_home[c] == c and c not in joined]
        rounds.append((number, ds_points, len(alive), int(sum(cs.n[c] for c in alive)), retained))
    final = [(c, joined.get(_home(cs_home, c), -1)) for c in range(len(cs))]
    ends = spark.createDataFrame(final, "cluster long, final int")
    every = pieces[0]
    for p in pieces[1:]:
        every = every.unionByName(p)
    placed = every.join(F.broadcast(ends), "cluster", "left")
    cluster = F.when(F.col("kind") == "ds", F.col("cluster").cast("int")).when(F.col("kind") == "cs", F.col("final")).otherwise(-1)
    return placed.select("id", cluster.alias("cluster")), spark.createDataFrame(rounds, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")


def _home(home: list[int], c: int) -> int:
    while home[c] != c:
        c = home[c]
    return c


def _alive(cs: Summaries, home: list[int]) -> Summaries:
    """The summaries with merged ones moved out of reach."""
    out = Summaries(cs.s.shape[1])
    out.n, out.s, out.q = cs.n.copy(), cs.s.copy(), cs.q.copy()
    gone = [c for c in range(len(cs)) if home[c] != c]
    out.s[gone], out.q[gone] = 0.0, 0.0
    return out


def _between(a: Summaries, i: int, b: Summaries, j: int) -> float:
    """The smaller of the two normalised distances between centres."""
    ca, sa, cb, sb = a.centres()[[i]], a.spreads()[[i]], b.centres()[[j]], b.spreads()[[j]]
    return float(min(normalised_distance(ca, cb, sb)[0, 0], normalised_distance(cb, ca, sa)[0, 0]))


def _merge_close(cs: Summaries, home: list[int], bound: float) -> None:
    """One pass over the living compression clusters in order: each is to go into the first later one within the bound.

    All of this is decided on the statistics before any merge; the merges then follow in the same order, so a chain ends
    in its last cluster.
    """
    alive = [c for c in range(len(cs)) if home[c] == c]
    into = {}
    for at, i in enumerate(alive):
        for j in alive[at + 1 :]:
            if _between(cs, i, cs, j) < bound:
                into[i] = j
                break
    for i, j in into.items():
        cs.grow(j, cs.n[i], cs.s[i], cs.q[i])
        home[i] = j


def _join_discard(cs: Summaries, home: list[int], ds: Summaries, bound: float) -> dict[int, int]:
    """Compression clusters that join a discard cluster at the end, with its number."""
    out = {}
    for c in range(len(cs)):
        if home[c] == c and len(ds):
            d, at = min((_between(cs, c, ds, j), j) for j in range(len(ds)))
            if d < bound:
                out[c] = at
    return out


def majority_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, label, n, size: the most frequent true label of each cluster (ties: smaller). ``labels``: id, label."""
    both = assigned.join(labels.select("id", "label"), "id").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    best = both.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.sum("n").alias("size"))
    return best.select("cluster", "b.label", (-F.col("b.m")).alias("n"), "size")


def accuracy(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: points, covered (share in some cluster), accuracy (share of those whose cluster's majority is theirs)."""
    m = majority_labels(assigned.filter("cluster >= 0"), labels)
    hit = m.agg(F.sum("n").alias("hits"), F.sum("size").alias("inside"))
    total = assigned.agg(F.count("*").alias("points"))
    return total.join(F.broadcast(hit)).select("points", (F.coalesce("inside", F.lit(0)) / F.col("points")).alias("covered"), (F.col("hits") / F.col("inside")).alias("accuracy"))

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestream.operators import clustering as C


def points(spark, x, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else 0, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label int, features array<double>")


def test_summaries_add_up(spark):
    x = np.arange(12.0).reshape(6, 2)
    p = points(spark, x, [0, 0, 1, 1, 1, 0]).withColumn("cluster", F.col("label").cast("long"))
    got = {r["cluster"]: (r["n"], r["sum"], r["sumsq"]) for r in C.summaries(p).collect()}
    assert got[1] == (3, list(x[2:5].sum(0)), list((x[2:5] ** 2).sum(0)))
    halves = [C.summaries(p.filter(f"id % 2 = {k}")) for k in (0, 1)]
    assert {r["cluster"]: (r["n"], r["sum"], r["sumsq"]) for r in C.merge_summaries(*halves).collect()} == got


def test_distance_skips_flat_dimensions():
    d = C.normalised_distance(np.array([[1.0, 5.0]]), np.array([[0.0, 0.0], [0.0, 0.0]]), np.array([[0.5, 0.0], [0.0, 0.0]]))
    assert d.tolist() == [[2.0, np.inf]]


def test_nearest(spark):
    s = C.Summaries(1)
    for c in (0.0, 10.0):
        s.add(2, np.array([2 * c]), np.array([2 * (c * c + 1)]))
    got = {r["id"]: r["cluster"] for r in C.nearest(points(spark, [[0.5], [9.5], [50.0]]), s, 2.0).collect()}
    assert got == {0: 0, 1: 1, 2: None}
    assert C.nearest(points(spark, [[0.5]]), C.Summaries(1), 2.0).first()["cluster"] is None


def test_bfr_finds_the_groups(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0, 0], [40, 0, 0], [0, 40, 40]])
    labels = np.repeat([0, 1, 2], 150)
    x = centres[labels] + rng.normal(0, 1, (450, 3))
    far = rng.uniform(300, 900, (12, 3))
    p = points(spark, np.vstack([x, far]), np.r_[labels, [-1] * 12])
    assigned, rounds = C.bfr(p, 3)
    got = {r["id"]: r["cluster"] for r in assigned.collect()}
    assert sorted(got) == list(range(462))
    one = C.accuracy(assigned, p).first()
    assert one["points"] == 462 and one["accuracy"] > 0.98 and one["covered"] > 0.85
    assert sum(got[i] == -1 for i in range(450, 462)) >= 9
    r = rounds.orderBy("round").collect()
    chunks = {x["chunk"]: x["count"] for x in C.chunk(p).groupBy("chunk").count().collect()}
    for k, x in enumerate(r, 1):
        assert x["ds_points"] + x["cs_points"] + x["rs_points"] == sum(chunks[c] for c in range(1, k + 1))


def test_empty_and_few(spark):
    a, r = C.bfr(points(spark, []), 2)
    assert a.count() == 0 and r.count() == 0
    assert C.k_means(points(spark, [[1.0], [2.0]]), 5).select("cluster").distinct().count() == 2
    few, _ = C.bfr(points(spark, [[0.0, 0.0]] * 3), 2)
    assert few.count() == 3


def test_majority(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], "id long, cluster int")
    labels = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9), (5, 3)], "id long, label int")
    assert sorted(tuple(r) for r in C.majority_labels(a, labels).collect()) == [(0, 7, 2, 3), (1, 3, 1, 2)]


def test_compression_clusters_merge_into_the_first_later_one():
    cs, home = C.Summaries(1), [0, 1, 2, 3]
    for centre in (0.0, 3.0, 1.5, 50.0):  # spread 1 each: 0 is near 1 and 2, 1 near 2, 3 near none
        cs.add(4, np.array([4 * centre]), np.array([4 * (centre * centre + 1)]))
    C._merge_close(cs, home, 3.5)
    assert home == [1, 2, 2, 3]  # the first later one, not the nearest, decided before any merge
    assert cs.n[2] == 12 and cs.s[2][0] == 4 * 4.5 and C._home(home, 0) == 2


def test_chunks_are_equal(spark):
    p = points(spark, [[float(k)] for k in range(103)])
    sizes = {r["chunk"]: r["count"] for r in C.chunk(p).groupBy("chunk").count().collect()}
    assert sorted(sizes) == [1, 2, 3, 4, 5] and set(sizes.values()) == {20, 21}
    assert C.chunk(p.limit(0)).count() == 0

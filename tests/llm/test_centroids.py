from __future__ import annotations

import random

import numpy as np

from lodestream.llm import centroids as C

SCHEMA = "stat_id long, chunk int, n long, sum array<double>, sumsq array<double>, loaded_at timestamp_ntz, lead string"


def stats(spark, points, n=2, dims=8):
    return spark.createDataFrame([(i, 1, n, [float(v) * n for v in p], None, None, "x") for i, p in points], SCHEMA)


def clusters(spark, df, dims=8, radius=6.0):
    return {r["stat_id"]: r["lead_id"] for r in C.cluster_records(df, radius, dims).collect()}


def test_valid_records(spark):
    import datetime as dt

    d = dt.datetime(2020, 1, 1)
    one = [1.0] * 8
    rows = [
        (1, 1, 2, one, None, d, ""), (1, 1, 2, one, None, d, ""), (1, 1, 4, one, None, d + dt.timedelta(1), ""), (2, 1, 0, one, None, d, ""), (3, 1, -1, one, None, d, ""), (4, 1, None, one, None, d, ""),
        (5, 1, 1, None, None, d, ""), (6, 1, 1, one[:7], None, d, ""), (7, 1, 1, [*one[:7], None], None, d, ""), (8, 1, 1, [*one[:7], float("nan")], None, d, ""), (9, 1, 1, [*one[:7], float("inf")], None, d, ""),
        (None, 1, 1, one, None, d, ""), (10, 1, 1, one, None, None, ""),
    ]
    got = {r["stat_id"]: (r["n"], r["centroid"][0]) for r in C.valid_records(spark.createDataFrame(rows, SCHEMA), 8).collect()}
    assert got == {1: (2, 0.5), 10: (1, 1.0)}


def grouped(seed=1, groups=40, most=30):
    rng = np.random.default_rng(seed)
    out, truth, i = [], {}, 0
    for g in range(groups):
        centre = rng.integers(-6, 7, 8) * 15.0
        centre[0] = g * 15.0
        size = int(rng.integers(1, most))
        ids = []
        for _ in range(size):
            v = rng.normal(0, 1, 8)
            i += 1
            out.append((i, centre + v / np.linalg.norm(v) * rng.uniform(0, 2.9)))
            ids.append(i)
        truth |= dict.fromkeys(ids, min(ids))
    random.Random(seed).shuffle(out)
    return out, truth


def test_groups_are_found(spark):
    pts, truth = grouped()
    assert clusters(spark, stats(spark, pts)) == truth


def test_a_hot_group_and_repeats(spark):
    rng = np.random.default_rng(3)
    pts = [(i, rng.uniform(-1, 1, 8)) for i in range(1, 1_500)] + [(5_000, np.full(8, 40.0)), (5_001, np.full(8, 40.0))]
    got = clusters(spark, stats(spark, pts))
    assert set(got.values()) == {1, 5_000} and got[5_001] == 5_000


def test_distance_at_the_radius_counts(spark):
    a, b, c = np.zeros(8), np.zeros(8), np.zeros(8)
    b[0], c[0] = 6.0, 12.5
    assert clusters(spark, stats(spark, [(1, a), (2, b), (3, c)])) == {1: 1, 2: 1, 3: 3}


def test_loose_groups_are_split_around_medoids(spark):
    chain = [(k, np.r_[k * 5.0, np.zeros(7)]) for k in range(12)]
    got = clusters(spark, stats(spark, chain))
    assert len(set(got.values())) >= 4
    for lead in set(got.values()):
        xs = [5.0 * k for k, v in got.items() if v == lead]
        assert max(xs) - min(xs) <= 12.0  # all within the radius of a medoid


def test_large_groups_are_split_alike(spark, monkeypatch):
    chain = [(k, np.r_[k * 5.0, np.zeros(7)]) for k in range(12)]
    pts, truth = grouped(4, 12, 25)
    for most in (2_000, 1):  # one pass with exact degrees, and rounds
        monkeypatch.setattr(C, "SMALL_GROUP", most)
        assert clusters(spark, stats(spark, pts)) == truth
        got = clusters(spark, stats(spark, chain))
        assert all(abs(k - lead) <= 2 for k, lead in got.items())


def loose(seed, most, n=250):
    """Points that are near each other without any classes, in three dimensions."""
    x = np.random.default_rng(seed).uniform(0, most, (n, 8)) * np.r_[1, 1, 1, 0, 0, 0, 0, 0]
    return list(enumerate(x, 1))


def near(x, radius=6.0):
    return ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius * radius


def test_links_are_all_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP_ROWS", 3_000)  # several groups, and several blocks in each
    monkeypatch.setattr(C, "BLOCK_PAIRS", 50, raising=False)
    for most in (10, 25, 100):
        pts = loose(most, most)
        cells = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in pts], "lead long, rep array<double>")
        got = [tuple(r) for r in C.links(cells, 6.0, len(pts)).collect()]
        want = {(i + 1, j + 1) for i, j in np.argwhere(near(np.stack([p for _, p in pts]))).tolist() if i > j}
        assert len(got) == len(set(got)) and set(got) == want


def by_brute_force(pts, radius=6.0):
    """Components of the fine cells' leads, split around the medoids of most neighbours."""
    cell = {i: tuple(np.floor(p / (radius / np.sqrt(8) * (1 - 1e-9)))) for i, p in pts}
    lead = {}
    for i in sorted(cell):
        lead.setdefault(cell[i], i)
    ids, at = sorted(lead.values()), dict(pts)
    close = near(np.stack([at[i] for i in ids]), radius)
    reach = np.linalg.matrix_power(close.astype(float), 2) > 0
    while ((further := reach.astype(float) @ reach > 0) != reach).any():
        reach = further
    name, rest = {}, set(range(len(ids)))
    while rest:
        component = rest & set(np.flatnonzero(reach[min(rest)]).tolist())
        medoid = max(component, key=lambda k: (close[k].sum(), -k))
        mine = {k for k in component if close[medoid, k]}
        name |= dict.fromkeys((ids[k] for k in mine), ids[min(mine)])
        rest -= mine
    return {i: name[lead[c]] for i, c in cell.items()}


def test_loose_groups_go_by_all_links(spark, monkeypatch):
    for seed, most, n in ((1, 15, 250), (2, 40, 120)):
        pts = loose(seed, most, n)
        want = by_brute_force(pts)
        assert len(set(want.values())) > 5
        for small in (2_000, 1):
            monkeypatch.setattr(C, "SMALL_GROUP", small)
            assert clusters(spark, stats(spark, pts)) == want


def test_sets_of_cells_stand_for_distance():
    rng = np.random.default_rng(2)
    a = rng.uniform(-100, 100, (4_000, 8))
    step = rng.normal(0, 1, a.shape)
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    sets, last = C.cell_sets(a, 6.0), 1.0
    assert (C.jaccard(sets, sets) == 1).all()
    for distance in (1.0, 6.0, 30.0, 200.0):
        other = C.cell_sets(a + distance * step, 6.0)
        similar = C.jaccard(sets, other)
        assert similar.mean() < last
        last = similar.mean()
        met = (C.band_keys(sets) == C.band_keys(other)).any(axis=1) & (similar >= C.LEAST_JACCARD)
        if distance <= 6.0:
            assert met.all()
    assert last < 0.01
    s = [set(x.tolist()) for x in sets[:2]]
    assert C.jaccard(sets[:1], sets[1:2])[0] == len(s[0] & s[1]) / len(s[0] | s[1])


def test_report_and_recall(spark):
    pts, truth = grouped(5, 8, 12)
    d = C.describe(C.cluster_records(stats(spark, pts, 3), 6.0))
    got = {r["lead_id"]: r for r in d.collect()}
    for lead in set(truth.values()):
        ids = [i for i, v in truth.items() if v == lead]
        assert got[lead]["records"] == len(ids) and got[lead]["points"] == 3 * len(ids)
        x = {i: p for i, p in pts if i in ids}
        centre = np.mean(list(x.values()), axis=0)
        assert got[lead]["typical"][0] == min(ids, key=lambda i: (round(float(np.linalg.norm(x[i] - centre)), 9), i))
    assert C.band_recall(6.0, 6.0, 8) > 0.999999


def test_empty(spark):
    assert clusters(spark, stats(spark, [(1, np.zeros(8))]).limit(0)) == {}
    assert clusters(spark, stats(spark, [(1, np.zeros(8))])) == {1: 1}

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from lodestream.llm import cooccur as C
from lodestream.llm import incidence
from lodestream.scratch import written


def sets():
    rnd = random.Random(4)
    out = []
    for _ in range(400):
        s = {f"i{min(int(rnd.expovariate(0.12)), 39)}" for _ in range(rnd.choice([1, 2, 3, 6]))}
        if rnd.random() < 0.07:
            s |= {"p", "q"}
        out.append(s)
    return out


def baskets(spark, data):
    df = spark.createDataFrame([(f"u{k}", i) for k, s in enumerate(data) for i in s] + [(None, "p"), ("u0", None)], "u string, b string")
    return df, written(incidence.pairs(df, "u", "b"))


def test_counts_and_lift(spark):
    data = sets()
    df, b = baskets(spark, data)
    n = sum(bool(s) for s in data)
    have = {i: sum(i in s for s in data) for s in data for i in s}
    for wide in (1_000, 4):
        pairs, total, _ = C.common_baskets(b, 5, 2.0, wide)
        named = incidence.with_names(pairs.select("a", "b", "common"), incidence.names(df, "b"), "a", "b", "x", "y")
        want = {}
        for x, y in itertools.combinations(sorted(have), 2):
            c = sum(x in s and y in s for s in data)
            if c >= 5 and c * n >= 2.0 * have[x] * have[y]:
                want[x, y] = c
        assert total == n and {(r["x"], r["y"]): r["common"] for r in named.collect()} == want and ("p", "q") in want


def test_null_reproduces_the_degrees():
    sizes, freq = (np.array([1.0, 2.0, 5.0]), np.array([50.0, 40.0, 10.0])), (np.array([3.0, 8.0, 30.0]), np.array([20.0, 10.0, 10 / 3]))
    assert math.isclose((sizes[0] * sizes[1]).sum(), 180) and math.isclose((freq[0] * freq[1]).sum(), 240)
    freq = (freq[0] * 0.75, freq[1])
    x, y = C.fit_null(sizes, freq)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * freq[1]).sum(axis=1), sizes[0], rtol=1e-6) and np.allclose((p * sizes[1][:, None]).sum(axis=0), freq[0], rtol=1e-6)


def test_a_fit_that_has_not_settled_is_raised():
    sizes, freq = (np.array([1.0, 2.0, 5.0]), np.array([50.0, 40.0, 10.0])), (np.array([2.25, 6.0, 22.5]), np.array([20.0, 10.0, 10 / 3]))
    with pytest.raises(RuntimeError, match="settle"):
        C.fit_null(sizes, freq, rounds=2)


def test_degree_classes_change_expectations_and_tails_little():
    """Degrees above 1,000 are fitted in classes of 1 %; pairs are scored with their own degrees all the same."""
    rng = np.random.default_rng(5)
    f = np.sort(rng.integers(1_001, 30_000, 300)).astype(float)
    sizes = (np.array([2.0, 5.0, 40.0]), np.array([f.sum() * 0.2 / 2, f.sum() * 0.3 / 5, f.sum() * 0.5 / 40]))
    kind = np.round(np.log(f) / math.log(1.01))
    classes, inverse = np.unique(kind, return_inverse=True)
    count = np.bincount(inverse).astype(float)
    x, y = C.fit_null(sizes, (f, np.ones(len(f))))
    cx, cy = C.fit_null(sizes, (np.bincount(inverse, weights=f) / count, count))
    near = np.exp(np.interp(np.log(f), np.log(np.bincount(inverse, weights=f) / count), np.log(cy)))
    a, b = rng.integers(0, len(f), (2, 200))
    chance = lambda x, v: np.outer(v[a], x) / (1 + np.outer(v[a], x)) * np.outer(v[b], x) / (1 + np.outer(v[b], x))
    exact, coarse = chance(x, y), chance(cx, near)
    want, got = (exact * sizes[1]).sum(axis=1), (coarse * sizes[1]).sum(axis=1)
    assert np.abs(got / want - 1).max() < 0.002
    at = np.ceil(want * 1.5 + 20).astype(np.int64)
    tails = C.log10_tail(exact, sizes[1], at), C.log10_tail(coarse, sizes[1], at)
    assert np.abs(tails[1] / tails[0] - 1).max() < 0.02


def exact_tail(p, count, k):
    d = np.array([1.0])
    for q, c in zip(p, count, strict=True):
        for _ in range(int(c)):
            d = np.convolve(d, [1 - q, q])
    return d[k:].sum()


def test_tail_against_convolution():
    rng = np.random.default_rng(1)
    count = np.array([40.0, 25.0, 10.0, 3.0])
    for _ in range(6):
        p = rng.uniform(0.001, 0.15, 4)
        mean = (p * count).sum()
        for k in range(int(mean) + 2, int(mean) + 16, 3):
            want = math.log10(exact_tail(p, count, k))
            got = C.log10_tail(p[None, :], count, np.array([k]))[0]
            assert abs(got - want) < 0.03, (k, got, want)
    assert C.log10_tail(np.array([[0.1, 0.1]]), np.array([2.0, 1.0]), np.array([4]))[0] == -np.inf
    assert math.isclose(C.log10_tail(np.array([[0.1, 0.2]]), np.array([2.0, 1.0]), np.array([3]))[0], math.log10(0.002))
    assert C.log10_tail(np.array([[0.5, 0.5]]), np.array([4.0, 4.0]), np.array([1]))[0] == 0.0


def test_planted_pair_stands_out(spark):
    data = sets()
    df, b = baskets(spark, data)
    pairs, _, items = C.common_baskets(b, 3, 0.0)
    sizes, freq = C.degree_table(b, "s"), C.degree_table(b, "i")
    scored = C.surprise(pairs, sizes, freq, *C.fit_null(sizes, freq))
    out = incidence.with_names(C.discoveries(scored, math.comb(items.count(), 2)).select("a", "b", "surprise", "significant"), incidence.names(df, "b"), "a", "b", "x", "y").collect()
    best = max(out, key=lambda r: r["surprise"])
    assert (best["x"], best["y"], best["significant"]) == ("p", "q", True) and best["surprise"] > 10
    others = [r for r in out if (r["x"], r["y"]) != ("p", "q")]
    assert sum(r["significant"] for r in others) <= max(2, 0.1 * len(others))


def test_empty(spark):
    _, b = baskets(spark, [])
    pairs, n, _ = C.common_baskets(b.limit(0), 1, 1.0)
    assert n == 0 and pairs.count() == 0

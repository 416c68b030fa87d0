from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from lodestream.llm import forest as T
from lodestream.llm import incidence
from lodestream.scratch import written


def table(spark, sets):
    return spark.createDataFrame([(name, x) for name, s in sets.items() for x in s] + [(None, "q"), ("s0", None)], "b string, u string")


def found(spark, sets, similarity=0.5, least=5, hot=incidence.HOT_ROWS, **how):
    df = table(spark, sets)
    members = written(incidence.pairs(df, "b", "u", hot))
    links, copies = T.similar_pairs(members, similarity, least, **how)
    pairs = incidence.with_names(T.expand(links, copies), incidence.names(df, "b"), "s1", "s2", "x", "y")
    return sorted(tuple(r) for r in pairs.collect())


def brute(sets, similarity=0.5, least=5):
    big = {k: s for k, s in sets.items() if len(s) >= least}
    return sorted((a, b) for a, b in itertools.combinations(sorted(big), 2) if len(big[a] & big[b]) >= similarity * len(big[a] | big[b]))


def sample():
    rnd = random.Random(8)
    sets = {}
    for k in range(60):
        s = {f"u{x}" for x in rnd.sample(range(4_000), rnd.choice([3, 5, 6, 9, 30, 80]))}
        sets[f"s{k}"] = s
        for j in range(rnd.choice([0, 0, 1, 3])):
            keep = set(rnd.sample(sorted(s), max(1, round(len(s) * rnd.choice([1.0, 0.9, 0.75, 0.67, 0.5])))))
            sets[f"s{k}v{j}"] = keep | {f"v{k}{j}{x}" for x in range(rnd.choice([0, 0, 1]))}
    return sets


def test_plan():
    depth, meetings = T.plan(0.5, 0.99999, 60)
    assert (depth, meetings) == (2, 3) and T.miss(0.5, 60, depth, meetings) < 1e-5
    assert T.recall_bound(0.5, 60, 0.99999) > 0.99999 and T.miss(1.0, 60, 9, 60) == 0


def test_minhash_of_runs():
    x = np.arange(40, dtype=np.int64) * 7919
    whole = T.minhash(x, np.array([0, 10]), 16)
    assert (whole[0] == T.minhash(x[:10][::-1].copy(), np.array([0]), 16)[0]).all()
    assert (np.minimum(whole[0], whole[1]) == T.minhash(x, np.array([0]), 16)[0]).all()


@pytest.mark.parametrize("hot", [incidence.HOT_ROWS, 20])
def test_against_brute_force(spark, hot):
    sets = sample()
    want = brute(sets)
    assert len(want) > 15
    assert found(spark, sets, hot=hot) == want


@pytest.mark.parametrize(("crowd", "deepest"), [(2, 8), (2, 2), (6, 3)])
def test_crowded_prefixes_lose_nothing(spark, crowd, deepest):
    """Prefixes shared by more than a few sets are deepened, and sets that lose too many trees are looked up."""
    sets = sample()
    sets |= {f"b{k}": {"busy", "busier", *(f"u{(k * 7 + j) % 60}" for j in range(4))} for k in range(60)}
    want = brute(sets)
    assert found(spark, sets, crowd=crowd, deepest=deepest) == want


def test_deepening_is_paid_for():
    spare = T.spare_trees(0.5, 60, 2, 3, 0.9999)
    assert spare == 10 and T.miss(0.5, 50, 2, 3) <= 1e-4 < T.miss(0.5, 49, 2, 3)
    assert T.spare_trees(0.5, 60, 2, 3, 0.999_999_9) == 0


def test_one_busy_item_stays_near_linear(spark):
    """Ten thousand sets that share one item, and nothing else, do not become all pairs of a bucket."""
    n = 10_000
    rows = spark.range(n).selectExpr("concat('s', id) as b", "explode(transform(sequence(0, 5), k -> if(k = 0, 'busy', concat('u', id, '-', k)))) as u")
    near = spark.createDataFrame([("x1", f"u7-{k}") for k in range(1, 6)], "b string, u string")
    members = written(incidence.pairs(rows.unionByName(near), "b", "u"))
    sets = written(T.sketches(members, 120, 5))
    found, deepened = T.leaves(sets, 60, 2, 0.5, crowd=64)
    assert deepened is not None and deepened.filter("stuck").isEmpty()
    widest = found.groupBy("t", "k1", "k2").count().agg({"count": "max"}).first()[0]
    compared = T.neighbours(found, 0.5).count()
    assert widest <= 64 and compared < 60 * n  # of n * n / 2 = 50 million pairs, in every crowded tree
    links, _ = T.similar_pairs(members, 0.5, 5, crowd=64)
    assert links.count() == 1


def test_copies(spark):
    sets = {f"c{k}": {f"u{x}" for x in range(8)} for k in range(12)} | {"near": {f"u{x}" for x in range(7)}, "far": {f"w{x}" for x in range(8)}}
    df = table(spark, sets)
    links, copies = T.similar_pairs(written(incidence.pairs(df, "b", "u")), 0.5, 5)
    assert links.count() == 1 and copies.select("c").distinct().count() == 3  # one link for twelve copies
    assert found(spark, sets) == brute(sets)


def test_edges(spark):
    five = {f"u{x}" for x in range(5)}
    assert found(spark, {"a": five, "b": five, "c": {"u0"}}) == [("a", "b")]
    assert found(spark, {"a": {"u0"}}) == []
    exact = {"a": {f"u{x}" for x in range(9)}, "b": {f"u{x}" for x in range(3, 12)}}  # 6 of 12
    assert found(spark, exact) == [("a", "b")]
    empty = table(spark, {}).limit(0)
    links, copies = T.similar_pairs(written(incidence.pairs(empty, "b", "u")), 0.5, 5)
    assert T.expand(links, copies).count() == 0

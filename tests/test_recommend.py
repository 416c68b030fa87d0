from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import features as X
from lodestream.operators import recommend as P

RATED = "user_id string, business_id string, rating double"


def df(spark, data):
    return spark.createDataFrame([(u, b, float(r)) for u, b, r in data], RATED)


def sim(spark, data, penalties=None, wanted=(("a", "b"),)):
    r = df(spark, data)
    w = spark.createDataFrame(list(wanted), "i string, j string")
    return {(x["i"], x["j"]): (x["common"], x["similarity"]) for x in P.item_similarity(w, P.pair_ratings(r), r, penalties).collect()}


def test_similarity_branches(spark):
    assert sim(spark, [("u", "a", 5), ("v", "b", 3)]) == {("a", "b"): (0, 0.6)}
    assert sim(spark, [("u", "a", 5), ("u", "b", 3)]) == {("a", "b"): (1, 0.6)}
    two = [("u", "a", 5), ("u", "b", 3), ("v", "a", 2), ("v", "b", 2)]
    assert sim(spark, two) == {("a", "b"): (2, 0.8)}
    assert sim(spark, two, "hybrid") == {("a", "b"): (2, 0.56)}
    assert sim(spark, two, "wide") == {("a", "b"): (2, round(2 / 30, 6))}
    three = [("u", "a", 5), ("v", "a", 3), ("w", "a", 1), ("u", "b", 4), ("v", "b", 3), ("w", "b", 2)]
    assert sim(spark, three) == {("a", "b"): (3, 1.0)}
    assert sim(spark, three, "hybrid") == {("a", "b"): (3, 0.06)}
    flat = [(u, b, 3) for u in "uvw" for b in "ab"]
    assert sim(spark, flat) == {("a", "b"): (3, 0.0)}
    assert sim(spark, three, wanted=[("a", "zz")]) == {("a", "zz"): (0, 0.0)}
    with pytest.raises(ValueError):
        sim(spark, three, "other")


def test_repeated_pairs_count_once_in_similarity_and_always_in_means(spark):
    data = [("u", "a", 5), ("u", "a", 1), ("v", "b", 3)]
    assert sim(spark, data) == {("a", "b"): (0, 1.0)}  # mean of a is 3


def test_cascade(spark):
    train = [("u", "a", 4), ("u", "b", 2), ("v", "a", 5), ("v", "b", 1), ("w", "a", 3)]
    test = spark.createDataFrame([("u", "a"), ("new", "a"), ("u", "new"), ("new", "new"), ("w", "b"), ("u", "a")], "user_id string, business_id string")
    got = {(r["user_id"], r["business_id"]): r["prediction"] for r in P.predict(test, df(spark, train)).collect()}
    assert got[("u", "a")] == 4.0 and got[("new", "a")] == 4.0 and got[("u", "new")] == 3.0 and got[("new", "new")] == 3.0
    assert abs(got[("w", "b")] - 3.0) < 1e-9 and len(got) == 5  # its only neighbour a is rated 3
    conf = {(r["user_id"], r["business_id"]): (r["prediction"], r["confidence"]) for r in P.predict(test, df(spark, train), penalties="hybrid", confidence=True).collect()}
    assert conf[("new", "new")] == (3.0, 0.05) and conf[("new", "a")][1] == 0.1 and conf[("u", "new")][1] == 0.1
    assert 0 < conf[("w", "b")][1] < 0.6
    assert P.predict(test.limit(0), df(spark, train)).count() == 0
    assert {r["prediction"] for r in P.predict(test, df(spark, [])).collect()} == {None}


def test_prediction_against_brute_force(spark):
    rnd = random.Random(2)
    train = [(f"u{rnd.randint(0, 14)}", f"b{rnd.randint(0, 9)}", rnd.randint(1, 5)) for _ in range(110)]
    best = {}
    for u, b, r in train:
        best[u, b] = max(r, best.get((u, b), 0))
    mean = lambda xs: sum(xs) / len(xs)
    bm = {b: mean([r for _, c, r in train if c == b]) for _, b, _ in train}
    um = {u: mean([r for v, _, r in train if v == u]) for u, _, _ in train}

    def s(i, j):
        both = [(best[u, i], best[u, j]) for u in um if (u, i) in best and (u, j) in best]
        if len(both) <= 1:
            return (5 - abs(bm[i] - bm[j])) / 5
        if len(both) == 2:
            return mean([(5 - abs(x - y)) / 5 for x, y in both])
        mx, my = mean([x for x, _ in both]), mean([y for _, y in both])
        d = math.sqrt(sum((x - mx) ** 2 for x, _ in both) * sum((y - my) ** 2 for _, y in both))
        return sum((x - mx) * (y - my) for x, y in both) / d if d > 1e-12 else 0.0

    want = {}
    for u in um:
        for b in bm:
            if (u, b) in best:
                want[u, b] = best[u, b]
                continue
            near = sorted(((-math.floor(s(min(b, o), max(b, o)) * 1e6 + 0.5) / 1e6, o) for o in bm if (u, o) in best and o != b))
            near = [(-x, o) for x, o in near if x < 0][:15]
            want[u, b] = min(5, max(1, sum(x * best[u, o] for x, o in near) / sum(x for x, _ in near))) if near else um[u]
    test = spark.createDataFrame(list(want), "user_id string, business_id string")
    got = {(r["user_id"], r["business_id"]): r["prediction"] for r in P.predict(test, df(spark, train)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_weight_and_blend(spark):
    def weight(conf, ur, br, us, bs, variant="standard"):
        row = spark.createDataFrame([(conf, ur, br, us, bs)], "c double, ur int, br int, us double, bs double")
        return round(row.select(P.hybrid_weight(*[F.col(x) for x in ("c", "ur", "br", "us", "bs")], variant)).first()[0], 9)

    assert weight(0.5, 10, 20, 3.0, 3.0) == 0.1
    assert weight(0.5, 31, 51, 3.0, 3.0) == 0.2
    assert weight(0.5, None, 20, 3.0, 3.0) == 0.05
    assert weight(0.5, 40, None, 3.0, 3.0) == 0.05
    assert weight(0.6, 31, 51, 4.9, 1.0) == 0.32
    assert weight(0.1, 1, 1, 3.0, 3.0) == 0.05
    assert weight(0.6, 31, 51, 5.0, 5.0, "narrow") == 0.19
    assert weight(0.6, 4, 51, 3.0, 3.0, "narrow") == 0.11 and weight(0.6, 31, 9, 3.0, 3.0, "narrow") == 0.11
    train = df(spark, [("u", "a", 5), ("u", "a", 4), ("u", "b", 3), ("v", "a", 1)])
    users, businesses = P.training_activity(train)
    assert sorted(map(tuple, users.collect())) == [("u", 2, 4.0), ("v", 1, 1.0)]
    assert sorted(map(tuple, businesses.collect())) == [("a", 2, 10 / 3), ("b", 1, 3.0)]
    assert spark.range(1).select(P.blend(F.lit(0.25), F.lit(1.0), F.lit(9.0))).first()[0] == 5.0


def test_errors(spark):
    p = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 1.0), ("v", "a", 1.5)], "user_id string, business_id string, prediction double")
    e = P.with_error(p, df(spark, [("u", "a", 4), ("u", "b", 5), ("v", "a", 1), ("x", "a", 1)]))
    assert [tuple(r) for r in P.rmse(e).collect()] == [(3, round(math.sqrt((1 + 16 + 0.25) / 3), 6))]
    assert {r["bin"]: r["n"] for r in P.error_histogram(e).collect()} == {"[0,1)": 1, "[1,2)": 1, "[2,3)": 0, "[3,4)": 0, "[4,inf)": 1}
    assert [tuple(r) for r in P.rmse(e.limit(0)).collect()] == [(0, 0.0)]
    assert {r["share"] for r in P.error_histogram(e.limit(0)).collect()} == {0.0}


def test_features(spark):
    b = spark.createDataFrame([("a", 4.0, 7, 1, "X, Y", {"RestaurantsPriceRange2": "'2'"}), ("b", None, None, None, None, None), ("c", 1.0, 1, 0, "", {"RestaurantsPriceRange2": "cheap", "W": "1"})], "business_id string, stars double, review_count int, is_open int, categories string, attributes map<string,string>")
    got = {r["business_id"]: tuple(r)[1:] for r in X.business_features(b).collect()}
    assert got == {"a": (4.0, 7, 1, 1, 2, 2), "b": (3.5, 0, 0, 0, 0, 0), "c": (1.0, 1, 0, 2, 0, 0)}
    kinds = ", ".join(f"compliment_{c} int" for c in X.COMPLIMENTS)
    u = spark.createDataFrame([("u", 4.0, 3, 1, 1, 2, 3, "x, y", "2015", "2015-01-01 10:00:00", *[11] * 11), ("v", None, None, None, None, None, None, "None", None, "n/a", *[None] * 11)], f"user_id string, average_stars double, review_count int, fans int, useful int, funny int, cool int, friends string, elite string, yelping_since string, {kinds}")
    got = {r["user_id"]: tuple(r)[1:] for r in X.user_features(u, "2016-01-01").collect()}
    assert got["u"] == (4.0, 3, 1, 1, 2, 3, 1, 2, 11.0, 365 / 365.25) and got["v"] == (3.5, 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0)
    assert X.user_features(u, "2014-01-01").filter("user_id = 'u'").first()["membership_years"] == 0.0
    c = spark.createDataFrame([("a", {"1": 2, "2": 3}), ("a", None), ("b", {})], "business_id string, time map<string,int>")
    assert {r[0]: r[1] for r in X.checkin_totals(c).collect()} == {"a": 5, "b": 0}
    t = spark.createDataFrame([("u", "a", 1), ("u", "a", None), (None, "a", 1)], "user_id string, business_id string, likes int")
    assert [tuple(r) for r in X.tip_statistics(t).collect()] == [("u", "a", 1, 2)]
    ph = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "y")], "business_id string, label string")
    assert [tuple(r) for r in X.photo_statistics(ph).collect()] == [("a", 2, 3)]
    r = spark.createDataFrame([("u", "a", 4.0, 1.0, 2.0, None), ("v", "a", 2.0, 3.0, None, None)], "user_id string, business_id string, stars double, useful double, funny double, cool double")
    train = df(spark, [("u", "a", 4), ("q", "a", 2), ("q", "c", 3), ("v", "zz", 5)])
    pairs = df(spark, [("u", "a", 5), ("q", "zz", 1), ("new", "other", 1)])

    def vector(columns, **more):
        got = X.assemble(pairs, X.user_features(u, "2016-01-01"), X.business_features(b), r, columns, t, ph, c, **more)
        assert got.columns == ["user_id", "business_id", "rating", *columns]
        return {x["user_id"]: tuple(x)[3:] for x in got.collect()}

    # by hand: user u has 3 reviews, 1 fan, votes 1, 2, 3 and two friends; business a has 4 stars, 7 reviews, is open, 2 categories
    assert X.FEATURES_22[:15] == ["r_useful", "r_funny", "r_cool", "r_n", "u_stars", "u_reviews", "fans", "u_useful", "u_funny", "u_cool", "num_friends", "b_stars", "b_reviews", "b_open", "num_categories"]
    got = vector(X.FEATURES_22, ratings=train)
    assert got["u"] == (2.0, 2.0, 0.0, 2.0, 4.0, 3.0, 1.0, 1.0, 2.0, 3.0, 2.0, 4.0, 7.0, 1.0, 2.0, 16.0, 21.0, 2 / 3, 6 / 4, 3 / 8, 0.5, 0.5)
    assert got["q"] == (*[0.0] * 4, 2.5, *[0.0] * 6, 5.0, 0.0, 0.0, 0.0, 12.5, 0.0, 0.0, 0.0, 0.0, -1.0, 1.5)
    assert got["new"][4] == 3.5 and got["new"][11] == 3.5 and got["new"][-2:] == (0.0, 0.0)
    assert X.FEATURES_6 == ["r_useful", "r_funny", "u_stars", "b_stars", "u_reviews", "b_reviews"]
    got = vector(X.FEATURES_6, ratings=train)
    assert got["u"] == (2.0, 2.0, 4.0, 4.0, 3.0, 7.0) and got["q"] == (0.0, 0.0, 2.5, 5.0, 0.0, 0.0)
    assert X.FEATURES_25[:10] == ["u_reviews", "u_useful", "u_funny", "u_cool", "fans", "u_stars", "num_elite", "num_friends", "compliments", "membership_years"] and len(X.FEATURES_21) == 21
    got = vector(X.FEATURES_25)
    assert got["u"] == (3.0, 1.0, 2.0, 3.0, 1.0, 4.0, 1.0, 2.0, 11.0, 365 / 365.25, 4.0, 7.0, 1.0, 1.0, 2.0, 4.0, 1.0, 2.0, 0.0, 1.0, 2.0, 2.0, 3.0, 5.0, 2.0)
    assert got["new"] == (*[0.0] * 5, 3.5, *[0.0] * 4, 3.5, *[0.0] * 14)
    assert vector(X.FEATURES_21)["u"] == got["u"][:15] + got["u"][19:]


def test_trees_find_a_planted_signal(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (2_400, 3))
    stars = np.clip(np.where(x[:, 0] > 0.5, 4.3, 1.7) + 0.6 * x[:, 1] + rng.normal(0, 0.2, len(x)), 1, 5)
    rows = spark.createDataFrame([(k, float(y), *map(float, v)) for k, (y, v) in enumerate(zip(stars, x, strict=True))], "id long, rating double, a double, b double, c double")
    train, test = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    out = X.boosted_trees(train, test, ["a", "b", "c"], trees=20, depth=3)
    error = out.select(F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2))).first()[0]
    assert error < 0.35 * stars.std()  # the mean alone errs by the whole spread


def test_scaling_and_trees(spark):
    d = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "id int, a double, b double")
    assert [tuple(r) for r in X.min_max(d, ["a", "b"]).orderBy("id").collect()] == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 0.0)]
    train = spark.createDataFrame([(float(i % 5 + 1), float(i % 5), 1.0) for i in range(60)], "rating double, x double, y double")
    out = X.boosted_trees(train, train, ["x", "y"], trees=8, depth=3, step=0.5, scale=True)
    assert out.select(F.max(F.abs(F.col("prediction") - F.col("rating")))).first()[0] < 0.3
    assert out.select(F.max("prediction") <= 5, F.min("prediction") >= 1).first() == (True, True)

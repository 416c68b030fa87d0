from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import bitmaps as B

DIMS, CELLS = ["day", "city"], [["day"], ["day", "city"]]


def visits(spark, data):
    return spark.createDataFrame(data, "day string, city string, user_id string")


def sample(n=3_000, users=700):
    rnd = random.Random(2)
    return [(rnd.choice(["d1", "d2"]), rnd.choice("xxxy"), f"u{rnd.randrange(users)}") for _ in range(n)]


def test_sizes_meet_the_error():
    for n in (10, 10_000, 3_000_000, 10**9):
        m = B.bits_for(n, 0.01)
        assert B.standard_error(n, m) <= 0.01 and m & (m - 1) == 0 and m * math.exp(-n / m) >= 30
    assert B.bits_for(0, 0.01) == B.LEAST_BITS


def test_estimates_lie_within_their_bound(spark):
    data = sample()
    out, _, _ = B.distinct_cells(visits(spark, data), DIMS, CELLS, "user_id", 0.01)
    got = {(r["day"], r["city"]): r for r in out.collect()}
    assert set(got) == {(d, c) for d in ("d1", "d2") for c in ("ALL", "x", "y")}
    for (d, c), r in got.items():
        rows = [u for a, b, u in data if a == d and c in ("ALL", b)]
        assert r["rows"] == len(rows)
        assert abs(r["estimate"] - len(set(rows))) <= 4 * r["std_error"] + 1e-6


def test_partials_merge_to_the_whole(spark):
    df = visits(spark, sample())
    sizes = [1 << 12, 1 << 11]
    whole = B.partials(df, DIMS, CELLS, "user_id", sizes)
    early, late = B.partials(df.filter("city = 'x'"), DIMS, CELLS, "user_id", sizes), B.partials(df.filter("city = 'y'"), DIMS, CELLS, "user_id", sizes)
    key = lambda x: sorted((r["kind"], r["day"], r["city"], r["block"], tuple(r["bits"]), r["rows"]) for r in x.collect())
    assert key(B.merge(early, late)) == key(whole)
    assert [k[:-1] for k in key(B.merge(whole, whole))] == [k[:-1] for k in key(whole)]
    small = B.partials(df, DIMS, CELLS, "user_id", [1 << 10, 1 << 10])
    assert key(B.fold(whole, sizes, [1 << 10, 1 << 10])) == key(small)
    with pytest.raises(ValueError):
        B.fold(whole, sizes, [1 << 13, 1 << 10])
    per_day = B.partials(df, DIMS, [["day"]], "user_id", [1 << 11])
    assert key(B.roll_up(whole.filter("kind = 1").withColumn("kind", F.lit(0)), ["city"])) == key(per_day)


def test_a_cell_takes_at_most_its_bitmap(spark):
    df = visits(spark, [("d", "x", f"u{i}") for i in range(60_000)] + [("e", "y", "u1")])
    out, blocks, sizes = B.distinct_cells(df, DIMS, CELLS, "user_id", 0.01)
    held = {(r["kind"], r["day"]): r["n"] for r in blocks.groupBy("kind", "day").agg(F.sum(F.size("bits") * 8).alias("n")).collect()}
    assert held[0, "d"] <= sizes[0] // 8 < 60_000 * 8 // 20 and held[0, "e"] == 128
    r = out.filter("day = 'd' and city = 'ALL'").first()
    assert abs(r["estimate"] - 60_000) < 4 * r["std_error"] and r["std_error"] <= 0.01 * 60_000


def test_a_full_bitmap_has_no_estimate(spark):
    df = visits(spark, [("d", "x", f"u{i}") for i in range(60_000)])
    r = B.estimates(B.partials(df, DIMS, [DIMS], "user_id", [1 << 10]), DIMS, [1 << 10]).first()
    assert r["estimate"] is None and r["bound_95"] is None and r["rows"] == 60_000
    assert B.below_share(spark.createDataFrame([(100, None, None)], "rows long, estimate double, std_error double"), 0.25).first()["below"] is None


def test_what_cannot_be_met_is_raised():
    with pytest.raises(ValueError, match="bits"):
        B.bits_for(10**14, 0.000_01)


def test_only_cells_near_the_line_are_recounted(spark):
    cells = spark.createDataFrame([(1000, 100.0, 2.0), (1000, 249.0, 2.0), (1000, 400.0, 2.0)], "rows long, estimate double, std_error double")
    assert [r["below"] for r in B.below_share(cells, 0.25).orderBy("estimate").collect()] == [True, None, False]
    df = visits(spark, [("d", "x", f"u{i % 7}") for i in range(50)] + [("d", None, "u9"), ("d", "x", None)])
    wanted = spark.createDataFrame([(0, "d", "ALL"), (1, "d", None)], "kind int, day string, city string")
    assert sorted((r["kind"], r["ids"]) for r in B.exact_cells(df, DIMS, CELLS, "user_id", wanted).collect()) == [(0, 8), (1, 1)]


def test_nulls_and_empty(spark):
    df = visits(spark, [("d", None, "u"), ("d", "x", None), (None, "x", "u"), ("d", "x", "u"), ("d", "x", "u")])
    got = {(r["day"], r["city"]): (r["rows"], round(r["estimate"])) for r in B.distinct_cells(df, DIMS, CELLS, "user_id", 0.01)[0].collect()}
    assert got == {("d", None): (1, 1), (None, "x"): (1, 1), ("d", "x"): (2, 1), ("d", "ALL"): (3, 1), (None, "ALL"): (1, 1)}
    assert B.distinct_cells(df.limit(0), DIMS, CELLS, "user_id", 0.01)[0].count() == 0
    assert B.partials(df.withColumn("bits_", F.lit(1)), DIMS, CELLS, "user_id", [1 << 10] * 2).columns == ["kind", "day", "city", "block", "bits", "rows"]

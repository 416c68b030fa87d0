from __future__ import annotations

import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestream.llm.bitmaps import ALL
from tests.compare import agree


@pytest.mark.parametrize("name", ["p1_found", "p1_within_bound", "p2_found", "p2_cluster_sizes", "p3_found", "p4_found", "p6_found", "p10_text_statistics"])
def test_query_equals_its_sql(spark, name):
    agree(spark, name)


def test_surprise_covers_every_pair_with_a_common_user(spark, tmp_path):
    rows = [(f"u{k}", b) for k in range(200) for b in (f"b{k % 20}", f"b{(k * 7 + k // 20) % 20}")]
    rows += [(f"v{k}", b) for k in range(6) for b in ("rare 1", "rare 2")]
    spark.createDataFrame(sorted(set(rows)), "user_id string, business_id string").withColumn("stars", F.lit(4.0)).write.parquet(str(tmp_path / "yelp_train.parquet"))
    users = defaultdict(set)
    for u, b in rows:
        users[b].add(u)
    want = {(a, b): len(users[a] & users[b]) for a, b in itertools.combinations(sorted(users), 2) if users[a] & users[b]}
    got = {(r["business_id_1"], r["business_id_2"]): r for r in entry.queries()["p6_surprise"](spark, str(tmp_path)).collect()}
    assert {pair: r["common"] for pair, r in got.items()} == want and min(want.values()) == 1
    assert min(r["lift"] for r in got.values()) < 1 and got["rare 1", "rare 2"]["significant"]


def test_distinct_users_keep_rows_without_city_and_all_kinds_of_cell(spark, tmp_path):
    days, cities, channels = ["2024-01-01", "2024-01-02"], ["x", "y", None], ["app", None]
    rows = [(f"{d} 10:00:00", c, h, f"u{k}") for k, (d, c, h, _) in enumerate(itertools.product(days, cities, channels, range(5)))]
    rows += [(f"{d} 11:00:00", "x", "app", "both") for d in days] + [(None, "x", "app", "dayless"), ("2024-01-01 12:00:00", "x", "app", None)]
    spark.createDataFrame(rows, "ts string, city string, channel string, user_id string").selectExpr("cast(ts as timestamp) as ts", "city", "channel", "user_id").write.parquet(str(tmp_path / "stream_users.parquet"))
    want = defaultdict(set)
    for ts, c, h, u in rows:
        for used in itertools.product([True, False], repeat=3):
            if u and any(used):
                want[tuple(v if use else ALL for v, use in zip((ts and ts[:10], c, h), used, strict=True))].add(u)
    got = {(r["day"], r["city"], r["channel"]): round(r["estimate"]) for r in entry.queries()["p1_distinct_users"](spark, str(tmp_path)).collect()}
    assert got == {cell: len(users) for cell, users in want.items()}

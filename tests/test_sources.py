from __future__ import annotations

import pytest

from lodestream.sources import readers, sinks, views


def test_json_strict_and_permissive(spark, tmp_path):
    f = tmp_path / "business.json"
    f.write_text('{"business_id": "a", "city": "X", "attributes": {"k": "1"}}\n{broken\n{"business_id": "b", "attributes": null}\n')
    got = {r["business_id"]: r for r in readers.json_lines(spark, str(f), "business").collect()}
    assert set(got) == {"a", "b"} and got["a"]["attributes"] == {"k": "1"} and got["b"]["city"] is None
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_lines(spark, str(f), "business", strict=True).collect()


def test_csv_drops_header_lines_and_short_rows(spark, tmp_path):
    f = tmp_path / "yelp_train.csv"
    f.write_text('user_id,business_id,stars\nu,a,4.0\nuser_id,business_id,stars\nu\n"v ",b,bad\n')
    assert sorted(tuple(r) for r in readers.csv_rows(spark, str(f), "ratings").collect()) == [("u", "a", 4.0), ("v ", "b", None)]
    (tmp_path / "empty.csv").write_text("")
    assert readers.csv_rows(spark, str(tmp_path / "empty.csv"), "pairs").count() == 0


def test_transactions(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('"D","C","x","y","z","P"\n"11/1/2000","00012","","","","0007"\n"1/31/2001","x","","","","5"\n')
    assert [tuple(r) for r in readers.transactions(spark, str(f)).collect()] == [("11/1/00-12", "7")]


def test_points_and_streams(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1,-1,0.5,2\n2,x,1,1\n\n3,0,1.0,oops\n4,2,3\n")
    assert sorted((r["id"], r["label"], r["features"]) for r in readers.point_rows(spark, str(tmp_path / "p.txt")).collect()) == [(1, -1, [0.5, 2.0]), (4, 2, [3.0])]
    (tmp_path / "s.txt").write_text("a\nb\n\na\n")
    assert sorted(tuple(r) for r in readers.stream_lines(spark, str(tmp_path / "s.txt")).collect()) == [(1, "a"), (2, "b"), (3, "a")]


def test_folder_and_csv_round_trip(spark, tmp_path):
    (tmp_path / "tip.json").write_text('{"user_id": "u", "business_id": "b", "likes": 2}\n')
    got = readers.folder(spark, str(tmp_path))
    assert set(got) == {"tip"} and got["tip"].first()["likes"] == 2
    df = spark.createDataFrame([("a, b", 1.5)], "city string, stars double")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("a, b", "1.5")]
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["city"] == "a, b"
    sinks.write_lines(sinks.json_object(df), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == '{"city":"a, b","stars":1.5}'


def test_latest_delivery(spark):
    df = spark.createDataFrame([("a", 1, "x", {"k": "1"}), ("a", 2, "y", None), ("b", None, "z", None), ("b", None, "q", None), (None, 1, "n", None)], "id string, loaded_at int, v string, m map<string,string>")
    assert sorted((r["id"], r["v"]) for r in views.latest_delivery(df, "id").collect()) == [("a", "y"), ("b", "z")]
    assert views.latest_delivery(df.limit(0), "id").count() == 0


def test_with_views_joins_expressions():
    sql = views.with_views("with x as (select 1) select * from x", "points")
    assert sql.startswith("with points as materialized") and ", x as (select 1)" in sql

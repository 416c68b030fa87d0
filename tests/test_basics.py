from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.functions.ids import clean_id, clean_id_sql
from lodestream.functions.rounding import half_up, half_up_sql
from lodestream.operators.components import connected_components
from lodestream.operators.prefix import prefix_sums
from lodestream.operators.skew import broadcast_if_small, compress, distinct_per_key, hot_keys, weighted_summary, with_salt


def test_clean_id(spark, rows):
    raw = ["a", ' "a\t', "", "  ", "None", '"None "', None, "a b", "none"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(clean_id("x")).collect()]
    assert got == ["a", "a", None, None, None, None, None, "a b", "none"]
    sql = duckdb.connect().execute(f"select {clean_id_sql('x')} from (select unnest(?) as x)", [raw]).fetchall()
    assert [r[0] for r in sql] == got


def test_half_up_is_the_same_in_both_engines(spark):
    values = [1.005, 2.675, 0.125, -1.5, 3.0, 1e-9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(half_up(F.col("x"), 2)).collect()]
    sql = [r[0] for r in duckdb.connect().execute(f"select {half_up_sql('x', 2)} from (select unnest(?::double[]) as x)", [values]).fetchall()]
    assert got == sql
    assert got[:2] == [1.0, 2.68]


def test_compress_and_summary(spark):
    data = [("hot", 1.0)] * 50 + [("hot", 2.0)] * 51 + [("b", 3.0), ("b", 1.0), ("b", None), ("n", None)]
    w = compress(spark.createDataFrame(data, "k string, v double"), ["k"], "v")
    assert w.count() == 6
    got = {r["k"]: r.asDict() for r in weighted_summary(w, ["k"], percentiles=(0.25, 0.5)).collect()}
    assert got["hot"] | {"k": ""} == {"k": "", "rows": 101, "rows_with_value": 101, "distinct_values": 2, "value_sum": 152.0, "mode": 2.0, "p25": 1.0, "p50": 2.0}
    assert (got["b"]["rows"], got["b"]["rows_with_value"], got["b"]["mode"], got["b"]["p50"]) == (3, 2, 1.0, 1.0)  # a tie goes to the smaller
    assert (got["n"]["rows"], got["n"]["mode"], got["n"]["p50"]) == (1, None, None)
    assert weighted_summary(w.limit(0), ["k"]).count() == 0


def test_a_summary_refuses_large_domains(spark):
    w = compress(spark.range(30).selectExpr("'a' as k", "id as v"), ["k"], "v")
    assert weighted_summary(w, ["k"], most=30).first()["distinct_values"] == 30
    with pytest.raises(ValueError, match="different values"):
        weighted_summary(w, ["k"], most=29)


def test_distinct_per_key(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), (None, "z")], "k string, v string")
    assert rows(distinct_per_key(df, ["k"], "v", "n")) == [("a", 2), (None, 1)]


def test_salting_splits_only_hot_keys(spark):
    df = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", i) for i in range(5)] + [(None, 1)], "k string, i int")
    assert [(r["k"], r["_rows"]) for r in hot_keys(df, ["k"], 10).collect()] == [("hot", 100)]
    salted = with_salt(df, ["k"], F.col("i"), 10)
    assert salted.count() == 106
    got = {r["k"]: r["s"] for r in salted.groupBy("k").agg(F.sort_array(F.collect_set("_salt")).alias("s")).collect()}
    assert got == {"hot": list(range(10)), "cold": [0], None: [0]}


def test_broadcast_if_small(spark):
    df = spark.range(10)
    assert "broadcast" in broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_prefix_sums(spark, rows):
    data = [("a" if i % 3 else "b", (i * 7) % 50, i, i % 5) for i in range(200)] + [(None, 1, 999, None), ("z", 1, 1000, 4)]
    df = spark.createDataFrame(data, "g string, o int, id int, v int")
    got = {r["id"]: r["prefix"] for r in prefix_sums(df, ["g"], ["o", "id"], "v", parts=5).collect()}
    for g in ("a", "b", None, "z"):
        total = 0
        for _, _, i, v in sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2])):
            total += v or 0
            assert got[i] == total
    assert prefix_sums(df.limit(0), ["g"], ["o", "id"], "v").count() == 0


def _components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_components_agree_with_union_find(spark, edges):
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = _components(edges)
    least = {}
    for x, r in want.items():
        least[r] = min(least.get(r, x), x)
    assert got == {x: least[r] for x, r in want.items()}


def test_components_of_a_long_path_a_hub_and_odd_rows(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (1, 0), (1, 0)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_registry_refuses_a_name_twice():
    from lodestream.plans.registry import Registry

    r = Registry()
    r.query("select 1")(test_clean_id)
    with pytest.raises(ValueError):
        r.query()(test_clean_id)


def test_salted_join_is_a_join(spark, rows):
    from lodestream.operators.skew import salted_join

    big = spark.range(400).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 40)) as k", "id", "id * 2 as clash")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "k string, v int")
    for how in ("inner", "left"):
        for threshold in (1_000, 20):
            assert rows(salted_join(big, small, ["k"], F.col("id"), how, threshold).select("k", "id", "v")) == rows(big.join(small, "k", how).select("k", "id", "v"))
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], F.col("id"), "full")
    assert salted_join(big.limit(0), small, ["k"], F.col("id")).count() == 0


def test_a_hot_key_reaches_no_task_whole(spark):
    from lodestream.operators.pairs import basket_pairs

    rows = spark.range(3_000).selectExpr("if(id % 3 = 0, 'third', concat('s', id)) as s", "concat('i', id) as i")
    pairs = basket_pairs(rows, wide=100)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 1_000 * 999 // 2 and "_salt" in plan


def test_what_is_counted_for_a_broadcast_runs_once(spark):
    from lodestream.operators.skew import broadcast_if_small
    from lodestream.scratch import is_written, written

    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    df = spark.range(50).repartition(2).mapInPandas(seen, "id long")
    small = broadcast_if_small(df, 60)
    assert spark.range(100).join(small, "id").count() == 50 and ran.value == 50
    t = written(spark.range(5))
    assert is_written(t) and not is_written(spark.range(5)) and broadcast_if_small(t, 4) is t


def test_past_tables_are_deleted(spark):
    from lodestream import scratch

    t = scratch.written(spark.range(3))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._lodestream_path)
    exists = lambda: fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    assert exists()
    scratch.forget(t, None, spark.range(2))
    assert not exists()


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    from lodestream.scratch import shared_folder

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))


def test_text_modulo_is_the_number_of_the_bytes(spark):
    from lodestream.operators.sketches import PRIME, text_modulo

    texts = ["a", "", "abcd", "abcde", "Größe 12 €", "x" * 300, "~~~~~~~~"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_modulo("t")).collect()]
    assert got == [int.from_bytes(t.encode(), "big") % PRIME for t in texts]

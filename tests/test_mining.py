from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from lodestream.operators import itemsets as I
from lodestream.operators import minhash as M
from lodestream.operators import reports
from lodestream.operators.pairs import pair_counts
from lodestream.sources import sinks


def baskets(spark, sets):
    return spark.createDataFrame([(s, i) for s, items in enumerate(sets) for i in items], "s long, i string")


def found(df):
    return {tuple(r["items"]): r["support"] for r in df.collect()}


def brute(sets, support):
    out = {}
    items = sorted(set().union(*sets)) if sets else []
    for k in range(1, len(items) + 1):
        level = {c: n for c in itertools.combinations(items, k) if (n := sum(set(c) <= set(s) for s in sets)) >= support}
        if not level:
            break
        out |= level
    return out


def test_four_baskets(spark):
    sets = [{"1", "2", "3"}, {"1", "2"}, {"1", "3"}, {"2", "3"}]
    assert found(I.frequent_itemsets(baskets(spark, sets), 2)) == {("1",): 3, ("2",): 3, ("3",): 3, ("1", "2"): 2, ("1", "3"): 2, ("2", "3"): 2}


def test_a_frequent_four_set_is_found(spark):
    got = found(I.frequent_itemsets(baskets(spark, [set("abcd")] * 5), 5))
    assert got[("a", "b", "c", "d")] == 5 and len(got) == 15
    assert found(I.frequent_itemsets(baskets(spark, [set("abcd")] * 5), 5, 2)) == {k: v for k, v in got.items() if len(k) <= 2}


def test_against_brute_force_and_fp_growth(spark):
    rnd = random.Random(3)
    sets = [set(rnd.sample("abcdefg", rnd.randint(1, 6))) for _ in range(25)]
    want = brute(sets, 5)
    assert found(I.frequent_itemsets(baskets(spark, sets), 5)) == want
    assert found(I.fp_growth(baskets(spark, sets), 5)) == want


def test_empty_and_nulls(spark):
    rows = I.baskets(spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "b"), (2, "a"), (2, "b")], "s long, i string"), "s", "i")
    assert rows.count() == 3
    assert I.baskets(spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "s long, i string"), "s", "i", 1).count() == 2
    assert I.frequent_itemsets(rows.limit(0), 1).count() == 0
    assert I.fp_growth(rows.limit(0), 1).count() == 0


def test_bucket_counts_add_up(spark):
    sets = [set("abc"), set("ab"), set("d")]
    assert I.bucket_counts(baskets(spark, sets)).agg(F.sum("n")).first()[0] == 4


def test_pair_counts_with_wide_baskets(spark):
    rnd = random.Random(5)
    sets = [set(rnd.sample(range(30), rnd.choice([2, 3, 25]))) for _ in range(30)]
    rows = spark.createDataFrame([(s, i) for s, items in enumerate(sets) for i in items], "s long, i long")
    for least in (1, 3, 12):
        want = {(a, b): n for a, b in itertools.combinations(range(30), 2) if (n := sum(a in s and b in s for s in sets)) >= least}
        for wide in (1_000, 10):
            assert {(r["a"], r["b"]): r["common"] for r in pair_counts(rows, least, wide).collect()} == want


def test_one_wide_basket_holds_most(spark):
    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(s, i) for s in range(1, 4) for i in (1, 2)], "s long, i long")
    assert [(r["a"], r["b"], r["common"]) for r in pair_counts(rows, 2, 10).collect()] == [(1, 2, 4)]


def test_minhash_pairs(spark):
    rnd = random.Random(1)
    base = [set(rnd.sample(range(200), 30)) for _ in range(12)]
    sets = base + [set(list(s)[:-3]) | {500 + k} for k, s in enumerate(base[:6])]
    members = spark.createDataFrame([(f"s{k:02d}", x) for k, s in enumerate(sets) for x in s], "s string, x long")
    want = {(f"s{a:02d}", f"s{b:02d}") for a, b in itertools.combinations(range(18), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = {(r["a"], r["b"]): r["similarity"] for r in M.similar_pairs(members, 0.5).collect()}
    assert set(got) == want and len(want) >= 6
    a, b = next(iter(want))
    assert got[(a, b)] == len(sets[int(a[1:])] & sets[int(b[1:])]) / len(sets[int(a[1:])] | sets[int(b[1:])])


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "a", None, "c"]], "k string")
    assert sorted((r["k"], r["idx"]) for r in M.dense_index(df, "k").collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_top_n(spark):
    df = spark.createDataFrame([("k", i % 3, i) for i in range(9)], "k string, v int, id int")
    assert [r["id"] for r in M.top_n(df, ["k"], [F.desc("v"), "id"], 4).orderBy(F.desc("v"), "id").collect()] == [2, 5, 8, 1]


def test_reports(spark, rows):
    r = spark.createDataFrame([("u1", "b1", "2018-01-01", 4.0), ("u1", "b2", "2017-05-05", 3.0), ("u2", "b1", None, None), (None, "b3", "2018", 5.0)], "user_id string, business_id string, date string, stars double")
    assert rows(reports.review_statistics(r, 2018)) == [(4, 2, 2, 3)]
    assert [tuple(x) for x in reports.top_k(r, "user_id", 1).collect()] == [("u1", 2)]
    one = reports.review_report(r, 2018, 2).first()
    assert [tuple(x) for x in one["top2_business"]] == [("b1", 2), ("b2", 1)]
    b = spark.createDataFrame([("b1", "x"), ("b2", "y"), ("b3", None)], "business_id string, city string")
    assert [tuple(x) for x in reports.city_average_stars(r, b).collect()] == [("x", 4.0), ("y", 3.0)]
    p = {x["layout"]: x for x in reports.partition_report(r, "business_id", 3).collect()}
    assert p["customized"]["n_items"] == 4 and p["customized"]["n_partition"] == 3 and p["customized"]["n_keys"] == 3
    assert reports.rows_per_partition(r).agg(F.sum("n_items")).first()[0] == 4
    assert rows(reports.review_statistics(r.limit(0), 2018)) == [(0, 0, 0, 0)]


def test_report_lines(spark):
    sets = spark.createDataFrame([(["a"], 2), (["b"], 2), (["a", "b"], 2)], "items array<string>, support long")
    assert [r["value"] for r in sinks.itemset_lines(sets).collect()] == ["('a'),('b')", "('a', 'b')"]
    groups = spark.createDataFrame([(["c", "d"],), (["a"],), (["a", "b"],)], "members array<string>")
    assert [r["value"] for r in sinks.community_lines(groups).collect()] == ["'a'", "'a', 'b'", "'c', 'd'"]
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.1234567)], "a string, b string, betweenness double")
    assert [r["value"] for r in sinks.betweenness_lines(edges).collect()] == ["('a', 'c'), 2.12346", "('a', 'b'), 1.0"]
    assert sinks.json_object(edges.limit(1)).first()["value"] == '{"a":"a","b":"b","betweenness":1.0}'


def test_pairs_by_the_bucket_filter(spark):
    rnd = random.Random(5)
    sets = [set(map(str, rnd.sample(range(12), rnd.randint(1, 6)))) for _ in range(40)] + [{"x", "y", "3"}] * 4
    want = {k: v for k, v in brute(sets, 4).items() if len(k) == 2}
    for buckets in (1, 7, 1_000):
        assert found(I.pcy_pairs(baskets(spark, sets), 4, buckets)) == want
    assert found(I.pcy_pairs(baskets(spark, [set()]), 1)) == {}
    n = {r["bucket"]: r["n"] for r in I.bucket_counts(baskets(spark, [{"3", "5"}, {"-1", "0"}])).collect()}
    assert n == {6: 1, 999: 1}  # 3 xor 5, and -1 xor 0 wrapped around


def test_tried_sets_are_those_with_frequent_parts(spark):
    sets = [{"1", "2", "3"}, {"1", "2"}, {"1", "3"}, {"2", "3"}, {"1", "4"}]
    frequent = I.frequent_itemsets(baskets(spark, sets), 2)
    tried = sorted(tuple(r["items"]) for r in I.tried_sets(frequent).collect())
    assert tried == [("1",), ("1", "2"), ("1", "2", "3"), ("1", "3"), ("2",), ("2", "3"), ("3",)]
    lines = [tuple(r) for r in sinks.itemset_sections(I.tried_sets(frequent), frequent).collect()]
    assert lines[0] == (1, 0, "Candidates:") and lines[3] == (1, 3, "('1', '2', '3')") and lines[4] == (2, 0, "Frequent Itemsets:") and lines[-1][1] == 2


def test_a_user_with_a_third_of_the_rows(spark):
    """Pairs, buckets and similarities with one basket far wider than the others."""
    sets = [{f"i{k}" for k in range(300)}] + [{f"i{k % 290}", f"i{(k * 7) % 290}"} for k in range(300)]
    rows = baskets(spark, sets)
    want = {c: n for c, n in brute_pairs(sets).items() if n >= 2}
    assert {(r["a"], r["b"]): r["common"] for r in pair_counts(rows, 2, wide=50).collect()} == want
    assert I.bucket_counts(rows).agg(F.sum("n")).first()[0] == sum(len(s) * (len(s) - 1) // 2 for s in sets)


def brute_pairs(sets):
    out = {}
    for s in sets:
        for c in itertools.combinations(sorted(s), 2):
            out[c] = out.get(c, 0) + 1
    return out


def test_a_candidate_is_looked_for_in_its_rarest_subset(spark):
    level = spark.createDataFrame([(1, ["a", "b"], 100), (2, ["a", "c"], 3), (3, ["b", "c"], 5), (4, ["b", "d"], 9)], "id long, items array<string>, support long")
    assert [tuple(r) for r in I.candidates(level, 3).select("items", "parent", "last").collect()] == [(["a", "b", "c"], 2, "b")]


def test_pairs_of_a_frequent_item_are_looked_up_from_the_rare_one(spark):
    kept = spark.createDataFrame([(f"s{k}", 1) for k in range(50)] + [("s3", 2), ("s4", 2), ("x", 2)], "s string, i long")
    level = spark.createDataFrame([(7, [1, 2])], "id long, items array<long>")
    sizes = spark.createDataFrame([(1, 50), (2, 3)], "i long, n long")
    ends = I.pair_ends(level, sizes)
    assert [tuple(r) for r in ends.collect()] == [(7, 2, 1)]
    assert sorted(tuple(r) for r in I.pair_baskets(ends, kept).collect()) == [(7, "s3"), (7, "s4")]


def test_repeated_rows_and_many_items_in_the_bucket_filter(spark):
    """Baskets as masks and, with more items than bits, as listed pairs; a row that comes twice counts once."""
    rnd = random.Random(8)
    for kinds in (12, 90):
        sets = [set(rnd.sample([f"i{k}" for k in range(kinds)], 5)) for _ in range(60)] + [{"i1", "i2", "7"}] * 4
        rows = baskets(spark, sets)
        assert found(I.pcy_pairs(rows.unionByName(rows), 4)) == {c: n for c, n in brute_pairs(sets).items() if n >= 4}


def test_long_report_lines_are_put_together_from_sorted_texts(spark):
    """25,000 sets: a few texts reach the last task instead of one entry a set, in the order of the items."""
    sets = spark.range(25_000).select(F.array(F.concat(F.lit("i"), (F.col("id") * 7_919 % 25_000).cast("string"))).alias("items"), F.lit(1).alias("support"))
    want = ",".join(f"('{x}')" for x in sorted(f"i{k}" for k in range(25_000)))
    assert [tuple(r) for r in sinks.itemset_lines(sets).collect()] == [(1, want)]
    assert sinks.line_chunks(sets).count() < 100


def test_wide_baskets_are_compared_as_bits(spark, monkeypatch):
    """More wide baskets than one word holds: the same counts by bits as by looking the baskets up."""
    from lodestream.operators import pairs

    rnd = random.Random(9)
    sets = [set(rnd.sample(range(14), rnd.choice([2, 3]))) for _ in range(12)] + [set(rnd.sample(range(14), 8)) for _ in range(70)]
    rows = spark.createDataFrame([(s, i) for s, items in enumerate(sets) for i in items], "s long, i long")
    want = {c: n for c, n in brute_pairs(sets).items() if n >= 24}
    used, masked = [], pairs._masked
    monkeypatch.setattr(pairs, "_masked", lambda *a: used.append(a[3]) or masked(*a))
    assert {(r["a"], r["b"]): r["common"] for r in pair_counts(rows, 24, 5).collect()} == want and used == [70]

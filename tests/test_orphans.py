from __future__ import annotations

import datetime as dt
import random

import pytest

from lodestream.operators import orphans as O

DAY = dt.datetime(2020, 1, 1)


def at(n):
    return None if n is None else DAY + dt.timedelta(days=n)


CHILD = "id long, user_id string, business_id string, loaded_at timestamp_ntz, id_2 string"
PARENT = "user_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, extra int"
BUSINESS = "business_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def found(spark, children, users, businesses=(), hot=O.HOT_CHILDREN):
    c = spark.createDataFrame([(*x, "q") for x in children], CHILD)
    refs = O.children(c, "t", "id", {"user_id": "u", "business_id": "b"})
    spans = O.parents(spark.createDataFrame([(*x, 1) for x in users], PARENT), "u", "user_id").unionByName(O.parents(spark.createDataFrame(list(businesses), BUSINESS), "b", "business_id"))
    lost = O.with_kind(O.orphans(refs, spans, hot), spans)
    return {(r["row_id"], r["ref_field"]): r["kind"] for r in lost.collect()}


def test_kinds_and_edges(spark):
    users = [("a", at(0), None), ("d", at(0), at(5)), ("r", at(0), at(5)), ('"r ', at(8), None), ("late", at(9), None), ("never", at(3), at(3)), ("unknown", None, None)]
    children = [
        (1, "a", None, at(1)), (2, "a", None, at(0)), (3, "d", None, at(4)), (4, "d", None, at(5)), (5, "r", None, at(6)), (6, " r", None, at(8)), (7, "late", None, at(2)),
        (8, "nobody", None, at(2)), (9, "None", None, at(2)), (10, None, "", at(2)), (11, "a", None, None), (12, "never", None, at(4)), (13, "unknown", None, at(4)), (14, "a", "shop", at(4)),
    ]
    got = found(spark, children, users, [("shop", at(5), None)])
    assert got == {(4, "user_id"): "deleted", (5, "user_id"): "deleted", (7, "user_id"): "later", (8, "user_id"): "missing", (11, "user_id"): "later", (12, "user_id"): "missing", (13, "user_id"): "missing", (14, "business_id"): "later"}


def test_first_delivery_decides(spark):
    got = found(spark, [(1, "a", None, at(1)), (1, "x", None, at(2)), (2, "x", None, at(1)), (2, "a", None, at(2)), (3, "x", None, None), (3, "a", None, at(4)), (None, "x", None, at(1)), (4, "a", None, at(1)), (4, "a", None, at(1))], [("a", at(0), None)])
    assert got == {(2, "user_id"): "missing"}


@pytest.mark.parametrize("hot", [3, 1_000])
def test_against_brute_force_with_hot_keys(spark, hot):
    rnd = random.Random(7)
    users = []
    for k in "abcd":
        for _ in range(rnd.randint(1, 4)):
            born = rnd.randint(0, 20)
            users.append((k, at(born), at(born + rnd.randint(1, 8)) if rnd.random() < 0.6 else None))
    children = [(i, rnd.choice("aaaaaaabcde"), None, at(rnd.randint(0, 25))) for i in range(150)]
    want = {(i, "user_id") for i, u, _, t in children if not any(k == u and b <= t and (d is None or d > t) for k, b, d in users)}
    assert set(found(spark, children, users, hot=hot)) == want


def test_counts_and_empty_tables(spark, rows):
    c = spark.createDataFrame([(1, "x", None, at(1), ""), (2, "x", None, at(1), ""), (3, "x", None, None, "")], CHILD)
    refs = O.children(c, "t", "id", {"user_id": "u"})
    spans = O.parents(spark.createDataFrame([], PARENT), "u", "user_id")
    lost = O.with_kind(O.orphans(refs, spans), spans)
    assert rows(O.orphan_counts(lost)) == [("t", "user_id", "missing", "2020-01-01", 2, 1), ("t", "user_id", "missing", "unknown", 1, 1)]
    assert O.orphans(refs.limit(0), spans).count() == 0

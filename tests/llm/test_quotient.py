from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import quotient as Q


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 4_095), max_size=300), st.sets(st.integers(0, 4_095), max_size=300))
def test_filter_holds_exactly_its_fingerprints(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    f, g = Q.QuotientFilter(x, 12), Q.QuotientFilter(y, 12)
    assert f.fingerprints().tolist() == x.tolist()
    probe = np.arange(4_096, dtype=np.uint64)
    assert f.contains(probe).tolist() == [int(v) in a for v in probe]
    m = f.merge(g)
    assert m.fingerprints().tolist() == sorted(a | b)
    again = Q.QuotientFilter.from_bytes(m.to_bytes())
    assert again.fingerprints().tolist() == sorted(a | b) and again.contains(probe).tolist() == m.contains(probe).tolist()
    assert again.bits() == m.bits() and again.n == len(a | b)


def stream(spark, users):
    return spark.createDataFrame([(i, u, "w") for i, u in enumerate(users, 1)], "seq long, user_id string, fp string")


def truth(users):
    seen, out = set(), []
    for i, u in enumerate(users, 1):
        if u is not None:
            if u in seen:
                out.append(i)
            seen.add(u)
    return out


def users(n=2_000, distinct=600):
    rnd = random.Random(3)
    return [None if rnd.random() < 0.02 else "hot" if rnd.random() < 0.3 else f"u{rnd.randrange(distinct)}" for _ in range(n)]


def test_seen_before(spark, monkeypatch):
    us = users()
    for keys in (Q.GROUP_KEYS, 100):  # one group, and many
        monkeypatch.setattr(Q, "GROUP_KEYS", keys)
        seen, rows, p, n = Q.seen_before(stream(spark, us), "seq", "user_id", 1e-9)
        assert n == sum(u is not None for u in us) and p >= 40
        assert sorted(r["seq"] for r in seen.collect()) == truth(us)
        assert Q.wrong_answers(rows, seen).count() == 0


def test_wrong_answers_are_found_and_their_rate_is_as_derived(spark):
    us = users(4_000, 3_000)
    seen, rows, p, n = Q.seen_before(stream(spark, us), "seq", "user_id", 0.25)
    said, right = {r["seq"] for r in seen.collect()}, set(truth(us))
    wrong = {r["seq"] for r in Q.wrong_answers(rows, seen).collect()}
    assert said >= right and said - right == wrong and wrong
    keys = len({u for u in us if u})
    assert abs(len(wrong) / keys - keys / 2 ** (p + 1)) < 0.03


def test_filters_merge(spark):
    us = users()
    _, rows, p, n = Q.seen_before(stream(spark, us), "seq", "user_id", 1e-6)
    both = Q.merge_filters(Q.filters(rows.filter("seq <= 900"), p, n), Q.filters(rows.filter("seq > 900"), p, n)).collect()
    whole = Q.filters(rows, p, n).collect()
    assert [bytes(r["filter"]) for r in both] == [bytes(r["filter"]) for r in whole]
    assert sum(r["keys"] for r in whole) == len({u for u in us if u})


def test_empty(spark):
    seen, rows, _, n = Q.seen_before(stream(spark, ["a"]).limit(0), "seq", "user_id", 1e-3)
    assert n == 0 and seen.count() == 0 and Q.wrong_answers(rows, seen).count() == 0
    assert Q.seen_before(stream(spark, [None, None]), "seq", "user_id", 1e-3)[0].count() == 0


def test_many_blocks_give_the_same_answers(spark):
    us = users()
    rows = stream(spark, us).filter("user_id is not null").select("seq", Q.fingerprint("user_id", 50).alias("fp"))
    n, want = rows.count(), {u: k for k, u in reversed(list(enumerate(us, 1))) if u}
    for block_rows in (7, 100, 10_000):
        first = Q.first_occurrences(rows, 50, n, 1, len(us), block_rows)
        assert sorted(r["seq"] for r in first.collect()) == sorted(want.values())


def test_cascade_keeps_few_filters():
    rnd = np.random.default_rng(1)
    keys = rnd.permutation(np.arange(1, 20_001, dtype=np.uint64) * np.uint64(977))
    c = Q.Cascade(40)
    for lo in range(0, len(keys), 50):
        part = np.sort(keys[lo : lo + 50])
        assert not c.contains(part).any()
        c.add(part)
        assert c.contains(part).all() and len(c.parts) <= 16
    assert sum(f.n for f in c.parts) == 20_000


def test_an_error_that_cannot_be_met_is_raised():
    with pytest.raises(ValueError, match="bits"):
        Q.fingerprint_bits(10**12, 1e-9)

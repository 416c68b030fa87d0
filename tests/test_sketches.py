from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from lodestream.operators import sketches as S


def stream(spark, users, key="seq"):
    return spark.createDataFrame(list(enumerate(users, 1)), f"{key} long, user_id string")


def number(text):
    return int(text.encode().hex(), 16)


def bloom(users, bits):
    on, seen, out = set(), set(), []
    for u in users:
        mine = {((a * number(u) + b) % S.PRIME) % bits for a, b in zip(S.BLOOM_A, S.BLOOM_B, strict=True)}
        out.append((mine <= on, u in seen))
        on |= mine
        seen.add(u)
    return out


def test_text_modulo(spark):
    texts = ["a", "Zürich ☕", "4EPp8BQiGsBFU0RKPj_IvB", " "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.text_modulo("t")).collect()]
    assert got == [number(t) % S.PRIME for t in texts]


def test_bloom_equals_the_sequential_filter(spark):
    rnd = random.Random(4)
    users = [f"user{rnd.randint(0, 150)}" for _ in range(300)]
    for bits in (S.BLOOM_BITS, 997, 97):
        got = [(r["maybe_seen"], r["seen"]) for r in S.bloom_answers(stream(spark, users), bits).orderBy("seq").collect()]
        assert got == bloom(users, bits)
        assert all(maybe for maybe, seen in got if seen)
        wrong = [m and not s for m, s in bloom(users, bits)]
        rates = {r["batch"]: (r["n"], r["fpr"]) for r in S.bloom_false_positive_rate(stream(spark, users), 100, bits).collect()}
        assert rates == {k: (100, sum(wrong[100 * k : 100 * k + 100]) / 100) for k in range(3)}
    assert S.bloom_answers(stream(spark, []), 97).count() == 0


def test_trailing_zeros(spark):
    got = [r[0] for r in spark.createDataFrame([(12,), (0,), (7,), (16,)], "v long").select(S.trailing_zeros(F.col("v"))).collect()]
    assert got == [2, 0, 0, 4]


def test_flajolet_martin(spark):
    rnd = random.Random(4)
    users = [f"user{rnd.randint(0, 90)}" for _ in range(250)]
    zeros = lambda v: 0 if v == 0 else (v & -v).bit_length() - 1
    want = {}
    for k in range(3):
        some = set(users[100 * k : 100 * k + 100])
        r = [2 ** max(zeros((a * number(u) + b) % S.PRIME) for u in some) for a, b in zip(S.FM_A, S.FM_B, strict=True)]
        want[k] = (len(some), int(statistics.median(statistics.mean(r[g : g + 4]) for g in range(0, 16, 4))))
    got = {r["batch"]: (r["truth"], r["estimate"]) for r in S.fm_estimates(stream(spark, users), 100).collect()}
    assert got == want
    one = S.fm_ratio(S.fm_estimates(stream(spark, users), 100)).first()
    assert one["ratio"] == sum(e for _, e in want.values()) / sum(t for t, _ in want.values())


def test_reservoir(spark):
    users = [f"u{n}" for n in range(1, 2_001)]

    def coin(n, salt):
        h = (n * 2_654_435_761 + salt * 40_503) % 2**32
        return ((h * 69_069 + 1) % 2**32) / 2**32

    slots, want, taken = [None] * 100, {}, 0
    for n, u in enumerate(users, 1):
        if n <= 100:
            slots[n - 1] = u
        elif coin(n, 1) < 100 / n:
            slots[int(coin(n, 2) * 100)] = u
            taken += 1
        if n % 100 == 0:
            want[n] = tuple(slots[s] for s in (0, 20, 40, 60, 80))
    got = {r["n"]: tuple(r)[1:] for r in S.reservoir_snapshots(stream(spark, users, "n")).collect()}
    assert got == want and len(got) == 20
    assert 230 < taken < 370  # about 100 * ln 20
    assert S.reservoir_snapshots(stream(spark, users[:50], "n")).count() == 0


def test_ask_draws_with_replacement(spark):
    stream = spark.createDataFrame([(k, f"u{k}") for k in range(1, 11)], "n long, user_id string")
    got = {r["draw"]: r["user_id"] for r in S.ask(stream, 200).collect()}
    assert sorted(got) == list(range(1, 201)) and set(got.values()) == {f"u{k}" for k in range(1, 11)}
    assert got == {r["draw"]: r["user_id"] for r in S.ask(stream, 200).collect()}
    assert S.ask(stream.limit(0), 5).count() == 0


def test_registers_count_zeros_once_a_group(spark):
    rows = [(k,) for k in [*range(40), S.PRIME - 1]]
    aggregates, registers = S.fm_hashes("x")
    got = spark.createDataFrame(rows, "x long").agg(*aggregates).select(*registers).first()
    zeros = lambda v: (v & -v).bit_length() - 1 if v else 0
    assert list(got) == [max(zeros((a * x + b) % S.PRIME) for (x,) in rows) for a, b in zip(S.FM_A, S.FM_B, strict=True)]

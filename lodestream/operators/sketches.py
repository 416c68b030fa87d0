"""Single-pass stream sketches, as relational operators over a stream with order numbers.

A Bloom filter's bits only ever turn on, so bit i is set for an element exactly if some earlier element set it: the first
order number that sets a bit decides. That makes the sequential filter an aggregate and joins, with no state to carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Prime, bits and coefficients of the hash families.
PRIME = 16_769_023
BLOOM_BITS = 69_997
BLOOM_A, BLOOM_B = (12, 37, 51, 73, 91), (7, 31, 57, 85, 101)
FM_A = (13, 49, 17, 31, 53, 71, 101, 113, 127, 139, 199, 241, 251, 269, 281, 307)
FM_B = (7, 11, 23, 29, 47, 59, 83, 97, 109, 131, 151, 191, 223, 227, 239, 257)
FM_GROUP = 4


def text_modulo(text: str, modulus: int = PRIME) -> Column:
    """The UTF-8 bytes of the text as one big number, modulo ``modulus``, without big numbers."""
    # eight hex digits a step: the remainder so far, below 2^24, times 2^32 stays within a long
    digits = F.hex(F.encode(F.col(text), "UTF-8"))
    parts = F.filter(F.split(F.regexp_replace(digits, "(.{8})", "$1 "), " "), lambda c: c != "")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, c: (F.call_function("shiftleft", a, F.length(c) * 4) + F.conv(c, 16, 10).cast("bigint")) % F.lit(modulus))


def bloom_positions(text: str, bits: int = BLOOM_BITS) -> Column:
    """Array of the bits an element sets."""
    x = F.col(text)
    return F.array(*[((F.lit(a).cast("bigint") * x + F.lit(b)) % F.lit(PRIME)) % F.lit(bits) for a, b in zip(BLOOM_A, BLOOM_B, strict=True)])


def batches(stream: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Adds ``batch``: elements by order number, ``size`` numbers a batch, counted from 0."""
    return stream.withColumn("batch", F.expr(f"cast(({seq} - 1) div {size} as bigint)"))


def bloom_answers(stream: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """seq, user_id, maybe_seen, seen for every element: what the filter says, and the truth.

    Joins go by bit and by user; a user's elements are reduced to the first before the bits are, so a busy user costs
    one row there. The filter never denies an element that came before.
    """
    who = stream.groupBy("user_id").agg(F.min("seq").alias("first")).withColumn("x", text_modulo("user_id"))
    placed = who.withColumn("bit", F.explode(F.array_distinct(bloom_positions("x", bits))))
    set_at = placed.groupBy("bit").agg(F.min("first").alias("set_at"))
    # a user is maybe seen from the moment the last of its bits is on
    ready = placed.join(set_at, "bit").groupBy("user_id").agg(F.max("set_at").alias("ready"), F.first("first").alias("first"))
    return stream.join(ready, "user_id").select("seq", "user_id", (F.col("ready") < F.col("seq")).alias("maybe_seen"), (F.col("first") < F.col("seq")).alias("seen"))


def bloom_false_positive_rate(stream: DataFrame, size: int, bits: int = BLOOM_BITS) -> DataFrame:
    """batch, n, false_positives, fpr; the rate is of all elements of the batch."""
    return false_positive_rate(bloom_answers(stream, bits), size)


def false_positive_rate(answers: DataFrame, size: int) -> DataFrame:
    """The same of answers given before: seq, maybe_seen, seen."""
    wrong = F.col("maybe_seen") & ~F.col("seen")
    per = batches(answers, size).groupBy("batch").agg(F.count("*").alias("n"), F.count_if(wrong).alias("false_positives"))
    return per.withColumn("fpr", F.col("false_positives") / F.col("n"))


def trailing_zeros(col: Column) -> Column:
    """Zero bits at the end of the number; 0 for 0."""
    return F.when(col == 0, 0).otherwise(F.length(F.bin(col)) - F.length(F.rtrim(F.bin(col), F.lit("0"))))


def fm_hashes(x: str) -> tuple[list[Column], list[Column]]:
    """(aggregates, registers r0..r15 made of them): the most trailing zeros of each hash of the number ``x``.

    The lowest bit that is on grows with the zeros behind it, so a group's largest is kept, and its zeros are counted
    once a group instead of once a row. A hash of 0 has none, as a hash of 1.
    """
    aggregates, registers = [], []
    for k, (a, b) in enumerate(zip(FM_A, FM_B, strict=True)):
        h = (F.lit(a).cast("bigint") * F.col(x) + F.lit(b)) % F.lit(PRIME)
        aggregates.append(F.max(F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h.bitwiseAND(-h))).alias(f"_low{k}"))
        registers.append(trailing_zeros(F.col(f"_low{k}")).alias(f"r{k}"))
    return aggregates, registers


def fm_estimates(stream: DataFrame, size: int) -> DataFrame:
    """batch, truth, estimate: exact and Flajolet-Martin distinct users of each batch.

    Each of 16 hashes gives 2 to the most trailing zeros in the batch; the estimate is the median of the means of the
    groups of four, cut to a whole number.
    """
    hashes, registers = fm_hashes("_x")
    different = batches(stream, size).select("batch", "user_id").distinct().withColumn("_x", text_modulo("user_id"))
    per = different.groupBy("batch").agg(F.count("*").alias("truth"), *hashes).select("batch", "truth", *registers)
    means = [sum((F.pow(F.lit(2.0), F.col(f"r{k}")) for k in range(g, g + FM_GROUP)), F.lit(0.0)) / FM_GROUP for g in range(0, len(FM_A), FM_GROUP)]
    ordered = F.array_sort(F.array(*means))
    return per.select("batch", "truth", F.floor((ordered[1] + ordered[2]) / 2).alias("estimate"))


def fm_ratio(estimates: DataFrame) -> DataFrame:
    """One row: the sum of the estimates over the sum of the truths (null without rows)."""
    return estimates.agg(F.sum("estimate").alias("estimates"), F.sum("truth").alias("truths"), (F.sum("estimate") / F.sum("truth")).alias("ratio"))


def coin(seq: str, salt: int) -> Column:
    """A number in [0, 1) fixed by the order number: same on every engine and run."""
    h = (F.col(seq) * F.lit(2_654_435_761) + F.lit(salt) * F.lit(40_503)) % F.lit(4_294_967_296)
    return ((h * F.lit(69_069) + F.lit(1)) % F.lit(4_294_967_296)) / F.lit(4_294_967_296.0)


def ask(stream: DataFrame, num: int, salt: int = 3) -> DataFrame:
    """draw, user_id: ``num`` elements drawn with replacement. ``stream``: n (dense from 1), user_id.

    Draw k takes the element whose place a coin fixed by k and ``salt`` names, so it is the same on every run.
    """
    total = F.broadcast(stream.agg(F.max("n").alias("_all")))  # one row
    draws = stream.sparkSession.range(1, num + 1).withColumnRenamed("id", "draw").join(total)
    places = draws.select("draw", (F.floor(coin("draw", salt) * F.col("_all")) + 1).alias("n"))
    return places.join(stream.select("n", "user_id"), "n").select("draw", "user_id")


def reservoir_events(stream: DataFrame, k: int) -> DataFrame:
    """slot, n, user_id: which element enters which slot when. ``stream``: n (dense from 1), user_id.

    The first k elements fill the slots in order; element n is then taken with chance k / n into a slot chosen evenly.
    """
    n = F.col("n")
    taken = (n <= k) | (coin("n", 1) < F.lit(float(k)) / n)
    slot = F.when(n <= k, n - 1).otherwise(F.floor(coin("n", 2) * k))
    return stream.filter(taken).select(slot.cast("int").alias("slot"), "n", "user_id")


def reservoir_snapshots(stream: DataFrame, k: int = 100, every: int = 100, slots: Sequence[int] = (0, 20, 40, 60, 80)) -> DataFrame:
    """n, s<slot>...: the users in the slots after every ``every`` elements.

    Only about k * ln(n) elements are ever taken, and each slot's history is its own: per slot the last event up to a
    snapshot counts, carried forward over the snapshots in order.
    """
    events = reservoir_events(stream, k).filter(F.col("slot").isin(list(slots)))
    last = events.withColumn("at", F.ceil(F.col("n") / every) * every).groupBy("slot", "at").agg(F.max_by("user_id", "n").alias("user_id"))
    wide = last.groupBy("at").pivot("slot", list(slots)).agg(F.first("user_id"))
    marks = stream.filter(F.col("n") % every == 0).select(F.col("n").alias("at"))
    # history is cut into ranges of 2^16 snapshots, so no single task sorts all of them
    joined = marks.join(wide, "at", "left").withColumn("_range", F.shiftright("at", 22))
    near = W.partitionBy("_range").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    names = {s: F.col(f"`{s}`") for s in slots}
    filled = joined.select("at", "_range", *[F.last(c, ignorenulls=True).over(near).alias(f"s{s}") for s, c in names.items()])
    ends = filled.groupBy("_range").agg(*[F.max_by(f"s{s}", F.when(F.col(f"s{s}").isNotNull(), F.col("at"))).alias(f"s{s}") for s in slots])
    before = W.partitionBy().orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    carried = ends.select("_range", *[F.last(f"s{s}", ignorenulls=True).over(before).alias(f"_c{s}") for s in slots])
    return filled.join(F.broadcast(carried), "_range").select(F.col("at").alias("n"), *[F.coalesce(f"s{s}", f"_c{s}").alias(f"s{s}") for s in slots])

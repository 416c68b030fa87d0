"""All pairs of sets with Jaccard similarity at or above a threshold: sorted MinHash sketch forests.

Each set gets ``trees`` independent signatures of MinHash values. Every tree's signatures are range-sorted, so sets with
a common prefix lie side by side, and each run of equal prefixes is compared within. ``plan`` starts with the deepest
prefix whose recall at the threshold is the one asked for. A prefix shared by more than ``crowd`` sets (say, of one very
busy item) is deepened, value by value, until its runs are short; no run is ever longer, so the work is at most
``crowd`` neighbours a row. Deepening costs recall, which is accounted for: a set deepened in more trees than the recall
allows, or still crowded at the deepest prefix, is looked up exactly through its rarest items instead.

Meetings are counted over the trees, and pairs that meet too seldom for the threshold are dropped at a risk that is part
of the recall; the exact similarity of the rest decides. Sets with the same items are one class throughout, so a group
of copies costs one sketch; its pairs appear only in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.prefix import prefix_sums
from lodestream.operators.skew import broadcast_if_small
from lodestream.scratch import written

#: Multipliers and offsets of the hash family come from this seed.
SEED = 20_160_104
#: Sets that may share a prefix before it is deepened, and the most values of a deepened prefix.
CROWD, DEEPEST = 256, 8


def miss(similarity: float, trees: int, depth: int, meetings: int) -> float:
    """Chance that a pair of that similarity shares the prefix in fewer than ``meetings`` trees."""
    p = similarity**depth
    return sum(comb(trees, k) * p**k * (1 - p) ** (trees - k) for k in range(meetings))


def plan(similarity: float, recall: float, trees: int) -> tuple[int, int]:
    """(depth, meetings): the deepest prefix, then the most meetings, that keep the recall at ``similarity``."""
    depth = 1
    while miss(similarity, trees, depth + 1, 1) <= 1 - recall:
        depth += 1
    meetings = 1
    while miss(similarity, trees, depth, meetings + 1) <= 1 - recall:
        meetings += 1
    return depth, meetings


def hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minhash(items: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """``k`` 31-bit MinHash values of each run of ``items`` (64-bit hashes) beginning at ``starts``."""
    mult, add = hash_family(k)
    out = np.empty((len(starts), k), np.int32)
    x = items.astype(np.uint64)
    for j in range(k):
        h = x * mult[j] + add[j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out[:, j] = np.minimum.reduceat(h >> np.uint64(33), starts)
    return out


SKETCH = "s long, n long, x long, y long, sig array<int>, whole boolean"


def _sketcher(k: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sketches of runs of equal ``s``. The first and last run of the task may go on elsewhere: not ``whole``."""
        rest, begun = None, False

        def sketch(df: pd.DataFrame, first: bool, last: bool) -> pd.DataFrame:
            s, i = df["s"].to_numpy(), df["i"].to_numpy()
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            n = np.diff(np.r_[starts, len(s)])
            whole = np.ones(len(starts), bool)
            whole[0] &= not first
            whole[-1] &= not last
            whole &= ~df["split"].to_numpy()[starts]
            mixed = (i.astype(np.uint64) ^ (i.astype(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out = pd.DataFrame({"s": s[starts], "n": n, "x": np.bitwise_xor.reduceat(mixed, starts).astype(np.int64), "y": np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), starts).astype(np.int64), "whole": whole})
            keep = (n >= least) | ~whole
            sig = minhash(i, starts, k)[keep]
            out = out[keep].reset_index(drop=True)
            out["sig"] = list(sig)
            return out[["s", "n", "x", "y", "sig", "whole"]]

        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = pdf["s"].iloc[-1]
            tail = (pdf["s"] == last).to_numpy()
            done, rest = pdf[~tail], pdf[tail]
            if len(done):
                yield sketch(done, not begun, False)
                begun = True
            if len(rest) > 500_000:  # a large set: sketch what is here, go on with the same set
                yield sketch(rest, True, True)
                rest, begun = None, False
        if rest is not None and len(rest):
            yield sketch(rest, True, True)

    return run


def sketches(members: DataFrame, k: int, least: int) -> DataFrame:
    """One row per set of at least ``least`` items: s, n, x, y (together the identity of the set), sig.

    ``members`` are distinct (s, i), sorted by s in each file, with ``split``. Parts of a set met in different tasks or batches are united afterwards; these are
    a few per task, so the bulk of the sets crosses no shuffle.
    """
    parts = written(members.mapInPandas(_sketcher(k, least), SKETCH))
    spread = parts.filter("not whole").drop("whole")
    summed = spread.groupBy("s").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.expr("cast(sum(cast(y as decimal(38,0))) % 18446744073709551616 as decimal(38,0))").alias("_y"))
    y = F.expr("cast(case when _y >= 9223372036854775808 then _y - 18446744073709551616 when _y < -9223372036854775808 then _y + 18446744073709551616 else _y end as long)")
    least_sig = spread.select("s", F.posexplode("sig").alias("j", "v")).groupBy("s", "j").agg(F.min("v").alias("v")).groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("sig"))
    united = summed.withColumn("y", y).join(least_sig, "s").filter(F.col("n") >= least).select("s", "n", "x", "y", "sig")
    return parts.filter("whole").select("s", "n", "x", "y", "sig").unionByName(united)


def spare_trees(similarity: float, trees: int, depth: int, meetings: int, recall: float) -> int:
    """In how many trees a set may be deepened while the others alone keep the recall at ``similarity``."""
    spare = 0
    while spare + 1 < trees and miss(similarity, trees - spare - 1, depth, meetings) <= 1 - recall:
        spare += 1
    return spare


def _prefix(depth: int, values: int) -> list:
    """(k1, k2) of the first ``depth`` values of tree t: the first two side by side, which sorts as they do, then the
    hash of the rest. A tree's values beyond its own are those of the trees after it."""
    at = lambda j: F.element_at("sig", (F.col("t") * F.col("_own") + j) % values + 1).cast("long")
    rest = F.xxhash64(*[at(j) for j in range(2, depth)]) if depth > 2 else F.lit(0).cast("long")
    return [(F.shiftleft(at(0), 31) + (at(1) if depth > 1 else F.lit(0))).alias("k1"), rest.alias("k2")]


def leaves(sets: DataFrame, trees: int, depth: int, similarity: float, crowd: int = CROWD, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame | None]:
    """(leaves s, n, t, k1, k2, weight; sets deepened s, trees, stuck, or None where no prefix is crowded).

    A leaf is the shortest prefix, from ``depth`` values on, that at most ``crowd`` sets share; it weighs as much more
    than one of ``depth`` as it is less likely at the threshold. Sets still crowded at ``deepest`` have no leaf there.
    """
    kept = ["s", "n", "t", "sig", "_own"]
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")
    rows = sets.select("s", F.col("n").cast("int").alias("n"), "sig", F.lit(depth).alias("_own"), tree)
    found, deepened = None, None
    for d in range(depth, max(depth, deepest) + 1):
        keyed = rows.select(*kept, *_prefix(d, trees * depth))
        busy = written(keyed.groupBy("t", "k1", "k2").agg(F.count("*").alias("_c")).filter(F.col("_c") > crowd).select("t", "k1", "k2"))
        ended = keyed if busy.isEmpty() else keyed.join(broadcast_if_small(busy), ["t", "k1", "k2"], "left_anti")
        ended = ended.select("s", "n", "t", "k1", "k2", F.lit(round(similarity ** (depth - d))).alias("weight"))
        found = ended if found is None else found.unionByName(ended)
        if busy.isEmpty():
            rows = None
            break
        rows = written(keyed.join(broadcast_if_small(busy), ["t", "k1", "k2"], "left_semi").select(*kept))
        deepened = rows.select("s", "t") if deepened is None else deepened
    if deepened is None:
        return found, None
    per = deepened.groupBy("s").agg(F.count("*").alias("trees")).withColumn("stuck", F.lit(False))
    if rows is not None:
        stuck = rows.select("s").distinct().withColumn("_stuck", F.lit(True))
        per = per.join(stuck, "s", "left").select("s", "trees", F.coalesce("_stuck", F.lit(False)).alias("stuck"))
    return found, per


def _compared(similarity: float):
    def pairs(t: pd.DataFrame) -> pd.DataFrame:
        """All pairs within the runs of equal prefixes whose sizes allow the similarity."""
        key = t[["t", "k1", "k2"]].to_numpy(np.int64)
        run = np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        s, n, w = t["s"].to_numpy(), t["n"].to_numpy(), t["weight"].to_numpy()
        left, lag, out = np.arange(len(t)), 1, []
        while len(left):
            left = left[left + lag < len(t)]
            left = left[run[left] == run[left + lag]]
            i, j = left, left + lag
            close = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
            out.append((i[close], j[close]))
            lag += 1
        i, j = (np.concatenate([p[k] for p in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        first = s[i] < s[j]
        a, b = np.where(first, i, j), np.where(first, j, i)
        return pd.DataFrame({"a": s[a], "b": s[b], "na": n[a], "nb": n[b], "weight": w[i]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = pdf.iloc[-1]
            same = ((pdf["k1"] == last["k1"]) & (pdf["k2"] == last["k2"]) & (pdf["t"] == last["t"])).to_numpy()
            rest = pdf[same]  # the last run may go on in the next batch; it has at most ``crowd`` rows
            yield pairs(pdf[~same])
        if rest is not None:
            yield pairs(rest)

    return run


def neighbours(found: DataFrame, similarity: float) -> DataFrame:
    """a, b, na, nb, weight for every two leaves side by side: the range-sorted forest, compared run by run."""
    ordered = found.repartitionByRange("t", "k1", "k2").sortWithinPartitions("t", "k1", "k2")
    return ordered.mapInPandas(_compared(similarity), "a long, b long, na int, nb int, weight int")


def looked_up(hard: DataFrame, sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """a, b, na, nb: every set that can be similar to one of ``hard`` (s), exactly, through the rarest items of it.

    Of n items of a set, some of the n - ceil(similarity * n) + 1 rarest must be in any set that is similar enough.
    """
    sized = sets.select("s", F.col("n").cast("int").alias("n"))
    mine = members.select("s", "i").join(hard.select("s"), "s", "left_semi").join(sized, "s")
    often = members.groupBy("i").agg(F.count("*").alias("_f")).join(mine.select("i").distinct(), "i", "left_semi")
    ranked = prefix_sums(mine.join(often, "i").withColumn("_one", F.lit(1).cast("long")), ["s"], ["_f", "i"], "_one", "_rank")
    rare = ranked.filter(F.col("_rank") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n")) + 1).select(F.col("s").alias("x"), F.col("n").alias("nx"), "i")
    other = members.select("i", F.col("s").alias("y")).join(sized.select(F.col("s").alias("y"), F.col("n").alias("ny")), "y")
    met = rare.join(other, "i").filter(F.col("x") != F.col("y")).filter(F.least("nx", "ny") >= F.lit(similarity) * F.greatest("nx", "ny"))
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()


def candidates(sets: DataFrame, members: DataFrame, trees: int, depth: int, meetings: int, similarity: float, recall: float, crowd: int = CROWD, deepest: int = DEEPEST) -> DataFrame:
    """Pairs (a < b) of sets that meet often enough in the forest and whose sizes allow the similarity: a, b, na, nb."""
    found, deepened = leaves(sets, trees, depth, similarity, crowd, deepest)
    met = neighbours(found, similarity).groupBy("a", "b").agg(F.sum("weight").alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    out = met.filter(F.col("met") >= meetings).drop("met")
    if deepened is None:
        return out
    hard = written(deepened.filter(F.col("stuck") | (F.col("trees") > spare_trees(similarity, trees, depth, meetings, recall))).select("s"))
    return out if hard.isEmpty() else out.unionByName(looked_up(hard, sets, members, similarity)).distinct()


def verify(found: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Exact overlap of candidate pairs (a, b, na, nb): adds common and jaccard, keeps those at the threshold.

    The items of the smaller set are looked up in the larger, so a pair costs the smaller set's size.
    """
    small_first = F.col("na") <= F.col("nb")
    ordered = found.select(F.when(small_first, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(small_first, F.col("b")).otherwise(F.col("a")).alias("q"), F.least("na", "nb").alias("np"), F.greatest("na", "nb").alias("nq"))
    used = ordered.select(F.explode(F.array("p", "q")).alias("s")).distinct()
    mine = members.join(used, "s", "left_semi")
    items = ordered.join(mine.select(F.col("s").alias("p"), "i"), "p")
    common = items.join(mine.select(F.col("s").alias("q"), "i"), ["q", "i"]).groupBy("p", "q", "np", "nq").agg(F.count("*").alias("common"))
    union = F.col("np") + F.col("nq") - F.col("common")
    return common.withColumn("jaccard", F.col("common") / union).filter(F.col("common") >= F.lit(similarity) * union).select(F.col("p").alias("a"), F.col("q").alias("b"), F.col("np").alias("na"), F.col("nq").alias("nb"), "common", "jaccard")


def similar_pairs(members: DataFrame, similarity: float, least: int = 1, trees: int = 60, recall: float = 0.999_9, crowd: int = CROWD, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(links, copies): verified pairs of classes, and membership class -> set for all sets of ``least`` items.

    The plan is made for a miss ten times smaller than ``1 - recall``, so that some trees may be deepened.

    ``links``: a, b, na, nb, common, jaccard between representatives of classes of equal sets (smallest hash);
    ``copies``: c (representative), s, n. Empty sets have no row in ``members`` and no pair.
    """
    depth, meetings = plan(similarity, 1 - (1 - recall) / 10, trees)
    sets = sketches(members, trees * depth, least)
    sets = written(sets)
    lead = sets.groupBy("n", "x", "y").agg(F.min("s").alias("c"), F.count("*").alias("copies"))
    several = lead.filter("copies > 1")
    copies = sets.select("s", "n", "x", "y").join(several.drop("copies"), ["n", "x", "y"], "left").select(F.coalesce("c", "s").alias("c"), "s", "n")
    copies = written(copies)
    heads = sets.join(copies.filter("c != s").select("s"), "s", "left_anti")
    pairs = written(candidates(heads, members, trees, depth, meetings, similarity, recall, crowd, deepest))
    return verify(pairs, members, similarity), copies


def expand(links: DataFrame, copies: DataFrame) -> DataFrame:
    """All pairs of sets: links between classes spread over their copies, and the pairs of copies themselves."""
    c = copies.select("c", "s")
    across = links.select("a", "b").join(c.select(F.col("c").alias("a"), F.col("s").alias("s1")), "a").join(c.select(F.col("c").alias("b"), F.col("s").alias("s2")), "b").select("s1", "s2")
    many = copies.groupBy("c").agg(F.count("*").alias("k")).filter("k > 1").select("c")
    twins = c.join(many, "c", "left_semi")
    same = twins.select("c", F.col("s").alias("s1")).join(twins.select("c", F.col("s").alias("s2")), "c").filter("s1 < s2").select("s1", "s2")
    return across.unionByName(same)


def recall_bound(similarity: float, trees: int, recall: float) -> float:
    """The recall the plan reaches at the threshold, and more above it."""
    return 1 - miss(similarity, trees, *plan(similarity, recall, trees))

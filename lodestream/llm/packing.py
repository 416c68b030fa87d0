"""Filling containers of fixed capacity with texts: harmonic packing.

A piece of length s with ``capacity / (k + 1) < s <= capacity / k`` has class k, and a container of class k takes k
such pieces, whatever their exact lengths. No worker needs to know another's containers, so each group of pieces
(chosen by a hash of the document) is packed on its own.

Three refinements keep little space unused. Containers of classes 1 to ``ROOMY`` hold few large pieces and leave the most
room; before a class forms containers of its own, its pieces are placed into that room, longest piece first, each where
it fits tightest. And pieces of classes above ``CLASSES`` are laid end to end: a container takes those
that begin within ``capacity - capacity / (CLASSES + 1)``, which wastes less than ``1 / (CLASSES + 1)``. The fewer than k
pieces of each class k that fill no container share containers by tightest fit.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.skew import broadcast_if_small

#: Pieces per independently packed group.
GROUP_PIECES = 20_000
#: Classes with containers of a fixed number of pieces; classes whose containers are topped up.
CLASSES, ROOMY = 32, 5


def _kinds(packs: DataFrame) -> DataFrame:
    return broadcast_if_small(packs.filter(F.col("capacity_tokens") > 0).select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct())


def pieces(texts: DataFrame, packs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """pack_name, capacity, doc_id, piece, start, length. ``texts``: doc_id, tokens; ``packs``: pack_name, capacity_tokens.

    A text within the capacity is one piece. A longer one is cut into full pieces of the capacity and a rest. Texts of
    no tokens (null, empty) have no piece; packs without a positive capacity take none. ``packs`` is a list of container
    kinds (a handful), so joining it to every text is a projection.
    """
    kinds = _kinds(packs)
    last = F.ceil(F.col(tokens) / F.col("capacity")) - 1
    each = texts.filter(F.col(tokens) > 0).select("doc_id", tokens).join(kinds)
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("piece") * F.col("capacity")
    return cut.select("pack_name", "capacity", "doc_id", "piece", start.alias("start"), F.least("capacity", F.col(tokens) - start).alias("length"))


def pack_group(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, position) of each piece; ``length`` sorted from long to short. Containers count from 0."""
    n = len(length)
    box, pos = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    kind = capacity // length
    boxes = 0
    room: list[tuple[int, int, int]] = []  # (room left, container, pieces in it), ascending
    def place(items: list[int], opening: bool) -> None:
        """Each item, longest first, where it fits tightest; ``opening`` new containers if it fits nowhere."""
        nonlocal boxes
        for i in items:
            need = int(length[i])
            at = bisect.bisect_left(room, (need, -1, -1))
            if at < len(room):
                left, b, held = room.pop(at)
            elif opening:
                left, b, held = capacity, boxes, 0
                boxes += 1
            else:
                continue
            box[i], pos[i] = b, held
            if left > need:
                bisect.insort(room, (left - need, b, held + 1))

    for k in range(1, ROOMY + 1):
        place(np.flatnonzero(kind == k).tolist(), opening=False)
        own = np.flatnonzero((kind == k) & (box < 0))
        at = np.arange(len(own))
        box[own], pos[own] = boxes + at // k, at % k
        used, held = np.bincount(at // k, weights=length[own]).astype(np.int64), np.bincount(at // k)
        room += [(capacity - int(u), boxes + j, int(h)) for j, (u, h) in enumerate(zip(used, held, strict=True)) if u < capacity]
        boxes += len(used)
        room.sort()
    place(np.flatnonzero(kind > ROOMY).tolist(), opening=False)
    rest: list[int] = []
    for k in range(ROOMY + 1, CLASSES + 1):
        own = np.flatnonzero((kind == k) & (box < 0))
        full = len(own) // k * k
        rest += own[full:].tolist()
        own, at = own[:full], np.arange(full)
        box[own], pos[own] = boxes + at // k, at % k
        boxes += full // k
    place(rest, opening=True)  # fewer than k pieces of each class k
    own = np.flatnonzero(box < 0)
    if len(own):
        begin = np.cumsum(length[own]) - length[own]
        slot = begin // (capacity - capacity // (CLASSES + 1))
        _, number, size = np.unique(slot, return_inverse=True, return_counts=True)
        box[own] = boxes + number
        pos[own] = np.arange(len(own)) - np.r_[0, np.cumsum(size)[:-1]][number]
    return box, pos


PACKED = "pack_name string, container_id long, position int, doc_id long, piece int, start long, length long"


def group_counts(texts: DataFrame, packs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """pack_name, groups: for each container kind, its pieces over ``GROUP_PIECES``. ``texts`` is read once more."""
    per = pieces_per_pack(texts, packs, tokens)
    return per.select("pack_name", F.greatest(F.ceil(F.col("pieces") / GROUP_PIECES), F.lit(1)).cast("int").alias("groups"))


def pieces_per_pack(texts: DataFrame, packs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """pack_name, pieces: how many pieces the texts give, without cutting them."""
    kinds = _kinds(packs)
    return texts.filter(F.col(tokens) > 0).join(kinds).groupBy("pack_name").agg(F.sum(F.ceil(F.col(tokens) / F.col("capacity"))).alias("pieces"))


def pack(cut: DataFrame, groups: int | DataFrame) -> DataFrame:
    """Container and position of every piece.

    ``groups``: into how many groups a pack's pieces are dealt, one number or a table by pack_name (``group_counts``);
    it should be about the number of pieces / ``GROUP_PIECES``, so that a group fits one task. A container id is unique
    within its pack: group number * 2^32 + number within the group. Pieces of equal length are ordered by (doc_id,
    piece), so the result depends on the data and ``groups`` alone.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        box, pos = pack_group(pdf["length"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({"pack_name": pdf["pack_name"], "container_id": (pdf["g"].to_numpy().astype(np.int64) << 32) + box, "position": pos.astype(np.int32), "doc_id": pdf["doc_id"], "piece": pdf["piece"].astype(np.int32), "start": pdf["start"], "length": pdf["length"]})

    if isinstance(groups, DataFrame):
        cut, ways = cut.join(broadcast_if_small(groups), "pack_name"), F.col("groups")
    else:
        ways = F.lit(max(1, groups))
    return cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), ways).cast("int")).groupBy("pack_name", "capacity", "g").applyInPandas(run, PACKED)


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: pieces, tokens, containers, the share of space used, and the fewest containers any packing needs."""
    kinds = broadcast_if_small(packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct())
    boxes = packed.groupBy("pack_name", "container_id").agg(F.sum("length").alias("used"), F.count("*").alias("held"))
    total = boxes.groupBy("pack_name").agg(F.sum("held").alias("pieces"), F.sum("used").alias("tokens"), F.count("*").alias("containers"), F.max("used").alias("fullest")).join(kinds, "pack_name")
    return total.select("pack_name", "capacity", "pieces", "tokens", "containers", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))

"""Quotient filters: which keys came before, in a few bits per key.

A key's ``p``-bit fingerprint splits into a quotient (its home slot) and a remainder (what is stored). Equal
quotients form runs of sorted remainders; three bits per slot (occupied, continuation, shifted) let a run move right
without losing its home. The filter therefore holds the sorted fingerprints losslessly, and two filters merge like
sorted lists. A new key is taken for an old one only if its fingerprint equals an old one: with ``n`` keys that
happens with a chance of at most ``n / 2^p``.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys per group of the grouped pass, each group with a filter of its own.
GROUP_KEYS = 400_000
#: Rows of one block of the stream, by order of arrival; their number grows with the stream, their size does not.
BLOCK_ROWS = 250_000
#: Most bits of a fingerprint; its hash has 64, two of which stay free for signs and shifts.
MOST_BITS = 62


class QuotientFilter:
    """A filter over sorted, different ``uint64`` fingerprints below ``2^p``."""

    def __init__(self, fingerprints: np.ndarray, p: int, load: float = 0.75) -> None:
        n = len(fingerprints)
        self.p, self.n = p, n
        self.q = min(p, max(1, math.ceil(math.log2(max(n, 1) / load))))
        self.r = p - self.q
        home = (fingerprints >> np.uint64(self.r)).astype(np.int64)
        slot = np.arange(n) + (np.maximum.accumulate(home - np.arange(n)) if n else 0)
        self.slots = max(1 << self.q, int(slot[-1]) + 1 if n else 0)
        self.remainders = np.zeros(self.slots, np.min_scalar_type((1 << self.r) - 1))
        self.occupied, self.continued, self.shifted = (np.zeros(self.slots, bool) for _ in range(3))
        if n:
            self.remainders[slot] = (fingerprints & np.uint64((1 << self.r) - 1)).astype(self.remainders.dtype)
            self.occupied[home] = True
            self.continued[slot[1:]] = home[1:] == home[:-1]
            self.shifted[slot] = slot != home

    @property
    def used(self) -> np.ndarray:
        """Slots that hold a remainder: an occupied home is always filled, if by another run's entry."""
        return self.occupied | self.continued | self.shifted

    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Home of each run, and of each stored remainder the number of its run."""
        return np.flatnonzero(self.occupied), np.cumsum(~self.continued[self.used]) - 1

    def fingerprints(self) -> np.ndarray:
        """All fingerprints, sorted."""
        homes, run = self._runs()
        return (homes[run].astype(np.uint64) << np.uint64(self.r)) | self.remainders[self.used].astype(np.uint64)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        """For each fingerprint whether it is stored: its home must be occupied, its remainder in the home's run."""
        if not self.n:
            return np.zeros(len(fingerprints), bool)
        homes, run = self._runs()
        stored = (run.astype(np.uint64) << np.uint64(self.r)) | self.remainders[self.used].astype(np.uint64)
        home = (fingerprints >> np.uint64(self.r)).astype(np.int64)
        here = self.occupied[home]
        number = np.searchsorted(homes, home).astype(np.uint64)
        want = (number << np.uint64(self.r)) | (fingerprints & np.uint64((1 << self.r) - 1))
        at = np.minimum(np.searchsorted(stored, want), self.n - 1)
        return here & (stored[at] == want)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """A filter of the fingerprints of both, sized anew."""
        return QuotientFilter(np.union1d(self.fingerprints(), other.fingerprints()), self.p)

    def bits(self) -> int:
        """Size: remainder and three bits for each slot."""
        return self.slots * (self.r + 3)

    def to_bytes(self) -> bytes:
        meta = np.packbits(np.concatenate([self.occupied, self.continued, self.shifted]))
        planes = np.packbits(((self.remainders[:, None].astype(np.uint64) >> np.arange(self.r, dtype=np.uint64)) & np.uint64(1)).astype(bool).ravel())
        return struct.pack("<qqqq", self.p, self.q, self.n, self.slots) + meta.tobytes() + planes.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        f = cls.__new__(cls)
        f.p, f.q, f.n, f.slots = struct.unpack_from("<qqqq", data)
        f.r = f.p - f.q
        flags = (3 * f.slots + 7) // 8
        meta = np.unpackbits(np.frombuffer(data, np.uint8, flags, 32), count=3 * f.slots).astype(bool)
        f.occupied, f.continued, f.shifted = meta.reshape(3, -1)
        planes = np.unpackbits(np.frombuffer(data, np.uint8, offset=32 + flags), count=f.slots * f.r).reshape(f.slots, f.r).astype(np.uint64)
        f.remainders = (planes << np.arange(f.r, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.min_scalar_type((1 << f.r) - 1))
        return f


def fingerprint_bits(n: int, error: float) -> int:
    """Bits for which ``n`` keys give a chance of at most ``error`` that a new key looks old.

    Where ``MOST_BITS`` do not suffice, the error could not be met: that is raised.
    """
    p = max(16, math.ceil(math.log2(max(n, 2) / error)))
    if p > MOST_BITS:
        raise ValueError(f"{n} keys need fingerprints of {p} bits for an error of {error}; {MOST_BITS} is the most")
    return p


def fingerprint(key: str | Column, p: int) -> Column:
    """The low ``p`` bits of the key's hash; ``check_hash`` gives independent bits."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << p) - 1))


def check_hash(key: str) -> Column:
    return F.xxhash64(F.lit("check"), F.col(key))


def group_bits(n: int) -> int:
    """Leading quotient bits that tell groups of about ``GROUP_KEYS`` keys apart."""
    return max(0, math.ceil(math.log2(max(1, math.ceil(n / GROUP_KEYS)))))


def _grouped(df: DataFrame, p: int, bits: int) -> DataFrame:
    return df.withColumn("g", (F.shiftright("fp", p - bits) if bits else F.lit(0)).cast("long"))


class Cascade:
    """Filters of successive blocks, merged like sorted runs: a new one is merged with the last while that is not much
    larger, so n keys are merged O(log n) times each and a lookup asks O(log n) filters."""

    def __init__(self, p: int) -> None:
        self.p, self.parts = p, []

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(fingerprints), bool)
        for f in self.parts:
            found |= f.contains(fingerprints)
        return found

    def add(self, fingerprints: np.ndarray) -> None:
        """``fingerprints``: sorted, different, none of them stored yet."""
        if len(fingerprints):
            self.parts.append(QuotientFilter(fingerprints, self.p))
        while len(self.parts) > 1 and self.parts[-2].n <= 2 * self.parts[-1].n:
            last = self.parts.pop()
            self.parts[-1] = self.parts[-1].merge(last)


def _first_per_group(p: int, bits: int):
    """The pass over one group, whose filters hold the fingerprints without the group's leading bits."""
    inner = p - bits
    mask = np.uint64((1 << inner) - 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group's (block, fingerprint) entries in order of blocks; keeps those the filters have not seen."""
        known, out = Cascade(inner), []
        pdf = pdf.sort_values(["block", "fp"], kind="stable")
        fps, block = pdf["fp"].to_numpy().astype(np.uint64) & mask, pdf["block"].to_numpy()
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            new = ~known.contains(fps[lo:hi])
            out.append(lo + np.flatnonzero(new))
            known.add(fps[lo:hi][new])
        return pdf.iloc[np.concatenate(out)][["fp", "seq"]] if out else pdf[["fp", "seq"]]

    return run


def first_occurrences(rows: DataFrame, p: int, n: int, low: int, high: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fp and seq of the rows the filters take for new. ``rows``: fp, seq (unique, between ``low`` and ``high``).

    The stream is cut into blocks of about ``block_rows`` rows by seq. Of one block and fingerprint only the earliest
    row can be new, so blocks are reduced to one entry per fingerprint on the map side; whether a fingerprint came in an
    earlier block is the filters' answer. A key holding a third of all rows reaches them as one entry per block. Groups
    are ranges of quotients: all entries of a fingerprint meet in one group, and the number of groups follows ``n``.
    """
    blocks = max(1, math.ceil(n / block_rows))
    width = max(1, math.ceil((high - low + 1) / blocks))
    entries = rows.groupBy(F.expr(f"cast((seq - {low}) div {width} as int)").alias("block"), "fp").agg(F.min("seq").alias("seq"))
    bits = group_bits(n)
    return _grouped(entries, p, bits).groupBy("g").applyInPandas(_first_per_group(p, bits), "fp long, seq long")


def filters(rows: DataFrame, p: int, n: int) -> DataFrame:
    """Serialised filters of the fingerprints in ``rows`` (fp), one per range of quotients: g, keys, bits, filter."""

    bits = group_bits(n)
    mask = np.uint64((1 << (p - bits)) - 1)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = QuotientFilter(np.sort(pdf["fp"].to_numpy().astype(np.uint64)) & mask, p - bits)
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "keys": [f.n], "bits": [f.bits()], "filter": [f.to_bytes()]})

    return _grouped(rows.select("fp").distinct(), p, bits).groupBy("g").applyInPandas(build, "g long, keys long, bits long, filter binary")


def merge_filters(*parts: DataFrame) -> DataFrame:
    """Filters of the same ranges united, range by range."""

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        f = QuotientFilter.from_bytes(pdf["filter"].iloc[0])
        for other in pdf["filter"].iloc[1:]:
            f = f.merge(QuotientFilter.from_bytes(other))
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "keys": [f.n], "bits": [f.bits()], "filter": [f.to_bytes()]})

    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy("g").applyInPandas(unite, "g long, keys long, bits long, filter binary")


def seen_before(df: DataFrame, seq: str, key: str, error: float) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows of ``df`` (seq, key; null keys left out) whose key the filter has seen at a smaller seq.

    Returns (rows the filter takes for seen, all keyed rows with fp and check hash, p, number of keyed rows).
    """
    keyed = df.filter(F.col(key).isNotNull())
    n, low, high = keyed.agg(F.count("*"), F.min(seq), F.max(seq)).first()
    p = fingerprint_bits(n, error)
    rows = keyed.select(F.col(seq).alias("seq"), fingerprint(key, p).alias("fp"), check_hash(key).alias("check"))
    first = first_occurrences(rows.select("seq", "fp"), p, n, low or 0, high or 0)
    seen = rows.select("seq").join(first.select("seq"), "seq", "left_anti")
    return seen, rows, p, n


def wrong_answers(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """seq of the rows wrongly among ``seen``: the first of their key (fingerprint and check hash together).

    This remembers every key and is for measuring the error, not part of the answer.
    """
    return rows.groupBy("fp", "check").agg(F.min("seq").alias("seq")).select("seq").join(seen, "seq", "left_semi")

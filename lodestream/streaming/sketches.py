"""The stream sketches as Structured Streaming queries; each agrees with its batch form.

Flajolet-Martin registers and reservoir slots are maxima per key and run as streaming aggregates with Spark's own state.
The Bloom filter compares every element with bits set by all earlier ones; its state (the order number at which each bit
was set, and each user's first) is a table in the shared folder, a new version for each micro-batch, so that a restarted
query goes on from the version its checkpoint names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators import sketches as S
from lodestream.scratch import remove


def fm_registers(stream: DataFrame, size: int) -> DataFrame:
    """batch, r0..r15: the most trailing zeros of each hash, as a streaming aggregate (update or complete mode)."""
    hashes, registers = S.fm_hashes("_x")
    return S.batches(stream, size).withColumn("_x", S.text_modulo("user_id")).groupBy("batch").agg(*hashes).select("batch", *registers)


def fm_estimate(registers: DataFrame) -> DataFrame:
    """batch, estimate from registers."""
    means = [sum((F.pow(F.lit(2.0), F.col(f"r{k}")) for k in range(g, g + S.FM_GROUP)), F.lit(0.0)) / S.FM_GROUP for g in range(0, len(S.FM_A), S.FM_GROUP)]
    ordered = F.array_sort(F.array(*means))
    return registers.select("batch", F.floor((ordered[1] + ordered[2]) / 2).alias("estimate"))


def reservoir(stream: DataFrame, k: int) -> DataFrame:
    """slot, user_id, n: the reservoir's present content, as a streaming aggregate. ``stream``: n (dense), user_id."""
    return S.reservoir_events(stream, k).groupBy("slot").agg(F.max_by("user_id", "n").alias("user_id"), F.max("n").alias("n"))


class BloomState:
    """Versions of the filter's state below a folder all executors share.

    The state is the bits that are on, with the order number that set each: at most ``bits`` rows. With ``truth``, each
    user's first order number is kept as well, to measure false positives; that table grows with the users.
    """

    def __init__(self, folder: str, bits: int = S.BLOOM_BITS, truth: bool = False) -> None:
        self.folder, self.bits, self.truth = folder.rstrip("/"), bits, truth

    def _merged(self, new: DataFrame, name: str, key: str, batch_id: int) -> DataFrame:
        """The least ``at`` of each key over the version before ``batch_id`` and ``new``, written as version ``batch_id``."""
        spark = new.sparkSession
        path = f"{self.folder}/{name}-v"
        both = spark.read.parquet(f"{path}{batch_id - 1}").unionByName(new) if batch_id else new
        both.groupBy(key).agg(F.min("at").alias("at")).write.mode("overwrite").parquet(f"{path}{batch_id}")
        if batch_id > 1:  # a batch run again needs the version before it, none earlier
            remove(spark, f"{path}{batch_id - 2}")
        return spark.read.parquet(f"{path}{batch_id}")

    def handler(self, on_answers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function: hands seq, user_id, maybe_seen (and seen) of each micro-batch to ``on_answers``.

        Micro-batches must come in order of seq. A batch that is run again reads the version before it and overwrites
        its own.
        """

        def run(batch: DataFrame, batch_id: int) -> None:
            rows = batch.select("seq", "user_id").persist()
            firsts = rows.groupBy("user_id").agg(F.min("seq").alias("at"))
            mine = firsts.withColumn("x", S.text_modulo("user_id")).select("user_id", "at", F.explode(F.array_distinct(S.bloom_positions("x", self.bits))).alias("bit"))
            on = self._merged(mine.select("bit", "at"), "bits", "bit", batch_id)
            ready = mine.select("user_id", "bit").join(on, "bit").groupBy("user_id").agg(F.max("at").alias("ready"))
            out = rows.join(ready, "user_id").select("seq", "user_id", (F.col("ready") < F.col("seq")).alias("maybe_seen"))
            if self.truth:
                known = self._merged(firsts, "users", "user_id", batch_id)
                out = out.join(known, "user_id").select("seq", "user_id", "maybe_seen", (F.col("at") < F.col("seq")).alias("seen"))
            on_answers(out, batch_id)
            rows.unpersist()

        return run

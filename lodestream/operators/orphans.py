"""References to records that did not exist (yet, or any more) when the referring row was loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.ids import clean_id
from lodestream.operators.skew import broadcast_if_small, salted_join
from lodestream.scratch import written

#: Rows of one key beyond which its children are spread over several groups.
HOT_CHILDREN = 100_000


def first_delivery(df: DataFrame, key: str, loaded: str = "loaded_at") -> DataFrame:
    """Of each key the delivery with the smallest ``loaded``; full ties go to the smallest row, null keys are left out.

    Deliveries without a load time count as the latest.
    """
    rest = [c for c in df.columns if c not in (key, loaded)]
    best = F.min(F.struct(F.col(loaded).isNull().alias("_late"), F.col(loaded), *[F.col(c) for c in rest]))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_d")).select(key, *[F.col(f"_d.{c}").alias(c) for c in [loaded, *rest]])


def children(df: DataFrame, table: str, key: str, refs: dict[str, str], loaded: str = "loaded_at") -> DataFrame:
    """Long form of a table's references: ``refs`` maps a column to the parent table it points to.

    One row per delivery and present reference: table_name, row_id, ref_field, parent, ref_key, at.
    """
    first = first_delivery(df.select(key, loaded, *refs), key, loaded)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.lit(p).alias("parent"), clean_id(c).alias("ref_key")) for c, p in refs.items()]))
    return first.select(F.lit(table).alias("table_name"), F.col(key).cast("long").alias("row_id"), F.col(loaded).alias("at"), fields.alias("_f")).select("table_name", "row_id", "_f.*", "at").filter(F.col("ref_key").isNotNull())


def parents(df: DataFrame, parent: str, key: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """Life spans of a parent table's keys: parent, ref_key, born, died (null: still live).

    Rows without key or load time, and rows deleted no later than loaded, are never live and are left out.
    """
    spans = df.select(F.lit(parent).alias("parent"), clean_id(key).alias("ref_key"), F.col(loaded).alias("born"), F.col(deleted).alias("died"))
    return spans.filter(F.col("ref_key").isNotNull() & F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("died") > F.col("born")))).distinct()


def orphans(refs: DataFrame, spans: DataFrame, hot: int = HOT_CHILDREN) -> DataFrame:
    """References for which no parent row with that key is live at load time.

    Parents and children are united in one long table, tagged, and grouped by parent table and key. Within a group a
    running count over time (+1 where a span begins, -1 where it ends) tells how many parent rows are live at each
    child; a child at 0 is an orphan. A parent that begins or ends at the very time of the child counts as begun and
    as ended. Keys referred to by more than ``hot`` rows are split: their children go to several groups, each with a
    copy of the key's (few) parent rows. A child without load time has no live parent. ``was_live`` tells whether some
    parent row had begun before.
    """
    busy = refs.groupBy("parent", "ref_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)
    busy = broadcast_if_small(written(busy.select("parent", "ref_key", F.ceil(F.col("_n") / hot).cast("int").alias("_ways"))))
    ends = F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("step")), F.struct(F.col("died").alias("at"), F.lit(-1).alias("step")))
    up = spans.join(busy, ["parent", "ref_key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ways") - 1, F.lit(0)))))
    up = up.withColumn("_e", F.explode(ends)).select("parent", "ref_key", "salt", "_e.at", F.lit(0).alias("tag"), "_e.step").filter(F.col("at").isNotNull())
    down = refs.join(busy, ["parent", "ref_key"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("_ways")), F.lit(0)).cast("int")).drop("_ways")
    long = down.withColumns({"tag": F.lit(1), "step": F.lit(0)}).unionByName(up, allowMissingColumns=True)
    so_far = W.partitionBy("parent", "ref_key", "salt").orderBy(F.col("at").asc_nulls_first(), "tag").rowsBetween(W.unboundedPreceding, 0)
    seen = long.withColumns({"live": F.sum("step").over(so_far), "begun": F.max(F.col("step") == 1).over(so_far)})
    return seen.filter((F.col("tag") == 1) & (F.col("live") <= 0)).select("table_name", "row_id", "ref_field", "parent", "ref_key", "at", F.col("begun").alias("was_live"))


def with_kind(lost: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``kind`` to orphans: ``deleted``, ``later`` (the key's first parent row was loaded later) or ``missing``."""
    known = spans.select("parent", "ref_key").distinct().withColumn("_known", F.lit(True))
    kind = F.when(F.col("was_live"), "deleted").when(F.col("_known"), "later").otherwise("missing")
    return salted_join(lost, known, ["parent", "ref_key"], F.xxhash64("row_id"), "left", HOT_CHILDREN).withColumn("kind", kind).drop("_known")


def orphan_counts(lost: DataFrame, period: str = "month") -> DataFrame:
    """Orphans per table, field, kind and period (of load time; ``unknown`` where that is null)."""
    when = F.coalesce(F.date_format(F.date_trunc(period, F.col("at")), "yyyy-MM-dd"), F.lit("unknown"))
    return lost.groupBy("table_name", "ref_field", "kind", when.alias("period")).agg(F.count("*").alias("orphans"), F.count_distinct("ref_key").alias("keys"))

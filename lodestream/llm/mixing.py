"""Drawing records so that every source reaches a target share of all tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators.prefix import prefix_sums
from lodestream.operators.skew import broadcast_if_small
from lodestream.scratch import written


def source_name(col: str) -> Column:
    """A source's name in one spelling: trimmed, lower case, ``_`` for ``-``; null where nothing is left."""
    name = F.regexp_replace(F.lower(F.btrim(F.col(col), F.lit(" \t"))), "-", "_")
    return F.when(name != "", name)


def targets(df: DataFrame) -> DataFrame:
    """source, target_share, max_repeats of the usable targets (positive share and repeats); repeated rows count once."""
    t = df.select(source_name("source").alias("source"), "target_share", F.col("max_repeats").cast("long").alias("max_repeats")).filter((F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull())
    return t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every different text once: source, doc_id, tokens. ``docs``: doc_id, source, tokens, digest (of the text).

    Of equal texts the document with the smallest doc_id stands for all, so no text is used more often than its source
    allows. Texts of sources without target, and of no tokens, are left out.
    """
    usable = docs.filter((F.col("tokens") > 0) & F.col("source").isNotNull()).join(broadcast_if_small(wanted.select("source")), "source", "left_semi")
    first = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d"))
    return first.select("d.source", "d.doc_id", "d.tokens")


def budgets(unique: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per target source: texts, available tokens, and budget = how many tokens to draw.

    Sources without texts cannot be drawn; the others keep their shares relative to each other (``fair_share``). The
    total is the largest for which no source needs more than ``max_repeats`` times its tokens.
    """
    have = unique.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("available"))
    known = wanted.join(have, "source", "left").withColumns({"texts": F.coalesce("texts", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    every = W.partitionBy()  # one row per target
    share = F.when(F.col("available") > 0, F.col("target_share"))
    fair = known.withColumn("fair_share", F.coalesce(share / F.sum(share).over(every), F.lit(0.0)))
    total = F.min(F.when(F.col("fair_share") > 0, F.col("available") * F.col("max_repeats") / F.col("fair_share"))).over(every)
    return fair.withColumn("budget", F.coalesce(F.col("fair_share") * total, F.lit(0.0)))


def draw(unique: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """source, doc_id, tokens, times: how often each text is drawn (never 0).

    Texts of a source are ordered by a hash of their doc_id. Full epochs take every text; of the last epoch those are
    taken whose running sum of tokens stays within what is left of the budget, and the text at the cut where more than
    half of it is. Running sums are distributed prefix sums, so a source of any size needs no sort in one task.
    """
    epochs = F.floor(F.when(F.col("available") > 0, F.col("budget") / F.col("available") + 1e-12).otherwise(0))
    parts = broadcast_if_small(plan.select("source", "max_repeats", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("available")).alias("rest")))
    keyed = unique.withColumn("_key", F.xxhash64(F.lit(seed), F.col("doc_id")))
    summed = prefix_sums(keyed, ["source"], ["_key", "doc_id"], "tokens", "_upto").join(parts, "source")
    within = (F.col("_upto") - F.col("tokens") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    times = (F.col("epochs") + within.cast("int")).cast("int")
    return summed.withColumn("times", times).filter("times > 0").select("source", "doc_id", "tokens", "times")


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: target and fair share, texts and tokens drawn, and the share of all tokens reached."""
    got = drawn.groupBy("source").agg(F.count("*").alias("drawn_texts"), F.max("times").alias("most_times"), F.sum(F.col("tokens") * F.col("times")).alias("drawn_tokens"))
    out = plan.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("drawn_texts", "most_times", "drawn_tokens")})
    all_tokens = F.sum("drawn_tokens").over(W.partitionBy())  # one row per target
    return out.select("source", "target_share", "fair_share", "max_repeats", "texts", "available", "drawn_texts", "most_times", "drawn_tokens", F.when(all_tokens > 0, F.col("drawn_tokens") / all_tokens).otherwise(F.lit(0.0)).alias("share"))


def mix(docs: DataFrame, target_table: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(draws, plan) for ``docs`` (doc_id, source, tokens, digest)."""
    wanted = written(targets(target_table))
    unique = written(texts(docs, wanted))
    plan = written(budgets(unique, wanted))
    return draw(unique, plan, seed), plan

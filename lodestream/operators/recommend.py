"""Item-based rating prediction, its hybrid with a model, and error measures.

``ratings``: user_id, business_id, rating, possibly with repeated pairs. A pair's rating is the largest of its rows; the
averages of users, businesses and the whole are over all rows. ``test``: user_id, business_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions.rounding import half_up
from lodestream.operators.skew import salted_join
from lodestream.scratch import written

#: Ratings of one user beyond which they are dealt to several tasks.
HOT_HISTORY = 10_000
#: Neighbours used for a prediction, and the decimals similarities are ranked and used with.
NEIGHBOURS, PLACES = 15, 6


def pair_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id", "business_id").agg(F.max("rating").alias("rating"))


def averages(ratings: DataFrame, key: str, out: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg("rating").alias(out))


def item_similarity(wanted: DataFrame, rated: DataFrame, ratings: DataFrame, penalties: str | None = None) -> DataFrame:
    """similarity of item pairs ``wanted`` (i < j), rounded; columns i, j, common, similarity.

    By the number of users who rated both (each pair's rating once):
    at most 1: ``(5 - |avg_i - avg_j|) / 5``; 2: the mean of ``(5 - |r_i - r_j|) / 5``; 3 or more: Pearson correlation
    over the common users with their means, 0 where either is constant. ``penalties="hybrid"`` multiplies these by 0.5,
    0.7 and ``min(1, common / 50)``, ``"wide"`` treats 2 as 3 or more and uses ``min(1, common / 30)``. All sums are of
    small whole numbers and exact. Items nobody rated have similarity 0.

    Of each pair the item with fewer raters is looked up in the other, so hot items do not multiply.
    """
    counts = rated.groupBy("business_id").agg(F.count("*").alias("n"))
    sized = wanted.join(counts.select(F.col("business_id").alias("i"), F.col("n").alias("ni")), "i", "left").join(counts.select(F.col("business_id").alias("j"), F.col("n").alias("nj")), "j", "left")
    swap = F.col("ni") > F.col("nj")
    ordered = sized.select("i", "j", F.when(swap, F.col("j")).otherwise(F.col("i")).alias("p"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("q"))
    rows = ordered.join(rated.select(F.col("business_id").alias("p"), "user_id", F.col("rating").alias("x")), "p")
    both = rows.join(rated.select(F.col("business_id").alias("q"), "user_id", F.col("rating").alias("y")), ["q", "user_id"])
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("i", "j").agg(F.count("*").alias("common"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum((5 - F.abs(x - y)) / 5).alias("near"))
    means = averages(ratings, "business_id", "m")
    full = wanted.join(sums, ["i", "j"], "left").join(means.select(F.col("business_id").alias("i"), F.col("m").alias("mi")), "i", "left").join(means.select(F.col("business_id").alias("j"), F.col("m").alias("mj")), "j", "left")
    n = F.coalesce("common", F.lit(0))
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    pearson = F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).otherwise(0.0)
    few, two = (5 - F.abs(F.col("mi") - F.col("mj"))) / 5, F.col("near") / 2
    if penalties is None:
        value = F.when(n <= 1, few).when(n == 2, two).otherwise(pearson)
    elif penalties == "hybrid":
        value = F.when(n <= 1, few * 0.5).when(n == 2, two * 0.7).otherwise(pearson * F.least(F.lit(1.0), n / 50))
    elif penalties == "wide":
        value = F.when(n <= 1, few * 0.5).otherwise(pearson * F.least(F.lit(1.0), n / 30))
    else:
        raise ValueError(f"unknown penalties {penalties!r}")
    return full.select("i", "j", n.alias("common"), F.coalesce(half_up(value, PLACES), F.lit(0.0)).alias("similarity"))


def _neighbours(test: DataFrame, rated: DataFrame, ratings: DataFrame, penalties: str | None) -> DataFrame:
    """Per test row and item its user rated: user_id, business_id, other, rating, similarity (positive ones)."""
    targets = test.select("user_id", "business_id").distinct()
    known = rated.select("business_id").distinct()
    others = rated.select("user_id", F.col("business_id").alias("other"), "rating")
    met = salted_join(others, targets.join(known, "business_id", "left_semi"), ["user_id"], F.xxhash64("other"), threshold=HOT_HISTORY).filter("other != business_id")
    met = written(met.withColumns({"i": F.least("business_id", "other"), "j": F.greatest("business_id", "other")}))
    similar = item_similarity(met.select("i", "j").distinct(), rated, ratings, penalties).filter("similarity > 0")
    return met.join(similar, ["i", "j"])


def predict(test: DataFrame, ratings: DataFrame, neighbours: int = NEIGHBOURS, penalties: str | None = None, confidence: bool = False) -> DataFrame:
    """user_id, business_id, prediction (clipped to 1..5) for distinct test pairs; empty ratings give nulls.

    In this order: a pair rated before gets that rating (not with ``confidence``); an unknown user gets the business
    average, else the global one; an unknown business the user's average; otherwise the similarity-weighted mean rating
    of the ``neighbours`` most similar items the user rated (ties: smaller id), or the user's average without any.
    ``confidence`` adds a column: 0.1 for one unknown side, 0.05 for two, else ``min(0.6, used / neighbours * mean
    similarity)`` and 0.1 without a neighbour.
    """
    rated = written(pair_ratings(ratings))
    near = _neighbours(test, rated, ratings, penalties)
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy("user_id", "business_id").orderBy(F.desc("similarity"), "other"))).filter(F.col("k") <= neighbours)
    s = F.col("similarity")
    summed = ranked.groupBy("user_id", "business_id").agg((F.sum(s * F.col("rating")) / F.sum(F.abs(s))).alias("weighted"), F.count("*").alias("used"), F.avg(s).alias("mean_similarity"))
    overall = ratings.agg(F.avg("rating").alias("overall"))  # one row
    full = (
        test.select("user_id", "business_id").distinct()
        .join(rated, ["user_id", "business_id"], "left")
        .join(averages(ratings, "user_id", "user_mean"), "user_id", "left")
        .join(averages(ratings, "business_id", "business_mean"), "business_id", "left")
        .join(summed, ["user_id", "business_id"], "left")
        .join(F.broadcast(overall))
    )
    no_user, no_business = F.col("user_mean").isNull(), F.col("business_mean").isNull()
    value = F.when(no_user, F.coalesce("business_mean", "overall")).when(no_business, F.col("user_mean")).otherwise(F.coalesce("weighted", "user_mean"))
    if not confidence:
        value = F.coalesce(F.col("rating"), value)
    out = full.withColumn("prediction", clip(value))
    trust = F.when(no_user & no_business, 0.05).when(no_user | no_business | F.col("used").isNull(), 0.1).otherwise(F.least(F.lit(0.6), F.col("used") / neighbours * F.col("mean_similarity")))
    return out.select("user_id", "business_id", "prediction", *[trust.alias("confidence")] if confidence else [])


def clip(value: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """The value kept within the bounds; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


# Fixed values of the weight: its base, what an active and an inactive side add and take, what two extreme means add,
# and its largest value; the counts of an active and an inactive user and business; the least weight, which an unknown
# side sets; and the bounds beyond which a mean is extreme.
WEIGHTS = {"standard": (0.2, 0.05, 0.05, 0.1, 0.4), "narrow": (0.15, 0.05, 0.03, 0.0, 0.3)}
ACTIVE_USER, ACTIVE_BUSINESS = (30, 5), (50, 10)
LEAST_WEIGHT, EXTREME = 0.05, (4.5, 1.5)


def hybrid_weight(confidence: Column, user_count: Column, business_count: Column, user_mean: Column, business_mean: Column, variant: str = "standard") -> Column:
    """Weight of the neighbourhood prediction against the model's.

    Counts and means are those of the training: the businesses a user rated, the users who rated a business; null means
    unknown there. ``WEIGHTS`` holds the variants.
    """
    base, up, down, bonus, top = WEIGHTS[variant]
    w = F.lit(base) * confidence
    for count, (many, few) in ((user_count, ACTIVE_USER), (business_count, ACTIVE_BUSINESS)):
        w = F.when(count.isNull(), LEAST_WEIGHT).when(count > many, w + up).when(count < few, w - down).otherwise(w)
    high, low = EXTREME
    extreme = ((user_mean > high) | (user_mean < low)) & ((business_mean > high) | (business_mean < low))
    return F.least(F.greatest(F.when(F.coalesce(extreme, F.lit(False)), w + bonus).otherwise(w), F.lit(LEAST_WEIGHT)), F.lit(top))


def training_activity(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, user_count, user_mean; business_id, business_count, business_mean) of training ratings: how many
    different ones each rated or was rated by, and the mean over all rows."""
    both = ratings.groupBy("user_id", "business_id").agg(F.sum("rating").alias("_s"), F.count("rating").alias("_n"))
    per = lambda key, name: both.groupBy(key).agg(F.count("*").alias(f"{name}_count"), (F.sum("_s") / F.sum("_n")).alias(f"{name}_mean"))
    return per("user_id", "user"), per("business_id", "business")


def blend(weight: Column, neighbourhood: Column, model: Column) -> Column:
    return clip(weight * neighbourhood + (1 - weight) * model)


def with_error(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """Predictions joined to actual ratings (distinct pairs), with ``error`` = prediction - rating."""
    truth = pair_ratings(actual)
    return predictions.join(truth, ["user_id", "business_id"]).withColumn("error", F.col("prediction") - F.col("rating"))


def rmse(errors: DataFrame, places: int = 6) -> DataFrame:
    """One row: n, rmse (0 without rows)."""
    return errors.agg(F.count("error").alias("n"), half_up(F.coalesce(F.sqrt(F.avg(F.col("error") * F.col("error"))), F.lit(0.0)), places).alias("rmse"))


#: Bins of the absolute error.
BINS = ("[0,1)", "[1,2)", "[2,3)", "[3,4)", "[4,inf)")


def error_histogram(errors: DataFrame) -> DataFrame:
    """bin, n, share for all five bins, empty ones too (share 0 without rows)."""
    spark = errors.sparkSession
    bins = F.broadcast(spark.createDataFrame(list(enumerate(BINS)), "k int, bin string"))
    counted = errors.filter(F.col("error").isNotNull()).groupBy(F.floor(F.least(F.abs("error"), F.lit(4.0))).cast("int").alias("k")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())  # five rows
    filled = bins.join(F.broadcast(counted), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select("bin", "n", F.when(total > 0, half_up(F.col("n") / total, 6)).otherwise(F.lit(0.0)).alias("share"))

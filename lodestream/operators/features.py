"""Features of users, businesses and their past, and rating models over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.scratch import written

#: The kinds of compliments (fixed values).
COMPLIMENTS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")


def listed(col: str) -> Column:
    """Number of entries of a comma list; 0 for null, blank and the word ``None``."""
    c = F.btrim(F.col(col))
    return F.when(c.isNull() | (c == "") | (c == "None"), 0).otherwise(F.size(F.split(c, ",")))


def business_features(df: DataFrame) -> DataFrame:
    """business_id, b_stars, b_reviews, b_open, num_attrs, num_categories, price_range (0 where it cannot be read)."""
    price = F.regexp_replace(F.try_element_at("attributes", F.lit("RestaurantsPriceRange2")), "[^0-9]", "").try_cast("int")
    return df.select("business_id", F.coalesce("stars", F.lit(3.5)).alias("b_stars"), F.coalesce("review_count", F.lit(0)).alias("b_reviews"), F.coalesce("is_open", F.lit(0)).alias("b_open"), F.coalesce(F.when(F.col("attributes").isNotNull(), F.size("attributes")), F.lit(0)).alias("num_attrs"), listed("categories").alias("num_categories"), F.coalesce(price, F.lit(0)).alias("price_range"))


def user_features(df: DataFrame, as_of: str) -> DataFrame:
    """user_id, u_stars, u_reviews, fans, u_useful, u_funny, u_cool, num_elite, num_friends, compliments (mean of the
    eleven kinds), and years of membership at the day ``as_of`` (0 where the date is later or cannot be read)."""
    since = F.substring("yelping_since", 1, 10).try_cast("date")
    zero = lambda c: F.coalesce(c, F.lit(0))
    compliments = sum((zero(f"compliment_{c}") for c in COMPLIMENTS), F.lit(0)) / len(COMPLIMENTS)
    years = F.greatest(F.coalesce(F.datediff(F.lit(as_of).cast("date"), since) / 365.25, F.lit(0.0)), F.lit(0.0))
    votes = [zero(c).alias(f"u_{c}") for c in ("useful", "funny", "cool")]
    return df.select("user_id", F.coalesce("average_stars", F.lit(3.5)).alias("u_stars"), zero("review_count").alias("u_reviews"), zero("fans").alias("fans"), *votes, listed("elite").alias("num_elite"), listed("friends").alias("num_friends"), compliments.alias("compliments"), years.alias("membership_years"))


def review_means(reviews: DataFrame, keys: Sequence[str], prefix: str, values: Sequence[str] = ("useful", "funny", "cool")) -> DataFrame:
    """Means of ``values`` and the number of reviews per key, in one aggregate; null keys left out."""
    keyed = reviews
    for k in keys:
        keyed = keyed.filter(F.col(k).isNotNull())
    return keyed.groupBy(*keys).agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in values], F.count("*").alias(f"{prefix}_n"))


#: What a pair's own reviews say.
PAIR_VALUES = ("stars", "useful", "funny", "cool")


def tip_statistics(tips: DataFrame) -> DataFrame:
    """Per user and business: likes, tips."""
    return tips.filter("user_id is not null and business_id is not null").groupBy("user_id", "business_id").agg(F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"), F.count("*").alias("tips"))


def photo_statistics(photos: DataFrame) -> DataFrame:
    """Per business: different labels, photos."""
    return photos.filter("business_id is not null").groupBy("business_id").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("photos"))


def checkin_totals(checkins: DataFrame) -> DataFrame:
    """Per business: sum over the values of the ``time`` maps; null and empty maps count 0."""
    per_row = F.coalesce(F.aggregate(F.map_values("time"), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0))), F.lit(0).cast("long"))
    return checkins.filter("business_id is not null").groupBy("business_id").agg(F.sum(per_row).alias("checkins"))


def _joined(pairs: DataFrame, *sides: tuple[DataFrame, list[str]]) -> DataFrame:
    for side, on in sides:
        pairs = pairs.join(side, on, "left")
    return pairs


# The feature sets, in order.
FEATURES_8 = ["r_useful", "r_funny", "r_cool", "u_stars", "u_reviews", "fans", "b_stars", "b_reviews"]
FEATURES_6 = ["r_useful", "r_funny", "u_stars", "b_stars", "u_reviews", "b_reviews"]
FEATURES_22 = [
    "r_useful", "r_funny", "r_cool", "r_n", "u_stars", "u_reviews", "fans", "u_useful", "u_funny", "u_cool", "num_friends", "b_stars", "b_reviews", "b_open", "num_categories",
    "stars_product", "reviews_product", "useful_rate", "engagement", "activity_match", "u_bias", "b_bias",
]
FEATURES_25 = [
    "u_reviews", "u_useful", "u_funny", "u_cool", "fans", "u_stars", "num_elite", "num_friends", "compliments", "membership_years", "b_stars", "b_reviews", "b_open", "num_attrs", "num_categories",
    "p_stars", "p_useful", "p_funny", "p_cool", "likes", "tips", "labels", "photos", "checkins", "price_range",
]
DROPPED_4 = ["p_stars", "p_useful", "p_funny", "p_cool"]
FEATURES_21 = [c for c in FEATURES_25 if c not in DROPPED_4]

#: Stars of an unknown side where no training averages are given.
_DEFAULTS = {"u_stars": 3.5, "b_stars": 3.5}


def assemble(pairs: DataFrame, users: DataFrame, businesses: DataFrame, reviews: DataFrame, columns: Sequence[str], tips: DataFrame | None = None, photos: DataFrame | None = None, checkins: DataFrame | None = None, ratings: DataFrame | None = None) -> DataFrame:
    """The columns of ``pairs`` and the asked feature columns as doubles.

    Unknown sides get 0. Their stars are the mean of the user's or business's ``ratings`` (of the training), else the
    mean of all of them; without ``ratings``, 3.5. The biases are against the mean of all ratings, or 3.5. Every side
    has one row a key, so a join whose columns are not asked for is left out of the plan by hand.
    """
    want = set(columns)
    sides: list[tuple[DataFrame, list[str]]] = [(users, ["user_id"]), (businesses, ["business_id"])]
    if want & {"r_useful", "r_funny", "r_cool", "r_n", "useful_rate"}:
        sides.append((review_means(reviews, ["business_id"], "r"), ["business_id"]))
    if want & set(DROPPED_4):
        sides.append((review_means(reviews, ["user_id", "business_id"], "p", PAIR_VALUES), ["user_id", "business_id"]))
    if tips is not None and want & {"likes", "tips"}:
        sides.append((tip_statistics(tips), ["user_id", "business_id"]))
    if photos is not None and want & {"labels", "photos"}:
        sides.append((photo_statistics(photos), ["business_id"]))
    if checkins is not None and "checkins" in want:
        sides.append((checkin_totals(checkins), ["business_id"]))
    if ratings is not None:
        sides += [(ratings.groupBy(k).agg(F.avg("rating").alias(m)), [k]) for k, m in (("user_id", "_u_mean"), ("business_id", "_b_mean"))]
    full = _joined(pairs, *sides)
    if ratings is not None:
        full = full.join(F.broadcast(ratings.agg(F.coalesce(F.avg("rating"), F.lit(3.5)).alias("_mean"))))  # one row
    overall = F.lit(3.5) if ratings is None else F.col("_mean")
    stars = {} if ratings is None else {"u_stars": F.coalesce("u_stars", "_u_mean", "_mean"), "b_stars": F.coalesce("b_stars", "_b_mean", "_mean")}
    c = lambda name: stars.get(name, F.coalesce(F.col(name).cast("double"), F.lit(_DEFAULTS.get(name, 0.0))))
    derived = {
        "stars_product": lambda: c("u_stars") * c("b_stars"),
        "reviews_product": lambda: c("u_reviews") * c("b_reviews"),
        "useful_rate": lambda: c("r_useful") / (c("r_n") + 1),
        "engagement": lambda: (c("u_useful") + c("u_funny") + c("u_cool")) / (c("u_reviews") + 1),
        "activity_match": lambda: F.least(c("u_reviews"), c("b_reviews")) / (F.greatest(c("u_reviews"), c("b_reviews")) + 1),
        "u_bias": lambda: c("u_stars") - overall,
        "b_bias": lambda: c("b_stars") - overall,
    }
    clean = lambda v: F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(v)
    return full.select(*[full[x] for x in pairs.columns], *[clean(derived[f]() if f in derived else c(f) if f in full.columns else F.lit(0.0)).alias(f) for f in columns])


def min_max(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """The columns scaled to 0..1 by the range in ``fitted_on`` (default: themselves); constant columns and nulls give 0."""
    source = df if fitted_on is None else fitted_on
    bounds = source.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])  # one row
    scaled = [F.when((F.col(f"_hi_{c}") > F.col(f"_lo_{c}")) & F.col(c).isNotNull(), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0).alias(c) for c in columns]
    return df.join(F.broadcast(bounds)).select(*[c for c in df.columns if c not in columns], *scaled)


def boosted_trees(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "rating", trees: int = 20, depth: int = 5, step: float = 0.1, scale: bool = False) -> DataFrame:
    """``test`` with ``prediction`` of gradient-boosted trees fitted to ``train``, clipped to 1..5.

    With ``scale``, features are scaled to 0..1 by the training range first. Empty training data is an error of the
    learner and raised as such.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from lodestream.operators.recommend import clip

    if scale:
        train, test = min_max(train, columns), min_max(test, columns, train)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=42, predictionCol="_p").fit(written(assembler.transform(train).select("_x", label)))
    return model.transform(assembler.transform(test)).withColumn("prediction", clip(F.col("_p"))).drop("_x", "_p")

"""Logical inputs over the stored tables, as DataFrames and as the same SQL.

Each function gives one cleaned input of the mining operators: ids without padding, the first delivery of a review or
tip, the latest delivery of a user or business, unusable numbers as null. ``WITH`` holds common table expressions of
the same content for SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.ids import clean_id, clean_id_sql
from lodestream.operators.orphans import first_delivery
from lodestream.operators.sketches import PRIME
from lodestream.sources.tables import table


def usable(col: str, low: float, high: float) -> Column:
    """The number if it lies in the range, else null (also for NaN)."""
    return F.when(F.col(col).between(low, high) & ~F.isnan(F.col(col).cast("double")), F.col(col))


def latest_delivery(df: DataFrame, key: str, loaded: str = "loaded_at") -> DataFrame:
    """Of each key the delivery with the largest ``loaded``; ties go to the row whose other columns are largest.

    Null keys are left out; a delivery without load time counts as the earliest. Maps cannot be ordered and take no
    part in ties.
    """
    orderable = [c for c, kind in df.dtypes if c not in (key, loaded) and not kind.startswith("map")]
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(loaded).isNotNull().alias("_known"), F.col(loaded), *orderable))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_d")).select(key, *[F.col(f"_d.{c}").alias(c) for c in rest])


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """review_id, user_id, business_id, date, stars, useful, funny, cool of first deliveries."""
    t = table(spark, d, "review_train").select("review_id", "loaded_at", "user_id", "business_id", "date", "stars", "useful", "funny", "cool")
    numbers = [usable(c, 0.0, 1e6).alias(c) for c in ("useful", "funny", "cool")]
    return first_delivery(t, "review_id").select("review_id", clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id"), "date", usable("stars", 1.0, 5.0).alias("stars"), *numbers)


def tips(spark: SparkSession, d: str) -> DataFrame:
    """tip_id, user_id, business_id, likes of first deliveries."""
    t = table(spark, d, "tip").select("tip_id", "loaded_at", "user_id", "business_id", "likes")
    return first_delivery(t, "tip_id").select("tip_id", clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id"), "likes")


def businesses(spark: SparkSession, d: str) -> DataFrame:
    """Latest delivery of each business; ``city`` trimmed and in lower case, null where blank."""
    t = table(spark, d, "business").withColumn("business_id", clean_id("business_id"))
    city = F.lower(F.btrim(F.col("city"), F.lit(" \t")))
    return latest_delivery(t, "business_id").withColumn("city", F.when(city != "", city))


def users(spark: SparkSession, d: str) -> DataFrame:
    """Latest delivery of each user."""
    return latest_delivery(table(spark, d, "yelp_user").withColumn("user_id", clean_id("user_id")), "user_id")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """user_id, business_id, rating of rows with both ids and a rating on the scale; rows as often as they occur."""
    t = table(spark, d, "yelp_train").select(clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id"), usable("rating", 1.0, 5.0).alias("rating"))
    return t.filter("user_id is not null and business_id is not null and rating is not null")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """user_id, business_id of rows with both ids, as often as they occur."""
    t = table(spark, d, "yelp_train").select(clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id"))
    return t.filter("user_id is not null and business_id is not null")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct user_id, business_id of rows with both ids."""
    return mentions(spark, d).distinct()


def stream(spark: SparkSession, d: str) -> DataFrame:
    """seq, user_id (cleaned, present), ts, city, channel of the stream of users; ``n`` = place among those rows is
    left to the operators, which need a dense order only by batches of ``seq``."""
    return table(spark, d, "stream_users").select("seq", clean_id("user_id").alias("user_id"), "ts", "city", "channel").filter("user_id is not null")


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, label, features (doubles) of the embedding vectors."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def _number(col: str, high: str = "1e6", low: str = "0") -> str:
    return f"case when {col} between {low} and {high} and not isnan({col}) then {col} end as {col}"


_USER, _BUSINESS = clean_id_sql("user_id"), clean_id_sql("business_id")

#: Each view's common table expressions, by name; ``with_views`` puts together what a query needs.
WITH = {
    "reviews": f"""reviews as materialized (select review_id, {_USER} as user_id, {_BUSINESS} as business_id, date, {_number("stars", "5", "1")}, {_number("useful")}, {_number("funny")}, {_number("cool")}
 from (select *, row_number() over (partition by review_id order by loaded_at nulls last) as k from review_train where review_id is not null) where k = 1)""",
    "tips": f"""tips as materialized (select tip_id, {_USER} as user_id, {_BUSINESS} as business_id, likes from (select *, row_number() over (partition by tip_id order by loaded_at nulls last) as k from tip where tip_id is not null) where k = 1)""",
    "businesses": f"""businesses as materialized (select * exclude (k, city), nullif(lower(trim(city, chr(32) || chr(9))), '') as city from (select *, row_number() over (partition by business_id order by loaded_at desc nulls last, city desc nulls last, stars desc nulls last, review_count desc nulls last, is_open desc nulls last, categories desc nulls last, deleted_at desc nulls last) as k
 from (select * replace ({_BUSINESS} as business_id) from business) where business_id is not null) where k = 1)""",
    "users": f"""users as materialized (select * exclude (k) from (select *, row_number() over (partition by user_id order by loaded_at desc nulls last, average_stars desc nulls last, review_count desc nulls last, fans desc nulls last, useful desc nulls last, funny desc nulls last, cool desc nulls last, friends desc nulls last, elite desc nulls last, yelping_since desc nulls last) as k
 from (select * replace ({_USER} as user_id) from yelp_user) where user_id is not null) where k = 1)""",
    "ratings": f"""ratings as materialized (select user_id, business_id, rating from (select {_USER} as user_id, {_BUSINESS} as business_id, {_number("rating", "5", "1")} from yelp_train) where user_id is not null and business_id is not null and rating is not null)""",
    "pairs": f"""pairs as materialized (select distinct user_id, business_id from (select {_USER} as user_id, {_BUSINESS} as business_id from yelp_train) where user_id is not null and business_id is not null)""",
    "stream": f"""stream as materialized (select seq, user_id, ts, city, channel from (select seq, {_USER} as user_id, ts, city, channel from stream_users) where user_id is not null)""",
    "points": "points as materialized (select vec_id as id, label, embedding::double[] as features from embeddings)",
}


def bytes_modulo_sql(text: str, modulus: int = PRIME) -> str:
    """SQL of ``text_modulo``: the bytes of a text as one big number, modulo ``modulus``."""
    digits = f"hex(encode({text}))"
    return f"list_reduce(list_transform(range(1, length({digits}) + 1), lambda k: (strpos('0123456789ABCDEF', substr({digits}, k, 1)) - 1)::bigint), lambda a, x: (a * 16 + x) % {modulus}, 0::bigint)"


def with_views(sql: str, *names: str) -> str:
    """``sql`` preceded by the named views."""
    body = sql.strip()
    rest = f", {body[5:]}" if body.lower().startswith("with ") else f" {body}"
    return "with " + ", ".join(WITH[n] for n in names) + rest

"""The readers and writers of the file formats: tables written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.features import COMPLIMENTS
from lodestream.plans.registry import Registry
from lodestream.scratch import new_path
from lodestream.sources import readers, sinks
from lodestream.sources import views as V
from lodestream.sources.views import with_views

R = Registry()

_REVIEWS = "select review_id::varchar as review_id, user_id, business_id, date, stars, useful, funny, cool from reviews"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return V.reviews(spark, d).withColumn("review_id", F.col("review_id").cast("string"))


@R.query(with_views(_REVIEWS, "reviews"))
def json_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews as JSON lines among malformed ones, which the permissive reader drops."""
    path, t = new_path(spark), _reviews(spark, d)
    broken = spark.createDataFrame([("{broken",), ("{\"review_id\": ",)], "value string")
    sinks.write_lines(sinks.json_object(t).unionByName(broken), path)
    return readers.json_lines(spark, path, "review")


@R.query(with_views(_REVIEWS, "reviews"))
def json_reviews_strict(spark: SparkSession, d: str) -> DataFrame:
    """The same without malformed lines, by the reader that fails on them, in twenty partitions."""
    path = new_path(spark)
    sinks.write_lines(sinks.json_object(_reviews(spark, d)), path)
    return readers.json_lines(spark, path, "review", strict=True, partitions=20)


@R.query(with_views("select user_id, business_id, rating from ratings", "ratings"))
def csv_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings as CSV files, each with its header line."""
    path = new_path(spark)
    sinks.write_csv(V.ratings(spark, d).select("user_id", "business_id", "rating"), path)
    return readers.csv_rows(spark, path, "ratings")


@R.query(with_views("select id, label, len(features)::int as dims, features[1] as first_value, features[len(features)] as last_value from points", "points"))
def point_file(spark: SparkSession, d: str) -> DataFrame:
    """Points as headerless CSV lines of id, label and any number of features."""
    path, t = new_path(spark), V.points(spark, d)
    sinks.write_lines(t.select(F.concat_ws(",", F.col("id").cast("string"), F.col("label").cast("string"), F.transform("features", lambda x: x.cast("string"))).alias("value")), path)
    got = readers.point_rows(spark, path)
    return got.select("id", "label", F.size("features").alias("dims"), F.element_at("features", 1).alias("first_value"), F.element_at("features", -1).alias("last_value"))


@R.query(with_views("select row_number() over (order by seq) as seq, user_id from stream", "stream"))
def stream_file(spark: SparkSession, d: str) -> DataFrame:
    """The stream as one text file, an id a line, numbered again as it is read. One file keeps the order of its lines."""
    path = new_path(spark)
    sinks.write_lines(V.stream(spark, d).select("seq", F.col("user_id").alias("value")).coalesce(1).sortWithinPartitions("seq"), path)
    return readers.stream_lines(spark, path)


@R.query(with_views("select 'user' as kind, count(*) as n from users union all select 'business', count(*) from businesses union all select 'review', count(*) from reviews union all select 'tip', count(*) from tips union all select 'ratings', count(*) from ratings", "users", "businesses", "reviews", "tips", "ratings"))
def folder_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each input present in a folder of the usual file names."""
    path = new_path(spark)
    users = V.users(spark, d).select("user_id", "average_stars", "review_count", "fans", "useful", "funny", "cool", "friends", "elite", "yelping_since", *[f"compliment_{c}" for c in COMPLIMENTS])
    inputs = {"user": users, "business": V.businesses(spark, d), "review": _reviews(spark, d), "tip": V.tips(spark, d)}
    for kind, t in inputs.items():
        sinks.write_lines(sinks.json_object(t), f"{path}/{readers.FOLDER[kind]}")
    sinks.write_csv(V.ratings(spark, d).select("user_id", "business_id", "rating"), f"{path}/{readers.FOLDER['ratings']}")
    counted = [t.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, t in readers.folder(spark, path).items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out

"""Review statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.rounding import half_up_sql
from lodestream.operators import reports
from lodestream.plans.registry import Registry
from lodestream.sources import views as V
from lodestream.sources.views import with_views

R = Registry()
YEAR = 2016


@R.query(with_views("select count(*) as n from reviews", "reviews"))
def review_count(spark: SparkSession, d: str) -> DataFrame:
    return V.reviews(spark, d).agg(F.count("*").alias("n"))


@R.query(with_views(f"select count(*) as n from reviews where date like '{YEAR}%'", "reviews"))
def reviews_in_year(spark: SparkSession, d: str) -> DataFrame:
    return reports.in_year(V.reviews(spark, d), "date", YEAR).agg(F.count("*").alias("n"))


@R.query(with_views("select count(distinct user_id) as n from reviews", "reviews"))
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return V.reviews(spark, d).agg(F.count_distinct("user_id").alias("n"))


@R.query(with_views("select count(distinct business_id) as n from reviews", "reviews"))
def distinct_businesses(spark: SparkSession, d: str) -> DataFrame:
    return V.reviews(spark, d).agg(F.count_distinct("business_id").alias("n"))


@R.query(with_views("select user_id, count(*) as n from reviews where user_id is not null group by 1 order by n desc, user_id limit 10", "reviews"))
def top10_users(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_k(V.reviews(spark, d), "user_id")


@R.query(with_views("select business_id, count(*) as n from reviews where business_id is not null group by 1 order by n desc, business_id limit 10", "reviews"))
def top10_businesses(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_k(V.reviews(spark, d), "business_id")


@R.query(with_views(f"select count(*) as n_review, count(*) filter (date like '{YEAR}%') as n_review_{YEAR}, count(distinct user_id) as n_user, count(distinct business_id) as n_business from reviews", "reviews"))
def review_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reports.review_statistics(V.reviews(spark, d), YEAR)


@R.query(with_views(f"""select count(*) as n_review, count(*) filter (date like '{YEAR}%') as n_review_{YEAR}, count(distinct user_id) as n_user, count(distinct business_id) as n_business,
 (select string_agg(user_id || ':' || n, ',' order by n desc, user_id) from (select user_id, count(*) as n from reviews where user_id is not null group by 1 order by n desc, user_id limit 10)) as top10_user,
 (select string_agg(business_id || ':' || n, ',' order by n desc, business_id) from (select business_id, count(*) as n from reviews where business_id is not null group by 1 order by n desc, business_id limit 10)) as top10_business from reviews""", "reviews"))
def review_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report in one row; the lists as text so that any engine compares them alike."""
    lists = {c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["id"], e["n"])), ",") for c in ("top10_user", "top10_business")}
    return reports.review_report(V.reviews(spark, d), YEAR).withColumns(lists)


@R.query(with_views("select l as layout, count(*) as n_items from reviews, (values ('default'), ('customized'), ('random')) x(l) where business_id is not null group by 1", "reviews"))
def partition_row_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows over all partitions in both layouts; how they are spread depends on the engine."""
    r = V.reviews(spark, d).filter("business_id is not null").select("business_id")
    return reports.partition_report(r, "business_id", 10).select("layout", "n_items")


@R.query(with_views("select 10 as n_partition, count(*) as n_items, count(distinct business_id) as n_keys from reviews where business_id is not null", "reviews"))
def customized_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The layout by hash of the business: every business is in one partition."""
    return partition_report(spark, d).filter("layout = 'customized'").select("n_partition", "n_items", "n_keys")


@R.query()
def partition_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.partition_report(V.reviews(spark, d).filter("business_id is not null").select("business_id"), "business_id", 10)


_CITY = f"select city, {half_up_sql('avg(r.stars)', 2)} as stars from reviews r join businesses b using (business_id) where city is not null and r.stars is not null group by 1 order by stars desc, city"


@R.query(with_views(_CITY, "reviews", "businesses"))
def city_avg_stars(spark: SparkSession, d: str) -> DataFrame:
    return reports.city_average_stars(V.reviews(spark, d), V.businesses(spark, d))


@R.query(with_views(f"select * from ({_CITY}) order by stars desc, city limit 10", "reviews", "businesses"))
def top10_cities(spark: SparkSession, d: str) -> DataFrame:
    """The ten best cities through a bounded heap."""
    return reports.city_average_stars(V.reviews(spark, d), V.businesses(spark, d)).limit(10)


@R.query(with_views("select business_id, avg(rating) as average, count(*) as n from ratings group by 1", "ratings"))
def business_avg(spark: SparkSession, d: str) -> DataFrame:
    return V.ratings(spark, d).groupBy("business_id").agg(F.avg("rating").alias("average"), F.count("*").alias("n"))


@R.query(with_views("select user_id, avg(rating) as average, count(*) as n from ratings group by 1", "ratings"))
def user_avg(spark: SparkSession, d: str) -> DataFrame:
    return V.ratings(spark, d).groupBy("user_id").agg(F.avg("rating").alias("average"), F.count("*").alias("n"))


@R.query(with_views("select avg(rating) as average, count(*) as n from ratings", "ratings"))
def global_avg(spark: SparkSession, d: str) -> DataFrame:
    return V.ratings(spark, d).agg(F.avg("rating").alias("average"), F.count("*").alias("n"))

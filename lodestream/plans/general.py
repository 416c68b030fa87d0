"""Queries of the two general problems: hot keys (p5) and orphan references (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.ids import clean_id, clean_id_sql
from lodestream.functions.rounding import half_up, half_up_sql
from lodestream.operators import orphans as O
from lodestream.operators import skew
from lodestream.plans.registry import Registry
from lodestream.sources.tables import table

R = Registry()

#: Share of the rows from which a business counts as hot.
HOT_SHARE = 0.02

_BUSINESS, _USER = clean_id_sql("business_id"), clean_id_sql("user_id")


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    rating = F.col("rating")
    usable = F.when(rating.between(1.0, 5.0) & ~F.isnan(rating), rating)
    return table(spark, d, "yelp_train").select(clean_id("business_id").alias("business_id"), clean_id("user_id").alias("user_id"), usable.alias("rating")).filter(F.col("business_id").isNotNull())


@R.query(f"""
with t as (select {_BUSINESS} as business_id from yelp_train), c as (select business_id, count(*) as n from t where business_id is not null group by 1)
select business_id from c where n >= {HOT_SHARE} * (select sum(n) from c)""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Businesses holding at least 2 % of the rows that have a business id."""
    weighted = skew.compress(_ratings(spark, d), ["business_id"], "rating")
    rows = weighted.groupBy("business_id").agg(F.sum("weight").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total), F.col("n") >= F.lit(HOT_SHARE) * F.col("total")).select("business_id")


@R.query(f"""
with t as (select {_BUSINESS} as business_id, {_USER} as user_id, case when rating between 1 and 5 and not isnan(rating) then rating end as rating from yelp_train),
v as (select business_id, count(*) as rows, count(distinct user_id) as users, count(rating) as rated_rows, sum(rating) as s, quantile_disc(rating, 0.5) as median_rating
      from t where business_id is not null group by 1),
m as (select business_id, rating as mode_rating from (select business_id, rating, row_number() over (partition by business_id order by count(*) desc, rating) as k from t where business_id is not null and rating is not null group by 1, 2) where k = 1),
b as (select {_BUSINESS} as business_id, arg_max(review_count, coalesce(loaded_at, timestamp '0001-01-01')) filter (review_count is not null) as review_count from
      (select business_id, loaded_at, max(review_count) as review_count from business group by 1, 2) group by 1)
select v.business_id, v.rows, v.users, v.rated_rows, {half_up_sql("s / rated_rows", 4)} as mean_rating, median_rating, mode_rating, b.review_count::bigint as review_count
from v left join m using (business_id) left join b using (business_id)""")
def p5_per_business(spark: SparkSession, d: str) -> DataFrame:
    """Rows, users, mean, median and mode of the rating per business, beside the latest known review_count."""
    t = _ratings(spark, d)
    stats = skew.weighted_summary(skew.compress(t, ["business_id"], "rating"), ["business_id"])
    users = skew.distinct_per_key(t, ["business_id"], "user_id", "users")
    latest = F.max(F.when(F.col("review_count").isNotNull(), F.struct("loaded_at", "review_count")))["review_count"]
    told = table(spark, d, "business").select(clean_id("business_id").alias("business_id"), "loaded_at", "review_count").filter(F.col("business_id").isNotNull())
    told = told.groupBy("business_id").agg(latest.cast("long").alias("review_count"))
    return (
        stats.join(users, "business_id", "left")
        .join(told, "business_id", "left")
        .select("business_id", "rows", F.coalesce("users", F.lit(0)).alias("users"), F.col("rows_with_value").alias("rated_rows"), half_up(F.col("value_sum") / F.when(F.col("rows_with_value") > 0, F.col("rows_with_value")), 4).alias("mean_rating"), F.col("p50").alias("median_rating"), F.col("mode").alias("mode_rating"), "review_count")
    )


@R.query(f"""
with t as (select {_BUSINESS} as business_id, count(*) as n from yelp_train group by 1 having business_id is not null), s as (select sum(n) as total, count(*) as keys from t)
select share_class, count(*) as keys, sum(n)::bigint as rows from (select n, case when n >= 0.02 * total then 'hot' when n * keys >= total then 'above_mean' else 'below_mean' end as share_class from t, s) group by 1""")
def p5_share_classes(spark: SparkSession, d: str) -> DataFrame:
    """How the rows are spread over keys: keys at 2 % or more, other keys above the mean, and the rest."""
    rows = skew.compress(_ratings(spark, d), ["business_id"], "rating").groupBy("business_id").agg(F.sum("weight").alias("n"))
    total = rows.agg(F.sum("n").alias("total"), F.count("*").alias("keys"))
    kind = F.when(F.col("n") >= HOT_SHARE * F.col("total"), "hot").when(F.col("n") * F.col("keys") >= F.col("total"), "above_mean").otherwise("below_mean")
    return rows.join(F.broadcast(total), F.lit(True)).groupBy(kind.alias("share_class")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    to = {"user_id": "yelp_user", "business_id": "business"}
    refs = O.children(table(spark, d, "review_train"), "review_train", "review_id", to).unionByName(O.children(table(spark, d, "tip"), "tip", "tip_id", to))
    spans = O.parents(table(spark, d, "yelp_user"), "yelp_user", "user_id").unionByName(O.parents(table(spark, d, "business"), "business", "business_id"))
    return refs, spans


_REFS_SQL = f"""
with r as (select 'review_train' as table_name, review_id as row_id, user_id, business_id, loaded_at as seen_at from review_train union all select 'tip', tip_id, user_id, business_id, loaded_at from tip),
f as (select * from (select *, row_number() over (partition by table_name, row_id order by seen_at nulls last, user_id nulls first, business_id nulls first) as k from r where row_id is not null) where k = 1),
c as (select table_name, row_id, seen_at, 'user_id' as ref_field, 'yelp_user' as parent, {_USER} as ref_key from f union all select table_name, row_id, seen_at, 'business_id', 'business', {_BUSINESS} from f),
p as (select 'yelp_user' as parent, {_USER} as ref_key, loaded_at, deleted_at from yelp_user union all select 'business', {_BUSINESS}, loaded_at, deleted_at from business),
o as (select * from c where ref_key is not null and not exists (select 1 from p where p.parent = c.parent and p.ref_key = c.ref_key and p.loaded_at <= c.seen_at and (p.deleted_at is null or p.deleted_at > c.seen_at)))
"""


@R.query(_REFS_SQL + "select table_name, row_id, ref_field from o")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """References of first deliveries to users and businesses that are not live at loading time."""
    return O.orphans(*_references(spark, d)).select("table_name", "row_id", "ref_field")


@R.query(_REFS_SQL + """, k as (select *, case when exists (select 1 from p where p.parent = o.parent and p.ref_key = o.ref_key and p.loaded_at <= o.seen_at and (p.deleted_at is null or p.deleted_at > p.loaded_at)) then 'deleted'
 when exists (select 1 from p where p.parent = o.parent and p.ref_key = o.ref_key and p.loaded_at is not null and (p.deleted_at is null or p.deleted_at > p.loaded_at)) then 'later' else 'missing' end as kind from o)
select table_name, ref_field, kind, coalesce(strftime(date_trunc('week', seen_at), '%Y-%m-%d'), 'unknown') as period, count(*) as orphans, count(distinct ref_key) as keys from k group by 1, 2, 3, 4""")
def p7_orphans_per_week(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, reason and week of loading."""
    refs, spans = _references(spark, d)
    return O.orphan_counts(O.with_kind(O.orphans(refs, spans), spans), "week")



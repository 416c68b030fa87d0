"""Rating prediction: features, item-based filtering, models, hybrid, errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.rounding import half_up, half_up_sql
from lodestream.operators import features as X
from lodestream.operators import recommend as P
from lodestream.operators.pairs import basket_pairs
from lodestream.plans.registry import Registry
from lodestream.scratch import written
from lodestream.sources import views as V
from lodestream.sources.tables import table
from lodestream.sources.views import with_views

R = Registry()

#: Day at which memberships are measured.
AS_OF = "2016-02-01"


def _actual(spark: SparkSession, d: str) -> DataFrame:
    """The reviews' stars as ratings to predict."""
    return V.reviews(spark, d).filter("user_id is not null and business_id is not null and stars is not null").select("user_id", "business_id", F.col("stars").alias("rating"))


def _users(spark: SparkSession, d: str) -> DataFrame:
    return X.user_features(V.users(spark, d), AS_OF)


def _businesses(spark: SparkSession, d: str) -> DataFrame:
    return X.business_features(V.businesses(spark, d))


def _photos(spark: SparkSession, d: str) -> DataFrame:
    """Events as photos: there is no photo table, so an event's kind is the label and its user the business."""
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("business_id"), F.col("event_type").alias("label"))


def _checkins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("business_id"), F.from_json("props", "map<string,int>").alias("time"))


# ---- features --------------------------------------------------------------------------------------------------------

_RF = """r as (select business_id, avg(useful) as r_useful, avg(funny) as r_funny, avg(cool) as r_cool, count(*) as r_n from reviews where business_id is not null group by 1)"""


@R.query(with_views(f"with {_RF} select * from r", "reviews"))
def review_feature_avg(spark: SparkSession, d: str) -> DataFrame:
    return X.review_means(V.reviews(spark, d), ["business_id"], "r")


@R.query(with_views("select user_id, business_id, avg(stars) as p_stars, avg(useful) as p_useful, avg(funny) as p_funny, avg(cool) as p_cool, count(*) as p_n from reviews where user_id is not null and business_id is not null group by 1, 2", "reviews"))
def user_business_review_avg(spark: SparkSession, d: str) -> DataFrame:
    return X.review_means(V.reviews(spark, d), ["user_id", "business_id"], "p", X.PAIR_VALUES)


@R.query(with_views("select user_id, business_id, coalesce(sum(likes), 0)::bigint as likes, count(*) as tips from tips where user_id is not null and business_id is not null group by 1, 2", "tips"))
def tip_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.tip_statistics(V.tips(spark, d))


@R.query("select user_id::varchar as business_id, count(distinct event_type) as labels, count(*) as photos from events group by 1")
def photo_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.photo_statistics(_photos(spark, d))


@R.query("select user_id::varchar as business_id, sum(coalesce(list_sum(map_values(from_json(props, '\"MAP(VARCHAR,INTEGER)\"'))), 0))::bigint as checkins from events group by 1".replace("map_values(from_json(props, '\"MAP(VARCHAR,INTEGER)\"'))", "list_transform(json_keys(props), lambda k: cast(json_extract(props, k) as integer))"))
def checkin_totals(spark: SparkSession, d: str) -> DataFrame:
    return X.checkin_totals(_checkins(spark, d))


_PRICE = "coalesce(try_cast(regexp_replace(coalesce(attributes['RestaurantsPriceRange2'], ''), '[^0-9]', '', 'g') as integer), 0)"
_LISTED = "case when {0} is null or trim({0}) in ('', 'None') then 0 else len(string_split(trim({0}), ',')) end"
_BF = f"""bf as (select business_id, coalesce(stars, 3.5) as b_stars, coalesce(review_count, 0) as b_reviews, coalesce(is_open, 0) as b_open, coalesce(cardinality(attributes), 0)::int as num_attrs, ({_LISTED.format("categories")})::int as num_categories, {_PRICE} as price_range from businesses)"""
_UF = f"""uf as (select user_id, coalesce(average_stars, 3.5) as u_stars, coalesce(review_count, 0) as u_reviews, coalesce(fans, 0) as fans, coalesce(useful, 0) as u_useful, coalesce(funny, 0) as u_funny, coalesce(cool, 0) as u_cool, ({_LISTED.format("elite")})::int as num_elite, ({_LISTED.format("friends")})::int as num_friends,
 ({" + ".join(f"coalesce(compliment_{c}, 0)" for c in X.COMPLIMENTS)}) / 11.0::double as compliments, greatest(coalesce(date_diff('day', try_cast(substr(yelping_since, 1, 10) as date), date '{AS_OF}') / 365.25::double, 0.0::double), 0.0::double) as membership_years from users)"""


@R.query(with_views(f"with {_BF} select * from bf", "businesses"))
def business_features(spark: SparkSession, d: str) -> DataFrame:
    return _businesses(spark, d)


@R.query(with_views(f"with {_UF} select * from uf", "users"))
def user_features(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d)


def _c(name: str) -> str:
    return f"coalesce({name}::double, {X._DEFAULTS.get(name, 0.0)}::double)"


_TRAINED = {"u_stars": "coalesce(u_stars, user_mean, overall)", "b_stars": "coalesce(b_stars, business_mean, overall)"}


def _derived(c: Callable[[str], str], overall: str) -> dict[str, str]:
    return {
        "stars_product": f"{c('u_stars')} * {c('b_stars')}",
        "reviews_product": f"{c('u_reviews')} * {c('b_reviews')}",
        "useful_rate": f"{c('r_useful')} / ({c('r_n')} + 1)",
        "engagement": f"({c('u_useful')} + {c('u_funny')} + {c('u_cool')}) / ({c('u_reviews')} + 1)",
        "activity_match": f"least({c('u_reviews')}, {c('b_reviews')}) / (greatest({c('u_reviews')}, {c('b_reviews')}) + 1)",
        "u_bias": f"{c('u_stars')} - {overall}",
        "b_bias": f"{c('b_stars')} - {overall}",
    }


_ACTUAL = "actual as materialized (select user_id, business_id, max(stars) as rating from reviews where user_id is not null and business_id is not null and stars is not null group by 1, 2)"
_SIDES = """tf as (select user_id, business_id, sum(likes) as likes, count(*) as tips from tips where user_id is not null and business_id is not null group by 1, 2),
pf as (select user_id::varchar as business_id, count(distinct event_type) as labels, count(*) as photos from events group by 1),
cf as (select user_id::varchar as business_id, sum(coalesce(list_sum(list_transform(json_keys(props), lambda k: cast(json_extract(props, k) as integer))), 0)) as checkins from events group by 1)"""


_PAIR = "pr as (select user_id, business_id, avg(stars) as p_stars, avg(useful) as p_useful, avg(funny) as p_funny, avg(cool) as p_cool from reviews where user_id is not null and business_id is not null group by 1, 2)"
_MEANS = "tu as (select user_id, avg(rating) as user_mean from ratings group by 1), tb as (select business_id, avg(rating) as business_mean from ratings group by 1), o as (select avg(rating) as overall from ratings)"


def _features_sql(columns: list[str], trained: bool = False) -> str:
    c = lambda name: _TRAINED.get(name, _c(name)) if trained else _c(name)
    derived = _derived(c, "overall" if trained else "3.5::double")
    shown = ", ".join(f"{derived.get(f, c(f))} as {f}" for f in columns)
    joins = "left join uf using (user_id) left join bf using (business_id) left join r using (business_id) left join tf on tf.user_id = actual.user_id and tf.business_id = actual.business_id left join pr on pr.user_id = actual.user_id and pr.business_id = actual.business_id left join pf on pf.business_id = actual.business_id left join cf on cf.business_id = actual.business_id"
    joins += " left join tu on tu.user_id = actual.user_id left join tb on tb.business_id = actual.business_id cross join o"
    return with_views(f"with {_ACTUAL}, {_RF}, {_BF}, {_UF}, {_SIDES}, {_PAIR}, {_MEANS} select actual.user_id, actual.business_id, actual.rating, {shown} from actual {joins}", "reviews", "businesses", "users", "tips", "ratings")


#: Feature sets whose unknown sides take the averages of the training.
_TRAINED_SETS = (X.FEATURES_22, X.FEATURES_6)


def _assembled(spark: SparkSession, d: str, pairs: DataFrame, columns: list[str]) -> DataFrame:
    ratings = V.ratings(spark, d) if columns in _TRAINED_SETS else None
    return X.assemble(pairs, _users(spark, d), _businesses(spark, d), V.reviews(spark, d), columns, V.tips(spark, d), _photos(spark, d), _checkins(spark, d), ratings)


def _test_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_ratings(_actual(spark, d))


@R.query(_features_sql(X.FEATURES_8))
def features_8(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, _test_pairs(spark, d), X.FEATURES_8)


@R.query(_features_sql(X.FEATURES_6, True))
def features_6(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, _test_pairs(spark, d), X.FEATURES_6)


@R.query(_features_sql(X.FEATURES_22, True))
def features_22(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, _test_pairs(spark, d), X.FEATURES_22)


@R.query(_features_sql(X.FEATURES_21))
def features_21(spark: SparkSession, d: str) -> DataFrame:
    """The 25 features less the four that are dropped before training, which are never computed."""
    return _assembled(spark, d, _test_pairs(spark, d), X.FEATURES_21)


@R.query(_features_sql(X.FEATURES_25))
def features_25(spark: SparkSession, d: str) -> DataFrame:
    """All 25 features, with what the pair's own reviews say."""
    return _assembled(spark, d, _test_pairs(spark, d), X.FEATURES_25)


_SCALED = ("u_reviews", "fans", "b_reviews")


@R.query(with_views(f"with {_ACTUAL}, {_BF}, {_UF}, a as (select actual.user_id, actual.business_id, {', '.join(f'{_c(c)} as {c}' for c in _SCALED)} from actual left join uf using (user_id) left join bf using (business_id)), m as (select {', '.join(f'min({c}) as l_{c}, max({c}) as h_{c}' for c in _SCALED)} from a) select user_id, business_id, {', '.join(f'case when h_{c} > l_{c} then ({c} - l_{c}) / (h_{c} - l_{c}) else 0.0::double end as {c}' for c in _SCALED)} from a, m", "reviews", "businesses", "users"))
def minmax_scaled(spark: SparkSession, d: str) -> DataFrame:
    a = _assembled(spark, d, _test_pairs(spark, d).drop("rating"), list(_SCALED))
    return X.min_max(a, list(_SCALED))


# ---- item-based filtering --------------------------------------------------------------------------------------------

_RATED = "rated as materialized (select user_id, business_id, max(rating) as rating from ratings group by 1, 2)"
_BM = "bm as materialized (select business_id, avg(rating) as m from ratings group by 1)"
_UM = "um as materialized (select user_id, avg(rating) as m from ratings group by 1)"
_SUMS = """sums as materialized (select p.business_id as i, q.business_id as j, count(*) as n, sum(p.rating) as sx, sum(q.rating) as sy, sum(p.rating * q.rating) as sxy, sum(p.rating * p.rating) as sxx, sum(q.rating * q.rating) as syy, sum((5 - abs(p.rating - q.rating)) / 5) as near
 from rated p join rated q on p.user_id = q.user_id and p.business_id < q.business_id group by 1, 2)"""
_SPREAD = "((n * sxx - sx * sx) * (n * syy - sy * sy))"


def _sim_sql(penalties: str | None) -> str:
    few, two, pearson = "(5 - abs(a.m - b.m)) / 5", "near / 2", f"case when {_SPREAD} > 0 then (n * sxy - sx * sy) / sqrt({_SPREAD}) else 0.0::double end"
    if penalties is None:
        value = f"case when n <= 1 then {few} when n = 2 then {two} else {pearson} end"
    elif penalties == "hybrid":
        value = f"case when n <= 1 then {few} * 0.5::double when n = 2 then {two} * 0.7::double else ({pearson}) * least(1.0::double, n / 50.0::double) end"
    else:
        value = f"case when n <= 1 then {few} * 0.5::double else ({pearson}) * least(1.0::double, n / 30.0::double) end"
    return f"{half_up_sql(value, P.PLACES)}"


def _all_sims_sql(penalties: str | None) -> str:
    return with_views(f"with {_RATED}, {_BM}, {_SUMS} select i, j, n as common, {_sim_sql(penalties)} as similarity from sums join bm a on a.business_id = i join bm b on b.business_id = j", "ratings")


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = V.ratings(spark, d)
    return r, written(P.pair_ratings(r))


def _all_sims(spark: SparkSession, d: str, penalties: str | None) -> DataFrame:
    r, rated = _rated(spark, d)
    met = basket_pairs(rated.select(F.col("user_id").alias("s"), F.col("business_id").alias("i"))).select(F.col("a").alias("i"), F.col("b").alias("j")).distinct()
    return P.item_similarity(written(met), rated, r, penalties)


@R.query(_all_sims_sql(None))
def pearson_item_sim(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of all pairs of businesses with a common user."""
    return _all_sims(spark, d, None)


@R.query(_all_sims_sql("hybrid"))
def hybrid_item_sim(spark: SparkSession, d: str) -> DataFrame:
    return _all_sims(spark, d, "hybrid")


@R.query(_all_sims_sql("wide"))
def wide_item_sim(spark: SparkSession, d: str) -> DataFrame:
    return _all_sims(spark, d, "wide")


def _predict_sql(penalties: str | None, confidence: bool, k: int) -> str:
    value = "case when u.m is null then coalesce(b.m, o.m) when b.m is null then u.m else coalesce(w.weighted, u.m) end"
    if not confidence:
        value = f"coalesce(rated.rating, {value})"
    trust = f", {half_up_sql(f'case when u.m is null and b.m is null then 0.05::double when u.m is null or b.m is null or used is null then 0.1::double else least(0.6::double, used / {k}.0::double * mean_similarity) end', 6)} as confidence" if confidence else ""
    sims = f"sims as materialized (select t.user_id, t.business_id, r.business_id as other, r.rating, {_sim_sql(penalties).replace('case when n <= 1', 'case when n is null or n <= 1')} as s from test t join rated r on r.user_id = t.user_id and r.business_id <> t.business_id join bm a on a.business_id = least(t.business_id, r.business_id) join bm b on b.business_id = greatest(t.business_id, r.business_id) left join sums on i = least(t.business_id, r.business_id) and j = greatest(t.business_id, r.business_id))"
    return with_views(f"""with {_ACTUAL}, {_RATED}, {_BM}, {_UM}, {_SUMS}, test as (select user_id, business_id from actual), {sims},
k as (select *, row_number() over (partition by user_id, business_id order by s desc, other) as k from sims where s > 0),
w as (select user_id, business_id, sum(s * rating) / sum(abs(s)) as weighted, count(*) as used, avg(s) as mean_similarity from k where k <= {k} group by 1, 2), o as (select avg(rating) as m from ratings)
select t.user_id, t.business_id, {half_up_sql(f'least(greatest({value}, 1.0::double), 5.0::double)', 6)} as prediction{trust} from test t left join rated on rated.user_id = t.user_id and rated.business_id = t.business_id left join um u on u.user_id = t.user_id left join bm b on b.business_id = t.business_id left join w on w.user_id = t.user_id and w.business_id = t.business_id cross join o""", "ratings", "reviews")


def _predicted(spark: SparkSession, d: str, **how: object) -> DataFrame:
    return P.predict(_actual(spark, d), V.ratings(spark, d), **how)


@R.query(_predict_sql(None, False, 15))
def cf_predict(spark: SparkSession, d: str) -> DataFrame:
    """Stars of all reviews predicted from yelp_train."""
    return _predicted(spark, d).withColumn("prediction", half_up(F.col("prediction"), 6))


@R.query(_predict_sql("hybrid", True, 15))
def cf_predict_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, penalties="hybrid", confidence=True).withColumns({c: half_up(F.col(c), 6) for c in ("prediction", "confidence")})


@R.query(_predict_sql("wide", True, 12))
def cf_predict_wide(spark: SparkSession, d: str) -> DataFrame:
    """The variant with 12 neighbours and its own penalties."""
    return _predicted(spark, d, neighbours=12, penalties="wide", confidence=True).withColumns({c: half_up(F.col(c), 6) for c in ("prediction", "confidence")})


_ERRORS = f"e as (select prediction - rating as error from ({_predict_sql(None, False, 15)}) join (select user_id, business_id, max(case when stars between 1 and 5 and not isnan(stars) then stars end) as rating from ({with_views('select * from reviews', 'reviews')}) where user_id is not null and business_id is not null group by 1, 2 having rating is not null) using (user_id, business_id))"


def _cf_errors(spark: SparkSession, d: str) -> DataFrame:
    return P.with_error(cf_predict(spark, d), _actual(spark, d))


@R.query(f"with {_ERRORS} select count(error) as n, {half_up_sql('coalesce(sqrt(avg(error * error)), 0.0::double)', 6)} as rmse from e")
def rmse(spark: SparkSession, d: str) -> DataFrame:
    return P.rmse(_cf_errors(spark, d))


@R.query(f"with {_ERRORS}, b(k, bin) as (values (0, '[0,1)'), (1, '[1,2)'), (2, '[2,3)'), (3, '[3,4)'), (4, '[4,inf)')), c as (select floor(least(abs(error), 4))::int as k, count(*) as n from e group by 1) select bin, coalesce(n, 0) as n, {half_up_sql('coalesce(n, 0) / (select count(*) from e)::double', 6)} as share from b left join c using (k)")
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.error_histogram(_cf_errors(spark, d))


def _weights_sql(variant: str) -> str:
    base, up, down, bonus, top = P.WEIGHTS[variant]
    w = f"{base}::double * confidence"
    for count, (many, few) in (("user_count", P.ACTIVE_USER), ("business_count", P.ACTIVE_BUSINESS)):
        w = f"(case when {count} is null then {P.LEAST_WEIGHT}::double when {count} > {many} then {w} + {up}::double when {count} < {few} then {w} - {down}::double else {w} end)"
    high, low = P.EXTREME
    w = f"case when (user_mean > {high} or user_mean < {low}) and (business_mean > {high} or business_mean < {low}) then {w} + {bonus}::double else {w} end"
    trained = {k: f"(select {k}_id, count(distinct {other}_id) as {k}_count, avg(rating) as {k}_mean from ({with_views('select * from ratings', 'ratings')}) group by 1)" for k, other in (("user", "business"), ("business", "user"))}
    return f"with p as ({_predict_sql(*_WEIGHED[variant])}), u as {trained['user']}, b as {trained['business']} select p.user_id, p.business_id, {half_up_sql(f'least(greatest({w}, {P.LEAST_WEIGHT}::double), {top}::double)', 6)} as weight from p left join u using (user_id) left join b using (business_id)"


#: Penalties, confidence and neighbours of the prediction that each variant weighs.
_WEIGHED = {"standard": ("hybrid", True, 15), "narrow": ("wide", True, 12)}


def _weights(spark: SparkSession, d: str, variant: str) -> DataFrame:
    users, businesses = P.training_activity(V.ratings(spark, d))
    predicted = cf_predict_confidence if variant == "standard" else cf_predict_wide
    p = predicted(spark, d).join(users, "user_id", "left").join(businesses, "business_id", "left")
    return p.withColumn("weight", half_up(P.hybrid_weight(*[F.col(c) for c in ("confidence", "user_count", "business_count", "user_mean", "business_mean")], variant), 6))


@R.query(_weights_sql("standard"))
def hybrid_weight(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, "standard").select("user_id", "business_id", "weight")


@R.query(_weights_sql("narrow"))
def hybrid_weight_narrow(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, "narrow").select("user_id", "business_id", "weight")


# ---- models ----------------------------------------------------------------------------------------------------------


def _model(spark: SparkSession, d: str, columns: list[str], **how: object) -> DataFrame:
    """Trees trained on yelp_train's ratings, predicting all reviews."""
    train = written(_assembled(spark, d, P.pair_ratings(V.ratings(spark, d)), columns))
    test = written(_assembled(spark, d, _test_pairs(spark, d), columns))
    return X.boosted_trees(train, test, columns, **how)


@R.query()
def gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees over the 21 features, scaled."""
    return _model(spark, d, X.FEATURES_21, trees=20, scale=True).select("user_id", "business_id", "prediction")


@R.query()
def gbt_predict_8(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees over the 8 features."""
    return _model(spark, d, X.FEATURES_8, trees=55, depth=7).select("user_id", "business_id", "prediction")


@R.query()
def gbt_predict_6(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees over the 6 features."""
    return _model(spark, d, X.FEATURES_6, trees=20, depth=3).select("user_id", "business_id", "prediction")


@R.query()
def hybrid_predict(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhood and model predictions, blended by the dynamic weight."""
    model = _model(spark, d, X.FEATURES_22, trees=20).select("user_id", "business_id", F.col("prediction").alias("model"))
    both = _weights(spark, d, "standard").join(model, ["user_id", "business_id"])
    return both.select("user_id", "business_id", P.blend(F.col("weight"), F.col("prediction"), F.col("model")).alias("prediction"))


@R.query()
def model_rmse(spark: SparkSession, d: str) -> DataFrame:
    """Error of the boosted trees on the reviews' stars."""
    p = _model(spark, d, X.FEATURES_21, trees=20, scale=True).select("user_id", "business_id", "prediction")
    return P.rmse(P.with_error(p, _actual(spark, d)))

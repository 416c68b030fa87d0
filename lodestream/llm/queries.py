"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.ids import clean_id, clean_id_sql
from lodestream.llm import bitmaps, centroids, cooccur, forest, incidence, mixing, packing, prose, quotient
from lodestream.llm.tokens import VOCABULARY, token_count
from lodestream.plans.registry import Registry
from lodestream.scratch import written
from lodestream.sources.tables import table

R = Registry()

_USER, _BUSINESS = clean_id_sql("user_id"), clean_id_sql("business_id")

# ---- 1: distinct counts ----------------------------------------------------------------------------------------------

#: Relative standard error the bitmaps are sized for.
DISTINCT_ERROR = 0.01
_DIMS = ["day", "city", "channel"]
_CELLS = [["day"], ["day", "city"], ["day", "channel"], ["day", "city", "channel"]]
#: The report also has the cells over all days.
_REPORT_CELLS = [*_CELLS, ["city"], ["channel"], ["city", "channel"]]


def _visits(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a user; day, city and channel may be null."""
    t = table(spark, d, "stream_users")
    return t.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "city", "channel", clean_id("user_id").alias("user_id")).filter("user_id is not null")


@R.query(f"""
with v as (select strftime(ts, '%Y-%m-%d') as day, city, channel, {_USER} as user_id from stream_users),
r as (select * from v where user_id is not null and day is not null and city is not null and channel is not null),
c as (select day, coalesce(city, 'ALL') as city, coalesce(channel, 'ALL') as channel, count(*) as n, count(distinct user_id) as u from r
      group by grouping sets ((day), (day, city), (day, channel), (day, city, channel)))
select day, city, channel from c where n >= 20 and u * 4 < n""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of at least 20 rows with fewer different users than a quarter of the rows.

    The bitmaps decide all cells that are clear of the line; only those within six standard errors and two users of it
    (``p1_recounts`` tells how many) are counted exactly.
    """
    v, judged = _judged(spark, d)
    near = written(judged.filter("below is null").select("kind", *_DIMS, "rows"))
    clear = judged.filter("below").select(*_DIMS)
    exact = bitmaps.exact_cells(v, _DIMS, _CELLS, "user_id", near)
    return clear.unionByName(near.join(exact, ["kind", *_DIMS]).filter("ids * 4 < rows").select(*_DIMS))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(visits with all dimensions; their cells of at least 20 rows with ``below``, null where too near to tell)."""
    v = _visits(spark, d).filter("day is not null and city is not null and channel is not null")
    cells, _, _ = bitmaps.distinct_cells(v, _DIMS, _CELLS, "user_id", DISTINCT_ERROR)
    return v, written(bitmaps.below_share(cells.filter("rows >= 20"), 0.25))


@R.query()
def p1_recounts(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of cell: cells, those the bitmaps find below or above the line, and those to be counted exactly."""
    kind = F.get(F.array(*[F.lit(" x ".join(c)) for c in _CELLS]), F.col("kind"))
    counts = [F.count("*").alias("cells"), F.count_if(F.col("below")).alias("below"), F.count_if(~F.col("below")).alias("above"), F.count_if(F.col("below").isNull()).alias("recounted")]
    return _judged(spark, d)[1].groupBy(kind.alias("kind")).agg(*counts)


@R.query()
def p1_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """Estimated different users of every cell, with standard error and relative 95 % bound.

    Rows without a day, city or channel count in the cells that do not use it, and form a cell of their own (null) in
    the others.
    """
    return bitmaps.distinct_cells(_visits(spark, d), _DIMS, _REPORT_CELLS, "user_id", DISTINCT_ERROR)[0].drop("kind")


@R.query(f"""
with v as (select strftime(ts, '%Y-%m-%d') as day, city, channel, {_USER} as user_id from stream_users),
c as (select day, city, channel from v where user_id is not null group by grouping sets ((day), (day, city), (day, channel), (day, city, channel), (city), (channel), (city, channel)))
select count(*) as cells, 0::bigint as outside from c""")
def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the report against exact counts: how many there are, and how many are off by more than six standard
    errors and two users."""
    v = _visits(spark, d)
    cells = written(bitmaps.distinct_cells(v, _DIMS, _REPORT_CELLS, "user_id", DISTINCT_ERROR)[0])
    exact = bitmaps.exact_cells(v, _DIMS, _REPORT_CELLS, "user_id", cells).alias("e")
    both = cells.alias("c").join(exact, [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in ("kind", *_DIMS)], "left")
    off = F.abs(F.col("estimate") - F.col("ids")) > 6 * F.col("std_error") + 2
    return both.agg(F.count("*").alias("cells"), F.count_if(F.coalesce(off, F.lit(True))).alias("outside"))


# ---- 2: clusters of centroids ----------------------------------------------------------------------------------------

RADIUS = 6.0


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return centroids.cluster_records(table(spark, d, "cluster_stats"), RADIUS)


_NEAR_SQL = """
with e as (select stat_id, n, sum, row_number() over (partition by stat_id order by loaded_at nulls last, n, sum) as k from cluster_stats
  where stat_id is not null and n >= 1 and len(sum) = 8 and len(list_filter(sum, lambda x: x is not null and isfinite(x))) = 8),
v as materialized (select stat_id, n, list_transform(sum, lambda x: x / n) as c from e where k = 1),
p as (select a.stat_id, any_value(a.n) as n, min(b.stat_id) as near, count(*) as m from v a join v b on abs(a.c[1] - b.c[1]) <= 6 and abs(a.c[2] - b.c[2]) <= 6 and abs(a.c[3] - b.c[3]) <= 6 and list_distance(a.c, b.c) <= 6 group by 1)
"""


@R.query(_NEAR_SQL + "select stat_id, near as lead_id from p where m > 1")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose cluster has another record, with the smallest stat_id of the cluster."""
    c = written(_clusters(spark, d).select("stat_id", "lead_id"))
    several = c.groupBy("lead_id").agg(F.count("*").alias("k")).filter("k > 1").select("lead_id")
    return c.join(several, "lead_id", "left_semi").select("stat_id", "lead_id")


@R.query(_NEAR_SQL + "select near as lead_id, count(*) as records, sum(n)::bigint as points from p group by 1 having count(*) > 1")
def p2_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size in records and in points of every cluster of two or more."""
    c = _clusters(spark, d).groupBy("lead_id").agg(F.count("*").alias("records"), F.sum("n").alias("points"))
    return c.filter("records > 1")


@R.query()
def p2_cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """Size in records and points, spread, and the three most typical members of every cluster of two or more."""
    return centroids.describe(written(_clusters(spark, d))).filter("records > 1")


# ---- 3: similar user sets --------------------------------------------------------------------------------------------

SIMILAR, LEAST_USERS = 0.5, 5


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "yelp_train").select(clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id"))


_PAIRS_SQL = f"""
with t as materialized (select distinct {_USER} as u, {_BUSINESS} as b from yelp_train where {_USER} is not null and {_BUSINESS} is not null),
n as materialized (select b, count(*) as n from t group by 1),
o as materialized (select x.b as b1, y.b as b2, count(*) as c from t x join t y on x.u = y.u and x.b < y.b group by 1, 2)
"""


@R.query(_PAIRS_SQL + f"""select b1 as business_id_1, b2 as business_id_2 from o join n p on p.b = b1 join n q on q.b = b2
where p.n >= {LEAST_USERS} and q.n >= {LEAST_USERS} and c >= {SIMILAR} * (p.n + q.n - c)""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of businesses whose user sets have a Jaccard similarity of at least one half."""
    t = _train(spark, d)
    members = written(incidence.pairs(t, "business_id", "user_id"))
    links, copies = forest.similar_pairs(members, SIMILAR, LEAST_USERS)
    ids = incidence.names(t.filter("user_id is not null"), "business_id")
    return incidence.with_names(forest.expand(links, copies), ids, "s1", "s2", "business_id_1", "business_id_2")


# ---- 4: seen before --------------------------------------------------------------------------------------------------

#: Chances that a new key is taken for an old one: of p4_found's filter, and of the small one whose errors are measured.
SEEN_ERROR, SMALL_ERROR = 1e-8, 1e-3


@R.query(f"""
with s as (select seq, {_USER} as u from stream_users)
select seq from (select seq, row_number() over (partition by u order by seq) as k from s where u is not null) where k > 1""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose user came before, as the quotient filter answers; a new user is wrongly among them with a chance of
    at most ``SEEN_ERROR``."""
    t = table(spark, d, "stream_users").select("seq", clean_id("user_id").alias("user_id"))
    return quotient.seen_before(t, "seq", "user_id", SEEN_ERROR)[0]


@R.query()
def p4_error_report(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint bits, derived and measured rate of wrong answers, and bits per key of the merged filters, one row for
    each of two error rates asked for.

    The filters are built for the halves of the stream and merged, as they would be for successive days. The wrong
    answers are measured against the keys themselves.
    """
    t = table(spark, d, "stream_users").select("seq", clean_id("user_id").alias("user_id"))
    return _errors(t, SMALL_ERROR).unionByName(_errors(t, SEEN_ERROR))


def _errors(t: DataFrame, asked: float) -> DataFrame:
    seen, rows, p, n = quotient.seen_before(t, "seq", "user_id", asked)
    keys = rows.select("fp", "check").distinct().agg(F.count("*").alias("keys"))
    wrong = quotient.wrong_answers(rows, seen).agg(F.count("*").alias("wrong"))
    early, late = rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")
    both = quotient.merge_filters(quotient.filters(early, p, n), quotient.filters(late, p, n)).agg(F.sum("keys").alias("stored"), F.sum("bits").alias("bits"))
    one = keys.join(wrong).join(both)
    return one.select(F.lit(asked).alias("asked_rate"), F.lit(p).alias("fingerprint_bits"), F.lit(n).alias("rows"), "keys", "stored", "wrong", (F.col("keys") / F.lit(2.0 ** (p + 1))).alias("derived_rate"), (F.col("wrong") / F.col("keys")).alias("measured_rate"), (F.col("bits") / F.col("stored")).alias("bits_per_key"))


# ---- 6: items together -----------------------------------------------------------------------------------------------

LEAST_TOGETHER, LEAST_LIFT = 10, 5.0


@R.query(_PAIRS_SQL + f"""select b1 as business_id_1, b2 as business_id_2 from o join n p on p.b = b1 join n q on q.b = b2
where c >= {LEAST_TOGETHER} and c * (select count(distinct u) from t) >= {LEAST_LIFT} * p.n * q.n""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of businesses with at least ten common users and at least five times as many as by chance.

    Counts and lift decide which pairs these are, as the case is defined by them; they are rows of the scored output,
    each with its surprise.
    """
    return _together(spark, d, LEAST_TOGETHER, LEAST_LIFT).filter(f"common >= {LEAST_TOGETHER} and lift >= {LEAST_LIFT} and surprise is not null").select("business_id_1", "business_id_2")


def _together(spark: SparkSession, d: str, least: int, lift: float) -> DataFrame:
    t = _train(spark, d)
    scored, items = cooccur.scored_pairs(written(incidence.pairs(t, "user_id", "business_id")), least, lift)
    out = cooccur.discoveries(scored, math.comb(items, 2)).select("a", "b", "common", "lift", "expected", "surprise", "significant")
    return incidence.with_names(out, incidence.names(t.filter("user_id is not null"), "business_id"), "a", "b", "business_id_1", "business_id_2")


@R.query()
def p6_surprise(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with a common user: common users, lift, expected ones under the fitted null, surprise and significance."""
    return _together(spark, d, 1, 0.0)


# ---- 8: packing ------------------------------------------------------------------------------------------------------


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count("text", VOCABULARY).alias("tokens"))


@R.query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and position of every text or piece of a text, for each container size."""
    packs, tokens = table(spark, d, "pack_sizes"), written(_tokens(spark, d))
    return packing.pack(packing.pieces(tokens, packs), packing.group_counts(tokens, packs))


@R.query()
def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    """Space used per container size."""
    return packing.fill_report(p8_containers(spark, d), table(spark, d, "pack_sizes"))


# ---- 9: mixing -------------------------------------------------------------------------------------------------------


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", mixing.source_name("source").alias("source"), token_count("text", VOCABULARY).alias("tokens"), F.md5("text").alias("digest"))
    return mixing.mix(docs, table(spark, d, "mix_targets"))


@R.query()
def p9_draws(spark: SparkSession, d: str) -> DataFrame:
    """The drawn texts and how often each is used."""
    return _mix(spark, d)[0]


@R.query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every target source."""
    drawn, plan = _mix(spark, d)
    return mixing.shares(drawn, plan)


# ---- 10: prose -------------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return prose.label_documents(table(spark, d, "documents"))


@R.query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly list, table or junk."""
    return _labels(spark, d).filter(F.col("list") + F.col("table") + F.col("junk") > 0.5).select("doc_id")


@R.query()
def p10_label_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of prose, list, table and junk of every document."""
    return _labels(spark, d)


@R.query(r"""
with t as (select doc_id, lower(lang) as lang, coalesce(text, '') as text from documents),
w as (select doc_id, lang, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l, regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g') as c from t),
k as (select lower(lang) as lang, list(distinct lower(word)) as own from common_words group by 1), a as (select list(distinct lower(word)) as anyone from common_words)
select doc_id, len(w)::int as words, case when len(w) > 0 then list_sum(list_transform(w, lambda x: length(x)))::double / len(w) end as mean_word_length,
 case when length(c) > 0 then length(regexp_replace(c, '[\p{L}\p{N}]', '', 'g'))::double / length(c) end as symbol_ratio, len(l)::int as lines,
 case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.!?…]$')))::double / len(l) end as punctuated_lines,
 case when len(w) > 0 then len(list_filter(w, lambda x: list_contains(coalesce(own, anyone), regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))))::double / len(w) end as common_words
from w left join k using (lang) cross join a""")
def p10_text_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Word count, mean word length, symbol ratio, punctuated lines and common words per document."""
    return prose.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))

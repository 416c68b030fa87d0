"""Frequent itemsets and similar sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.rounding import half_up, half_up_sql
from lodestream.operators import itemsets as I
from lodestream.operators import minhash as M
from lodestream.operators.pairs import pair_counts
from lodestream.plans.registry import Registry
from lodestream.scratch import written
from lodestream.sources import readers
from lodestream.sources import sinks
from lodestream.sources import views as V
from lodestream.sources.tables import table
from lodestream.sources.views import bytes_modulo_sql, with_views

R = Registry()

#: Supports of the itemset queries: baskets of businesses per user, of users per business, of brands per order, of
#: products per day and customer.
BY_USER, BY_BUSINESS, BY_ORDER, BY_DAY = 30, 6, 60, 3


def _as_text(found: DataFrame) -> DataFrame:
    return found.select(F.size("items").alias("size"), F.array_join("items", "|").alias("items"), "support")


def _levels_sql(rows: str, support: int, k: int) -> str:
    """SQL of all frequent itemsets up to ``k`` items over ``rows`` (distinct s, i), level by level."""
    parts = [f"l as materialized ({rows})", f"f1 as materialized (select i as i1, count(*) as n from l group by 1 having count(*) >= {support})", "r as materialized (select * from l where i in (select i1 from f1))"]
    for size in range(2, k + 1):
        cols = [f"i{j}" for j in range(1, size + 1)]
        if size == 2:
            body = "from r t1 join r t2 on t1.s = t2.s and t1.i < t2.i"
            shown = "t1.i as i1, t2.i as i2"
        else:
            prefix = " and ".join(["true", *(f"p.i{j} = q.i{j}" for j in range(1, size - 1))])
            cand = f"(select {', '.join(f'p.i{j} as i{j}' for j in range(1, size))}, q.i{size - 1} as i{size} from f{size - 1} p join f{size - 1} q on {prefix} and p.i{size - 1} < q.i{size - 1})"
            body = f"from {cand} c " + " ".join(f"join r t{j} on t{j}.i = c.i{j}" + ("" if j == 1 else f" and t{j}.s = t1.s") for j in range(1, size + 1))
            shown = ", ".join(f"c.{c}" for c in cols)
        parts.append(f"f{size} as materialized (select {shown}, count(*) as n {body} group by {', '.join(map(str, range(1, size + 1)))} having count(*) >= {support})")
    outs = [f"select {size} as size, {' || chr(124) || '.join(f'i{j}' for j in range(1, size + 1))} as items, n as support from f{size}" for size in range(1, k + 1)]
    return "with " + ", ".join(parts) + " " + " union all ".join(outs)


_ROWS_USER = "select user_id as s, business_id as i from pairs"
_ROWS_ORDER = "select distinct l_orderkey as s, p_brand as i from lineitem join part on l_partkey = p_partkey"
_ROWS_DAY = "select distinct strftime(o_orderdate, '%-m/%-d/%y') || '-' || o_custkey as s, l_partkey::varchar as i from lineitem join orders on l_orderkey = o_orderkey"


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    return I.baskets(V.mentions(spark, d), "user_id", "business_id", support=BY_USER)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders (s) and brands (i) of the lines, as often as they occur."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("s"), F.col("p_brand").alias("i")).filter("s is not null and i is not null")


def _by_order(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).distinct()


@R.query(with_views(f"select business_id as items, count(*) as support from pairs group by 1 having count(*) >= {BY_USER}", "pairs"))
def freq_items(spark: SparkSession, d: str) -> DataFrame:
    return I.frequent_items(_by_user(spark, d), BY_USER).select(F.col("items")[0].alias("items"), "support")


@R.query(_levels_sql(_ROWS_ORDER, BY_ORDER, 2))
def freq_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _as_text(I.frequent_itemsets(_by_order(spark, d), BY_ORDER, 2))


@R.query(_levels_sql(_ROWS_ORDER, BY_ORDER, 3))
def freq_triples(spark: SparkSession, d: str) -> DataFrame:
    return _as_text(I.frequent_itemsets(_by_order(spark, d), BY_ORDER, 3))


@R.query(with_views(_levels_sql(_ROWS_USER, BY_USER, 5), "pairs"))
def son_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """All frequent sets of businesses over the users' baskets."""
    return _as_text(I.frequent_itemsets(_by_user(spark, d), BY_USER))


@R.query(with_views(_levels_sql(_ROWS_USER, BY_USER, 5), "pairs"))
def fpgrowth_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _as_text(I.fp_growth(_by_user(spark, d), BY_USER))


@R.query(with_views(_levels_sql("select business_id as s, user_id as i from pairs", BY_BUSINESS, 6), "pairs"))
def son_itemsets_case2(spark: SparkSession, d: str) -> DataFrame:
    """All frequent sets of users over the businesses' baskets."""
    return _as_text(I.frequent_itemsets(I.baskets(V.mentions(spark, d), "business_id", "user_id", support=BY_BUSINESS), BY_BUSINESS))


@R.query(_ROWS_DAY.replace(" as s,", " as date_customer,").replace(" as i ", " as product "))
def date_customer_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Products per day and customer, keyed like ``1/31/96-17``."""
    return _by_day(spark, d).select(F.col("s").alias("date_customer"), F.col("i").alias("product"))


def _by_day(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = t.select(F.date_format("o_orderdate", "M/d/yyyy").alias("day"), F.col("o_custkey").cast("string").alias("customer"), F.col("l_partkey").cast("string").alias("product"))
    return I.baskets(readers.baskets_by_day(text), "date_customer", "product")


@R.query(_levels_sql(f"select * from (with x as ({_ROWS_DAY}) select * from x where s in (select s from x group by 1 having count(*) > 3))", BY_DAY, 3))
def son_date_customer(spark: SparkSession, d: str) -> DataFrame:
    """Frequent products over the baskets of a day and customer with more than three products."""
    rows = _by_day(spark, d)
    big = rows.groupBy("s").agg(F.count("*").alias("k")).filter("k > 3").select("s")
    return _as_text(I.frequent_itemsets(rows.join(big, "s", "left_semi"), BY_DAY))


_NUMBER = "coalesce(try_cast(i as bigint), " + bytes_modulo_sql("i") + ")"


@R.query(f"""with l as materialized ({_ROWS_ORDER}), h as materialized (select i, {_NUMBER} as x from (select distinct i from l)), r as materialized (select * from l join h using (i))
select xor(p.x, q.x) % {I.BUCKETS} as bucket, count(*) as n from r p join r q on p.s = q.s and p.i < q.i group by 1""")
def pcy_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per hash bucket over the brands of an order."""
    return I.bucket_counts(_lines(spark, d))


@R.query(f"with f as ({_levels_sql(_ROWS_ORDER, BY_ORDER, 2)}) select items, support from f where size = 2")
def pcy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Frequent pairs of brands by the two passes with the bucket filter."""
    return I.pcy_pairs(_lines(spark, d), BY_ORDER).select(F.array_join("items", "|").alias("items"), "support")


def _sections_sql(rows: str, support: int, k: int) -> str:
    """The itemset report: candidates up to ``k + 1`` items made from the frequent sets, then these."""
    levels = _levels_sql(rows, support, k).partition(" select 1 as size")[0]
    quoted = lambda cols: "'(' || " + " || ', ' || ".join(f"chr(39) || {c} || chr(39)" for c in cols) + " || ')'"
    parts, outs = [], ["select 1 as section, 0 as size, 'Candidates:' as value", "select 2, 0, 'Frequent Itemsets:'"]
    for size in range(1, k + 2):
        cols = [f"i{j}" for j in range(1, size + 1)]
        if size == 1:
            parts.append("c1 as (select i1 from f1)")
        else:
            prefix = " and ".join(["true", *(f"p.i{j} = q.i{j}" for j in range(1, size - 1))])
            shown = ", ".join([*(f"p.i{j} as i{j}" for j in range(1, size)), f"q.i{size - 1} as i{size}"])
            subsets = " and ".join(["true", *(f"exists (select 1 from f{size - 1} z where " + " and ".join(f"z.i{m} = y.{c}" for m, c in enumerate([x for x in cols if x != f"i{drop}"], 1)) + ")" for drop in range(1, size - 1))])
            parts.append(f"c{size} as (select * from (select {shown} from f{size - 1} p join f{size - 1} q on {prefix} and p.i{size - 1} < q.i{size - 1}) y where {subsets})")
        for section, name in ((1, f"c{size}"), (2, f"f{size}")):
            if size <= k or section == 1:
                outs.append(f"select {section}, {size}, string_agg({quoted(cols)}, ',' order by {', '.join(cols)}) from {name} having count(*) > 0")
    return levels + ", " + ", ".join(parts) + " " + " union all ".join(outs)


@R.query(with_views(_sections_sql(_ROWS_USER, BY_USER, 5), "pairs"))
def itemset_sections(spark: SparkSession, d: str) -> DataFrame:
    """The whole report: candidates and frequent itemsets under their headings, one line per size."""
    found = written(I.frequent_itemsets(_by_user(spark, d), BY_USER))
    return sinks.itemset_sections(I.tried_sets(found), found)


@R.query(f"select size, value from ({with_views(_sections_sql(_ROWS_USER, BY_USER, 5), 'pairs')}) where section = 2 and size > 0")
def itemset_report(spark: SparkSession, d: str) -> DataFrame:
    """The frequent itemsets as report lines, one per size."""
    return sinks.itemset_lines(I.frequent_itemsets(_by_user(spark, d), BY_USER))


# ---- similar sets ----------------------------------------------------------------------------------------------------

THRESHOLD = 0.5
_INDEX = "idx as materialized (select user_id, row_number() over (order by user_id) - 1 as x from (select distinct user_id from pairs))"
_SIM = half_up_sql("common / (na + nb - common)::double", 6)


def _members(spark: SparkSession, d: str) -> DataFrame:
    p = V.pairs(spark, d)
    return written(p.join(M.dense_index(p, "user_id", "x"), "user_id").select(F.col("business_id").alias("s"), "x"))


def _params_sql() -> str:
    return "h(k, a, b) as (values " + ", ".join(f"({k}, {a}::bigint, {b}::bigint)" for k, (a, b) in enumerate(M.hash_parameters())) + ")"


_MEMBERS_SQL = f"{_INDEX}, m as materialized (select business_id as s, x from pairs join idx using (user_id))"
_SIG_SQL = f"{_MEMBERS_SQL}, {_params_sql()}, g as materialized (select s, k, min((a * x + b) % {M.PRIME}) as v from m, h group by 1, 2)"
_JACCARD_SQL = f"o as materialized (select p.s as a, q.s as b, count(*) as common from m p join m q on p.x = q.x and p.s < q.s group by 1, 2), n as materialized (select s, count(*) as n from m group by 1), j as materialized (select a, b, common, p.n as na, q.n as nb from o join n p on p.s = a join n q on q.s = b)"
_BANDS_SQL = f"{_SIG_SQL}, bands as materialized (select s, k // {M.ROWS} as band, string_agg(v::varchar, ',' order by k) as part from g group by 1, 2), c as materialized (select distinct p.s as a, q.s as b from bands p join bands q on p.band = q.band and p.part = q.part and p.s < q.s)"


@R.query(with_views(f"with {_SIG_SQL} select s as business_id, string_agg(v::varchar, ',' order by k) as signature from g group by 1", "pairs"))
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return M.signatures(_members(spark, d)).select(F.col("s").alias("business_id"), F.array_join("sig", ",").alias("signature"))


@R.query(with_views(f"with {_BANDS_SQL} select a as business_id_1, b as business_id_2 from c", "pairs"))
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return M.band_pairs(M.signatures(_members(spark, d))).select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"))


@R.query(with_views(f"with {_BANDS_SQL}, {_JACCARD_SQL} select a as business_id_1, b as business_id_2, {_SIM} as similarity from c join j using (a, b) where common >= {THRESHOLD} * (na + nb - common)", "pairs"))
def lsh_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = M.similar_pairs(_members(spark, d), THRESHOLD)
    return found.select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), half_up(F.col("similarity"), 6).alias("similarity"))


@R.query(with_views(f"with {_MEMBERS_SQL}, {_JACCARD_SQL} select a as business_id_1, b as business_id_2, {_SIM} as similarity from j where common >= {THRESHOLD} * (na + nb - common)", "pairs"))
def jaccard_exact(spark: SparkSession, d: str) -> DataFrame:
    """All pairs at the threshold through the shared users, without sketches."""
    m = _members(spark, d)
    shared = pair_counts(m.select(F.col("x").alias("s"), F.col("s").alias("i")), 1)
    n = m.groupBy("s").agg(F.count("*").alias("n"))
    both = shared.join(n.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.filter(F.col("common") >= THRESHOLD * union).select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), half_up(F.col("common") / union, 6).alias("similarity"))

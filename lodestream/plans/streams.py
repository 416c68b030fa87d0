"""Stream sketches over stream_users, in order of seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import sketches as S
from lodestream.operators.prefix import prefix_sums
from lodestream.plans.registry import Registry
from lodestream.scratch import new_path
from lodestream.sources import views as V
from lodestream.sources.views import bytes_modulo_sql, with_views
from lodestream.streaming import sketches as T
from lodestream.streaming import sources, windows

R = Registry()
BATCH, SMALL_BITS = 1_000, 9_973

_HORNER = bytes_modulo_sql("user_id")


def _bloom_sql(bits: int, size: int) -> str:
    params = ", ".join(f"({a}::bigint, {b}::bigint)" for a, b in zip(S.BLOOM_A, S.BLOOM_B, strict=True))
    return with_views(f"""with w as materialized (select user_id, min(seq) as first, {_HORNER} as x from stream group by user_id),
p as materialized (select user_id, first, ((a * x + b) % {S.PRIME}) % {bits} as bit from w, (values {params}) h(a, b)), s as (select bit, min(first) as set_at from p group by 1),
r as (select user_id, first, max(set_at) as ready from p join s using (bit) group by 1, 2), e as (select (seq - 1) // {size} as batch, ready < seq and not first < seq as wrong from stream join r using (user_id))
select batch, count(*) as n, count(*) filter (wrong) as false_positives, count(*) filter (wrong) / count(*)::double as fpr from e group by 1""", "stream")


@R.query(_bloom_sql(S.BLOOM_BITS, BATCH))
def bloom_fpr_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return S.bloom_false_positive_rate(V.stream(spark, d), BATCH)


@R.query(_bloom_sql(SMALL_BITS, BATCH))
def bloom_fpr_small(spark: SparkSession, d: str) -> DataFrame:
    """A filter too small for its stream, so that it errs often."""
    return S.bloom_false_positive_rate(V.stream(spark, d), BATCH, SMALL_BITS)


def _fm_sql() -> str:
    params = ", ".join(f"({k}, {a}::bigint, {b}::bigint)" for k, (a, b) in enumerate(zip(S.FM_A, S.FM_B, strict=True)))
    return f"""d as materialized (select (seq - 1) // {BATCH} as batch, user_id, {_HORNER} as x from (select distinct (seq - 1) // {BATCH} * {BATCH} + 1 as seq, user_id from stream)),
h as (select batch, k, max(case when v = 0 then 0 else length(bin(v)) - length(rtrim(bin(v), '0')) end) as r from (select batch, k, (a * x + b) % {S.PRIME} as v from d, (values {params}) p(k, a, b)) group by 1, 2),
m as (select batch, k // {S.FM_GROUP} as g, avg(pow(2.0::double, r)) as m from h group by 1, 2), f as (select batch, floor(quantile_cont(m, 0.5))::bigint as estimate from m group by 1), t as (select batch, count(*) as truth from d group by 1),
e as (select batch, truth, estimate from f join t using (batch))"""


@R.query(with_views(f"with {_fm_sql()} select * from e", "stream"))
def fm_estimate_by_batch(spark: SparkSession, d: str) -> DataFrame:
    return S.fm_estimates(V.stream(spark, d), BATCH)


@R.query(with_views(f"with {_fm_sql()} select sum(estimate)::bigint as estimates, sum(truth)::bigint as truths, sum(estimate) / sum(truth)::double as ratio from e", "stream"))
def fm_ratio(spark: SparkSession, d: str) -> DataFrame:
    return S.fm_ratio(S.fm_estimates(V.stream(spark, d), BATCH))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    one = V.stream(spark, d).select("seq", "user_id").withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(one, [], ["seq"], "_one", "n").select("n", "user_id")


def _coin(salt: int) -> str:
    return f"((((n * 2654435761 + {salt * 40503}) % 4294967296) * 69069 + 1) % 4294967296) / 4294967296.0::double"


_SLOTS = (0, 20, 40, 60, 80)


@R.query(with_views(f"""with q as materialized (select row_number() over (order by seq) as n, user_id from stream), t as (select *, case when n <= 100 then n - 1 else floor({_coin(2)} * 100)::bigint end as slot from q where n <= 100 or {_coin(1)} < 100.0::double / n),
s as (select n, {", ".join(f"case when slot = {s} then user_id end as s{s}" for s in _SLOTS)} from t), a as (select q.n, {", ".join(f"last_value(s{s} ignore nulls) over (order by q.n) as s{s}" for s in _SLOTS)} from q left join s using (n))
select n, {", ".join(f"s{s}" for s in _SLOTS)} from a where n % 100 = 0""", "stream"))
def reservoir_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return S.reservoir_snapshots(_dense(spark, d), 100, 100, _SLOTS)


@R.query(with_views(f"select k.n as draw, q.user_id from (select unnest(range(1, 1001)) as n) k, (select row_number() over (order by seq) as n, user_id, count(*) over () as c from stream) q where q.n = floor({_coin(3).replace('(n *', '(k.n *')} * c)::bigint + 1", "stream"))
def stream_draws(spark: SparkSession, d: str) -> DataFrame:
    """A thousand elements drawn with replacement."""
    return S.ask(_dense(spark, d), 1_000)


def _replay(spark: SparkSession, d: str) -> DataFrame:
    """The stored stream as one of Structured Streaming. A pattern finds the table as a folder and as a single file."""
    return sources.replay(spark, f"{d}/stream_users.parque[t]")


@R.query(with_views(f"with {_fm_sql()} select batch, estimate from e", "stream"))
def streaming_fm_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The estimates from registers kept as a streaming aggregate."""
    return T.fm_estimate(sources.drain(T.fm_registers(_replay(spark, d), BATCH), "complete"))


@R.query(with_views("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, city, count(*) as rows from stream where ts is not null group by 1, 2", "stream"))
def streaming_daily_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows per event-time window of a day and city, in one go, so that none is late."""
    out = sources.drain(windows.windowed_users(_replay(spark, d), "1 day", "7 days"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "city", "rows")


@R.query(_bloom_sql(S.BLOOM_BITS, BATCH))
def streaming_bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    """The Bloom filter's false positives when its state goes from micro-batch to micro-batch, four of them."""
    t = V.stream(spark, d).select("seq", "user_id", "ts", F.lit(None).cast("timestamp_ntz").alias("arrived_at"), "city", "channel")
    folder, out = new_path(spark), new_path(spark)
    low, high = t.agg(F.min("seq"), F.max("seq")).first()
    if low is not None:
        sources.write_blocks(t, folder, -(-high // 4))
        state = T.BloomState(new_path(spark), truth=True)
        answers = state.handler(lambda a, k: a.write.mode("overwrite").parquet(f"{out}/b={k}"))
        sources.replay(spark, folder).writeStream.option("checkpointLocation", new_path(spark)).foreachBatch(answers).trigger(availableNow=True).start().awaitTermination()
    said = spark.read.schema("seq long, user_id string, maybe_seen boolean, seen boolean").parquet(out) if low is not None else spark.createDataFrame([], "seq long, user_id string, maybe_seen boolean, seen boolean")
    return S.false_positive_rate(said, BATCH)


@R.query(with_views("select strftime(ts, '%Y-%m-%d') as day, count(distinct user_id) as users from stream where ts is not null group by 1", "stream"))
def users_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct users per day, beside which the sketches are judged."""
    return V.stream(spark, d).filter("ts is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("users"))

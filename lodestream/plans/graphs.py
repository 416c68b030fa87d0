"""Graphs of businesses that share users, and clustering of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.rounding import half_up, half_up_sql
from lodestream.operators import clustering as C
from lodestream.operators import graph as G
from lodestream.operators.components import connected_components
from lodestream.operators.itemsets import baskets
from lodestream.plans.registry import Registry
from lodestream.scratch import written
from lodestream.sources import sinks
from lodestream.sources import views as V
from lodestream.sources.views import with_views

R = Registry()

#: Common users that make an edge; clusters of points.
SHARED, K = 20, 10


def _edges(spark: SparkSession, d: str, least: int = SHARED) -> DataFrame:
    return written(G.shared_edges(baskets(V.mentions(spark, d), "user_id", "business_id", support=least), least))


def _edges_sql(least: int = SHARED) -> str:
    return f"e as materialized (select p.business_id as a, q.business_id as b, count(*) as common from pairs p join pairs q on p.user_id = q.user_id and p.business_id < q.business_id group by 1, 2 having count(*) >= {least}), l as materialized (select a as u, b as v from e union all select b, a from e)"


@R.query(with_views(f"with {_edges_sql()} select a, b, common from e", "pairs"))
def coreview_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@R.query(with_views(f"with {_edges_sql()} select u as id, count(*) as degree from l group by 1", "pairs"))
def degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


def _lpa_sql() -> str:
    parts = ["l0 as (select distinct u as id, u as label from l)"]
    for k in range(1, 6):
        parts.append(f"l{k} as materialized (select u as id, label from (select u, label, row_number() over (partition by u order by count(*) desc, label) as r from l join l{k - 1} on v = id group by 1, 2) where r = 1)")
    return f"with {_edges_sql()}, " + ", ".join(parts) + " select id, label from l5"


@R.query(with_views(_lpa_sql(), "pairs"))
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(_edges(spark, d))


@R.query(with_views(_lpa_sql().replace("select id, label from l5", "select string_agg('''' || id || '''', ', ' order by id) as value from l5 group by label"), "pairs"))
def label_communities(spark: SparkSession, d: str) -> DataFrame:
    """One line per community."""
    return sinks.community_lines(G.groups(G.label_propagation(_edges(spark, d)), "label"))


_CC = "c as (with recursive r(id, root) as (select distinct u, u from l union select l.v, r.root from r join l on l.u = r.id) select id, min(root) as component from r group by 1)"


@R.query(with_views(f"with {_edges_sql()}, {_CC} select id, component from c", "pairs"))
def connected_groups(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_edges(spark, d), "a", "b")


@R.query(with_views(f"""with {_edges_sql()}, {_CC}, k as (select u as id, count(*) as degree from l group by 1), m as (select count(*) as m from e), i as (select count(*) as x from e join c p on p.id = a join c q on q.id = b where p.component = q.component),
s as (select sum((s * s - q) / 2.0::double) as y from (select component, sum(degree)::double as s, sum(degree * degree)::double as q from c join k using (id) group by 1))
select {half_up_sql('(x - y / (2 * m)) / (2 * m)', 9)} as modularity from i, s, m""", "pairs"))
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the split into connected groups."""
    e = _edges(spark, d)
    split = connected_components(e, "a", "b").withColumnRenamed("component", "community")
    return G.modularity(split, e, e).select(half_up(F.col("modularity"), 9).alias("modularity"))


def _betweenness_sql(levels: int = 12) -> str:
    """Shares of shortest paths by breadth-first levels from all roots, for graphs of at most ``levels`` levels."""
    parts = ["n0 as materialized (select distinct u as root, u as node, 1.0::double as ways from l)"]
    for k in range(1, levels + 1):
        known = f"not exists (select 1 from n{k - 1} x where x.root = p.root and x.node = l.v)" + (f" and not exists (select 1 from n{k - 2} x where x.root = p.root and x.node = l.v)" if k > 1 else "")
        parts.append(f"n{k} as materialized (select p.root, l.v as node, sum(p.ways) as ways from n{k - 1} p join l on l.u = p.node where {known} group by 1, 2)")
    parts.append(f"c{levels} as materialized (select root, node, 1.0::double as credit from n{levels})")
    for k in range(levels, 0, -1):
        parts.append(f"x{k} as materialized (select n.root, n.node, p.node as parent, c.credit * p.ways / n.ways as x from n{k} n join c{k} c on c.root = n.root and c.node = n.node join l on l.u = n.node join n{k - 1} p on p.root = n.root and p.node = l.v)")
        parts.append(f"c{k - 1} as materialized (select n.root, n.node, 1.0::double + coalesce(sum(x.x), 0.0::double) as credit from n{k - 1} n left join x{k} x on x.root = n.root and x.parent = n.node group by 1, 2)")
    every = " union all ".join(f"select node, parent, x from x{k}" for k in range(1, levels + 1))
    return f"with {_edges_sql()}, {', '.join(parts)}, w as (select least(node, parent) as a, greatest(node, parent) as b, {half_up_sql(f'sum(x) / 2 + {sinks.NOISE}::double', 5)} as betweenness from ({every}) group by 1, 2)"


@R.query(with_views(f"{_betweenness_sql()} select a, b, betweenness from w", "pairs"))
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    b = G.betweenness(_edges(spark, d))
    return b.select("a", "b", half_up(F.col("betweenness") + sinks.NOISE, 5).alias("betweenness"))


@R.query(with_views(f"{_betweenness_sql()} select '(' || chr(39) || a || chr(39) || ', ' || chr(39) || b || chr(39) || '), ' || betweenness as value from w", "pairs"))
def betweenness_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.betweenness_lines(G.betweenness(_edges(spark, d)))


@R.query()
def girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    return G.girvan_newman(_edges(spark, d))


# ---- clustering of points --------------------------------------------------------------------------------------------


@R.query(with_views(f"""with f as (select label::bigint as cluster, unnest(features) as x, generate_subscripts(features, 1) as j from points), s as (select cluster, j, count(*) as n, sum(x) as s, sum(x * x) as q from f group by 1, 2)
select cluster, n, j::int as j, {half_up_sql('s', 6)} as s, {half_up_sql('q', 6)} as q from s""", "points"))
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the labelled groups, one row per dimension."""
    s = C.summaries(V.points(spark, d).withColumn("cluster", F.col("label").cast("long")))
    flat = s.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("j", "v"))
    return flat.select("cluster", "n", (F.col("j") + 1).alias("j"), half_up(F.col("v.sum"), 6).alias("s"), half_up(F.col("v.sumsq"), 6).alias("q"))


_NEAREST = """with f as materialized (select id, label as cluster, unnest(features) as x, generate_subscripts(features, 1) as j from points), s as materialized (select cluster, j, avg(x) as c, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) as sd from f group by 1, 2),
d as (select f.id, s.cluster, sqrt(sum(((x - c) / sd) * ((x - c) / sd))) as d from f join s using (j) where sd > 1e-12 group by 1, 2)"""
_NEAREST_END = "select id, case when min(d) < 16 then arg_min(cluster, d) end::bigint as cluster from d group by 1"


@R.query(with_views(f"{_NEAREST} {_NEAREST_END}", "points"))
def mahalanobis_assign(spark: SparkSession, d: str) -> DataFrame:
    """Points to the nearest labelled group within two standard deviations a dimension."""
    import numpy as np

    pts = V.points(spark, d)
    rows = C.summaries(pts.withColumn("cluster", F.col("label").cast("long"))).orderBy("cluster").collect()  # one row per label
    summary = C.Summaries(len(rows[0]["sum"]))
    for r in rows:
        summary.add(r["n"], np.array(r["sum"]), np.array(r["sumsq"]))
    names = F.array(*[F.lit(r["cluster"]) for r in rows])
    return C.nearest(pts, summary, C.BOUND * len(rows[0]["sum"]) ** 0.5).select("id", F.get(names, F.col("cluster").cast("int")).alias("cluster"))


_ASSIGNED = "z as (select cluster, label, count(*) as n from a join points using (id) where cluster is not null group by 1, 2), m as (select cluster, label, n, size from (select *, sum(n) over (partition by cluster)::bigint as size, row_number() over (partition by cluster order by n desc, label) as k from z) where k = 1)"


@R.query(with_views(_NEAREST + f", a as materialized ({_NEAREST_END}), {_ASSIGNED} select cluster, label, n, size from m", "points"))
def majority_labels(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent label of each cluster of :func:`mahalanobis_assign`, and how often."""
    return C.majority_labels(mahalanobis_assign(spark, d).filter("cluster is not null"), V.points(spark, d))


@R.query(with_views(_NEAREST + f", a as materialized ({_NEAREST_END}), {_ASSIGNED} select (select count(*) from a) as points, (select count(*) from a where cluster is not null) / (select count(*) from a)::double as covered, (select sum(n) / sum(size)::double from m) as accuracy", "points"))
def assignment_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of points assigned to a cluster, and of those whose label is their cluster's."""
    return C.accuracy(mahalanobis_assign(spark, d), V.points(spark, d))


@R.query()
def bfr_rounds(spark: SparkSession, d: str) -> DataFrame:
    return C.bfr(V.points(spark, d), K)[1]


@R.query()
def bfr_assignments(spark: SparkSession, d: str) -> DataFrame:
    return C.bfr(V.points(spark, d), K)[0]


@R.query()
def cluster_accuracy(spark: SparkSession, d: str) -> DataFrame:
    pts = V.points(spark, d)
    return C.accuracy(written(C.bfr(pts, K)[0]), pts)


@R.query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.k_means(V.points(spark, d), K).select("id", "cluster")

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import agree


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p5_found", "p7_found", "city_avg_stars"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["city_avg_stars", "review_report", "p5_found", "p5_per_business", "p7_found", "jaccard_exact", "cf_predict", "bloom_fpr_small", "reservoir_snapshots", "cluster_summary", "edge_betweenness", "itemset_sections", "pcy_bucket_counts", "features_22", "features_25", "hybrid_weight_narrow", "folder_inputs", "assignment_accuracy", "streaming_fm_estimates", "stream_draws"])
def test_query_equals_its_sql(spark, name):
    assert agree(spark, name) > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["city", "stars"]


def test_boosted_trees_have_the_sizes_of_the_survey(monkeypatch):
    from lodestream.plans import ratings as Q

    sizes = []
    monkeypatch.setattr(Q, "_model", lambda spark, d, columns, **how: sizes.append((len(columns), how.get("trees", 20), how.get("depth", 5))) or _Stop.now())
    for query in (Q.gbt_predict, Q.gbt_predict_8, Q.gbt_predict_6, Q.hybrid_predict, Q.model_rmse):
        with pytest.raises(_Stop):
            query(None, "")
    assert sizes == [(21, 20, 5), (8, 55, 7), (6, 20, 3), (22, 20, 5), (21, 20, 5)]


class _Stop(Exception):
    @classmethod
    def now(cls):
        raise cls

"""The driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from eventloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Of each kind of operator some; the others run alike.
COMPARED = [
    "sessions", "transition_network", "attention_network", "sequence_cooccurrence", "cooccurrence_jaccard", "cooccurrence_top", "cooccurrence_wide", "association_rules", "rule_pathways",
    "path_counts", "order_tests", "gram_pathways", "sequence_statistics", "macro_density", "predict_links", "predict_links_undirected", "evaluate_links", "link_pathways", "presence_patterns", "row_entropy",
    "stationary_distribution", "correlation_network", "rank_correlation_network", "concordance_network", "partial_correlation_of_three", "predictability_of_three", "order_correlations", "rank_statistic", "distinct_sequences", "distance_qgram", "distance_cosine",
    "network_strengths", "network_summary", "net_edge_betweenness", "network_paths", "network_betweenness", "network_edge_betweenness", "network_diffusion", "supplier_clustering", "katz_links", "higher_order_rules", "higher_order_network", "kgram_statistics", "mosaic_cells", "hypa_expected", "mixture_single", "concordance_of_prices", "near_sequences", "moderated_moments", "person_moments", "network_by_group", "network_between_users", "prediction_errors", "attention_network_time",
]
#: Queries without SQL whose result must hold something.
NOT_EMPTY = ["glasso_network", "ising_network", "mixed_network", "multilevel_lag_network", "multilevel_coefficients", "build_clusters", "cluster_network", "mixture_model", "mixture_covariates", "component_networks", "mosaic_permutation", "near_sequences_share", "moderated_network", "layered_association"]


def same(a, b):
    """Values alike: numbers to a relative 1e-6, all else equal."""
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", COMPARED)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    # rows in order of what is no number, then of numbers rounded
    key = lambda row: ([str(x) for x in row if not isinstance(x, float)], [round(x, 4) for x in row if isinstance(x, float)])
    want, got = sorted(found.fetchall(), key=key), sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert len(got) == len(want) > 0
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", NOT_EMPTY)
def test_queries_give_something(spark, name):
    assert not registry.QUERIES[name](spark, SF).isEmpty()

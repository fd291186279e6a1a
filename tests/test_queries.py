"""Queries against the SQL that states them, on the smallest tables."""

import duckdb
import pytest

from hyperweft.plans import more, queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = """scan_incidence incidence_mult hyperedge_lists clique_projection hypergraph_stats hyperedge_dedup_weighted nested_sample block_counts superedge_consolidate
decode_summary summary_cost degree_summary relabel_first_seen edge_clusters_from_summary khop_2 connected_components goodman_kruskal_tau mdl_cost tau_row_move merge_delta_cost
ppmi knn_hypergraph pareto_front hypervolume hdd_seeds upscale_seeds summary_roundtrip tuning_select resume_antijoin scalability_inputs random_clusters_equal""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(v) if type(v).__name__ in ("float", "Decimal") else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, con, name):
    df, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())

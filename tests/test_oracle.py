"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
#: One query for each step; the others differ from these in a column or a filter.
KEYS = ("c4_spikes", "c5_from_kept", "c6_clean", "k4_accel", "k6_turn", "g1_declared", "g3_gap", "g8_sub", "g9_short", "g10_breaks", "g10_optimal", "g10_optimal_features", "features_v1", "s5_stored_features", "features_v2", "t0_split", "t5_training_v1", "p1_matrix", "p2_correct", "p2_sequence", "p2_sequence_events", "p3_vote", "p4_fusion", "p5_names", "p6_time", "p7_metrics", "p7_pairs", "p7_time", "p9_radius", "p9_clusters", "p9_optics", "p9_nearest", "p9_spatial", "g4_stay", "g4_stay_trips", "a3_changes", "s9_pyramid", "s10_pyramid", "a5_trips", "a7_matrix", "a11_age", "a10_a12_splits", "rides_post", "rides_trips", "long_features_v1", "long_features_v2", "long_post")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("events", "customer", "lineitem"):
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return out


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    got = __spark_entry__.queries()[key](spark, SF).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[key]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

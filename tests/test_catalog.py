import pytest

from tests.oracle import differences
from vanewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, name):
    assert differences(spark, SF, catalog.QUERIES[name], catalog.ORACLE[name])[:3] == []


def test_queries_without_sql_are_the_known_ones():
    """Each of these has a test of its own in test_without_sql.py."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"t06_spaced_selection", "d18_offlog_candidates", "r01_causal_replay", "m01_logistic_votes", "m02_out_of_fold_thresholds", "m03_fold_comparison", "m05_final_fit", "m12_reconstruction_scores"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""Every query that has SQL gives what DuckDB gives for it."""

import check_oracles
import pytest

from wavelark.plans import registry

SQL, RUN = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con(data):
    return check_oracles.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, data, name):
    assert check_oracles.compare(spark, con, RUN[name], SQL[name], data) is None


def test_queries_without_sql_have_a_model():
    """Passes over a device's or receiver's rows: test_models.py, test_history.py
    and test_control_and_rf.py hold them against plain models, but for
    rt3_batching."""
    assert set(RUN) - set(SQL) == {"pln3_rotation_mixed", "ctl4_token_bucket", "ctl2_admission", "rt3_batching", "rf17_tracks", "rf17_findings", "sup21_tracks", "srt5_strongest_tracks", "srt6_tracks_in_range", "srt6_rising_tracks"}


def test_flagship(spark, data):
    df = registry.flagship(spark, data)
    assert df.count() > 0 and "anomalies" in df.columns

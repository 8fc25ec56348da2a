"""Results do not depend on the session's ANSI mode (every division and cast
is guarded, so neither mode raises or changes a value)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

NAMES = ["typed_log", "type_conversion_report", "org_features", "feature_correlations", "mart_trial_goals",
         "chi_square_test", "activity_comparison"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_without_ansi(spark, name):
    q = E.queries()[name]
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "true")
        on = sorted(map(repr, q(spark, SF_SMALL).collect()))
        spark.conf.set("spark.sql.ansi.enabled", "false")
        off = sorted(map(repr, q(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert on == off

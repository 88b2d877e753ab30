"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from checks.compare import compare, connect
from checks.oracle import SQL
from epilattice.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"

# The rest differs only in the operators put on top; ALL_QUERIES=1 runs everything.
QUICK = [
    "allowed_origins", "bias_ratios", "cases_at_both_ends", "clean_edges", "coupling_by_week", "coverage_lagged",
    "asof_partitions", "date_functions", "dense_within_states", "directory_union", "draw_summaries", "full_join_null_keys", "granger_tests", "headerless_scan",
    "immunity_share", "immunity_two_sources", "import_risk", "incidence_per_capita", "neighbor_impute", "neighbor_pool", "panel_fixed_penalty", "parquet_week_range",
    "poststratify", "prevalence_sources", "renewal_rt", "residuals_scaled", "serosurvey_few_rounds", "spline_fixed_penalty", "strict_and_skip", "text_functions", "transmissibility", "utf16_regions",
    "upserted_versions", "vaccination_coverage", "vaccine_effectiveness", "weekly_incidence",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the sample tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) == ""


def test_every_query_is_checked_or_known():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"serosurvey_smooth", "spline_smooth", "panel_smooth"}


def test_no_plan_crosses_tables(spark):
    """No query multiplies two tables, and nothing is broadcast by force."""
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "epilattice"
    source = "\n".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts)
    for word in ("crossJoin(", "broadcast(", "localCheckpoint(", ".toPandas(", ".collect()", ".rdd"):
        assert word not in source
    plan = QUERIES["import_risk"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["j", "week", "Ri", "cases_j"]
    assert contract.queries().keys() >= contract.oracle_sql().keys()

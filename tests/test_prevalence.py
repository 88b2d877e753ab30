"""Several sources of seroprevalence: precedence, bounds in time, carried series, errors."""

import math

import pytest

from epilattice.operators import immunity, prevalence


@pytest.fixture(scope="module")
def inputs(spark, day):
    weeks = [day(f"2021-01-{d:02d}") for d in (3, 10, 17, 24)]
    panel = spark.createDataFrame([(w, f, s, 0.1) for w in weeks for f, s in ((1, "TX"), (2, "NY"), (3, "CA"))], "week date, fips int, state string, mean_incidence double")
    survey = spark.createDataFrame([(weeks[0], 1, 0.2), (weeks[1], 2, 0.4), (weeks[0], 3, 0.1), (weeks[2], 3, 0.3)], "week date, fips int, p_immune double")
    draws = [("pred", weeks[1], 1, 0.5, 0.3, 0.7), ("other", weeks[2], 1, 0.9, 0.0, 1.0), ("pred", weeks[0], 3, 0.6, 0.5, 0.9), ("pred", None, 3, 0.0, 0.0, 0.0), ("pred", weeks[3], 3, 0.8, None, 0.9)]
    draws = spark.createDataFrame(draws, "variable string, week date, fips int, mean double, `2.5%` double, `97.5%` double")
    rules = [("TX", "model", 1, None, None), ("CA", "model", 1, weeks[1], weeks[1]), ("CA", "survey", 2, None, weeks[2])]
    rules = spark.createDataFrame(rules, "state string, source string, place int, since date, until date")
    sources = {"survey": prevalence.survey_prevalence(survey), "model": prevalence.interval_prevalence(draws, variable="pred")}
    return weeks, panel, sources, rules


def test_each_state_takes_its_source(inputs):
    weeks, panel, sources, rules = inputs
    got = {(r.fips, weeks.index(r.week)): (r.source, r.mean_sero, r.se_sero) for r in prevalence.resolve_prevalence(panel, sources, rules, "survey", ("survey",)).collect()}
    width = 0.4 / 3.92
    assert got[1, 0] == (None, None, None)  # only the second source counts, and it has no value yet
    assert [got[1, k][:2] for k in (1, 2, 3)] == [("model", 0.5)] * 3 and all(math.isclose(got[1, k][2], width) for k in (1, 2, 3))
    assert got[2, 0] == (None, 0.0, None)  # without a value the survey counts as zero
    assert [got[2, k][:2] for k in (1, 2, 3)] == [("survey", 0.4)] * 3
    assert got[3, 0][:2] == ("survey", 0.1)
    assert got[3, 1][:2] == ("model", 0.6)  # carried from a week before its bounds
    assert got[3, 2][:2] == ("survey", 0.3)
    assert got[3, 3] == (None, None, None)  # no source is listed for that week


def test_immunity_with_the_interval_error(inputs):
    weeks, panel, sources, rules = inputs
    sero = prevalence.resolve_prevalence(panel, sources, rules, "survey", ("survey",))
    coverage = panel.select("week", "fips").limit(0).selectExpr("week", "fips", "0.5D AS complete", "0.1D AS partial")
    got = {(r.fips, weeks.index(r.week)): (r.mean_sigma, r.se_sigma) for r in immunity.immunity(panel, coverage, sero, resolved=True).collect()}
    assert got[1, 0] == (None, None) and math.isclose(got[2, 0][0], 0.1) and got[2, 0][1] is None
    assert math.isclose(got[1, 2][0], 0.1 + 0.8 * 0.5) and math.isclose(got[1, 2][1], 0.8 * 0.4 / 3.92)
    assert math.isclose(got[2, 2][1], 0.8 * 0.4 * 0.6)
    assert got[3, 3] == (None, None)


def test_unknown_names_are_refused(inputs):
    _, panel, sources, rules = inputs
    with pytest.raises(ValueError):
        prevalence.resolve_prevalence(panel, sources, rules, "nothing")

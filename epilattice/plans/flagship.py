"""The three chains of the pipeline, from raw tables to risk, immunity and validation.

Each function is lazy unless it is given a ``stage`` that writes to the shared folder and reads back, as ``run_chains`` and
the query ``import_risk`` do: the whole chain in one plan has thousands of nodes, which the driver holds at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bias import bias_ratio
from ..operators.coupling import asof_partition, contact_rate, coupling
from ..operators.diagnostics import join_estimates
from ..operators.immunity import immunity
from ..operators.incidence import weekly_incidence
from ..operators.mobility import allow_list, clean_edges
from ..operators.renewal import renewal_rt
from ..operators.reproduction import import_risk, pair_reproduction
from ..operators.serology import poststratify
from ..operators.vaccination import partial_only, vaccination_coverage
from ..operators.variants import lineage_shares, transmissibility_multiplier
from ..operators.venues import indoor_outdoor_ratio, poi_prepare
from ..session import settle
from .views import Views

# The sample tables hold about two reports per place and week, so thresholds are lower than the
# operators' defaults, which are made for real counts.
SAMPLE_MIN_CASES = 2


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def cleaned_edges(v: Views, stage=_lazy) -> DataFrame:
    edges = stage(v.mobility_edges(), "visits")
    return clean_edges(edges, allow_list(edges, v.geo()))


def contacts(v: Views, stage=_lazy) -> DataFrame:
    """Contact rate per place and week, scaled by the indoor ratio."""
    poi = stage(poi_prepare(v.poi_visits()), "poi")
    ratio = indoor_outdoor_ratio(poi, v.geo_neighbors(), v.geo(), min_indoor=1, min_outdoor=1, min_maximum=1)
    return contact_rate(ratio.select(F.col("date").alias("week"), "fips", "r"), v.contact_fit())


def immune_share(v: Views, stage=_lazy) -> DataFrame:
    cases = stage(v.cases_daily(), "cases")
    incidence = weekly_incidence(cases, population=v.population(), geo=v.geo(), per_capita=True)
    coverage = partial_only(vaccination_coverage(v.vax_long())).select(
        "week", "fips", F.col("Complete").alias("complete"), F.col("Partial").alias("partial")
    )
    sero = poststratify(cases, v.geo(), v.sero_fit(), v.population())
    return immunity(incidence, coverage, sero.select("week", "fips", "p_immune"))


def multiplier(v: Views) -> DataFrame:
    return transmissibility_multiplier(lineage_shares(v.genomes()))


def risk_chain(v: Views, contact: DataFrame | None = None, stage=_lazy) -> DataFrame:
    """Edges to coupling to R_ij to import risk.

    Contact rates are scaled by the indoor ratio unless they are given; each week takes the edges of the last week that
    has some.
    """
    rates = stage(contacts(v, stage) if contact is None else contact, "contact")
    incidence = stage(weekly_incidence(v.cases_daily()), "incidence")
    edges = stage(cleaned_edges(v, stage), "edges")
    edges = stage(asof_partition(incidence.select("week"), edges, store=stage is _lazy), "edges-by-week")
    coupled = stage(coupling(edges, rates, v.household()), "coupling")
    sigma = stage(immune_share(v, stage), "sigma")
    r_ij = stage(pair_reproduction(coupled, sigma, stage(multiplier(v), "multiplier"), v.geo()), "r_ij")
    return import_risk(r_ij, incidence, SAMPLE_MIN_CASES, distinct_rows=False)


def validation_chain(v: Views, risk: DataFrame, stage=_lazy) -> tuple[DataFrame, DataFrame]:
    """Rt next to the modelled risk, and their ratio."""
    incidence = stage(weekly_incidence(v.cases_daily()), "incidence")
    rt = stage(renewal_rt(incidence), "rt")
    return join_estimates(rt, risk), bias_ratio(risk, rt, min_incidence=1)


def run_chains(v: Views) -> dict[str, DataFrame]:
    """All chains with each stage written and read back."""
    risk = settle(risk_chain(v, stage=settle), "risk")
    joined, bg = validation_chain(v, risk, stage=settle)
    return {"risk": risk, "joined": settle(joined, "joined"), "bg": settle(bg, "bg")}



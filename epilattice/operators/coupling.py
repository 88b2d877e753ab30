"""Contact coupling between places: p_ij = c_i (A A^T)_ij, plus household contact on the diagonal.

A holds the share of place i's visits that go to place k. The product is taken in blocks: places are
hashed into row blocks and destinations into column blocks, each edge is copied once per row block,
and one task multiplies two small matrices. A self join on the destination would instead produce
indegree squared rows for every destination, and a hub would do so in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.nulls import in_set, strict_sum
from ..session import settle
from .joins import attach, natural_join
from .mobility import DEST, ORIGIN
from .panel import distinct_values, fill_down

# Places per row block and destinations per column block. A task holds at most two row blocks by
# one column block of the matrix, as the entries are unique after the sum per (week, i, k).
ROWS_PER_BLOCK = 512
COLUMNS_PER_BLOCK = 4096

BLOCK_SCHEMA = "week date, i int, j int, part double, self double, unknown boolean"


def contact_rate(indoor_ratio: DataFrame, contact_fit: DataFrame) -> DataFrame:
    """Contacts scaled by the indoor ratio -> week, fips, fit, se_fit.

    ``indoor_ratio`` (week, fips, r) sets the weeks; a missing fit takes the place's last one.
    """
    ratio_rows = indoor_ratio.select("week", places.renamed(F.col("fips")).alias("fips"), "r")
    fits = contact_fit.select("week", places.renamed(F.col("fips")).alias("fips"), "fit", "se_fit")
    rows = natural_join(ratio_rows, fits, ["week", "fips"]).distinct()
    filled = fill_down(rows, ["fit", "se_fit"], ["fips"], ["week"])
    scaled = filled.select("week", "fips", (F.col("r") * F.col("fit")).alias("fit"), "se_fit", F.col("r").isNotNull().alias("__r"))
    return scaled.filter(F.col("__r") & F.col("fit").isNotNull()).drop("__r")


def endpoint_universe(contact: DataFrame, household: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """Places with a contact rate, a household size and a place in the coupling -> fips."""
    known = natural_join(contact.select("fips").distinct(), household.select("fips").distinct(), ["fips"], "inner")
    known = known.filter((F.col("fips") < places.FIRST_TERRITORY) & ~in_set(F.col("fips"), places.UNCOUPLED))
    if geo is not None:
        known = natural_join(known, unfitted(contact, geo), ["fips"], "anti")
    return known


def unfitted(contact: DataFrame, geo: DataFrame) -> DataFrame:
    """Places of the county list without any fitted contact rate -> fips."""
    listed = geo.filter(F.col("state").isNotNull()).select("fips")
    fitted = contact.filter(F.col("fit").isNotNull()).select("fips").distinct()
    return natural_join(listed, fitted, ["fips"], "anti")


def asof_source(available: Column, column: str = "week") -> Column:
    """The last of the available weeks up to this one."""
    return F.array_max(F.filter(available, lambda w: w <= F.col(column)))


def fallback_source(available: Column, fallback, column: str = "week") -> Column:
    """This week if it is available, else a fixed one."""
    return F.when(F.array_contains(available, F.col(column)), F.col(column)).otherwise(F.lit(fallback).cast("date"))


def wanted_weeks(weeks: DataFrame, column: str = "week") -> DataFrame:
    """The wanted weeks, each once. They are stored first, so a source is looked up once per week.

    In one plan with the rows that the weeks come from, Spark leaves out the distinct step below a set of weeks and moves
    filters on the source down to the scan, so the lookup would be made for each of these rows.
    """
    return settle(weeks.select(column).distinct(), "wanted-weeks")


def asof_partition(weeks: DataFrame, edges: DataFrame, column: str = "week", store: bool = True) -> DataFrame:
    """Edges for every wanted week; a week without edges takes those of the last week that has some.

    For edges that are any table. ``sources.partitions.read_asof`` does it for edges stored by week, without reading rows to
    learn which weeks there are. The edges are read for their weeks and for their rows, so they are stored first;
    ``store=False`` is for edges that are a stored stage already.
    """
    if store:
        edges = settle(edges, "asof-edges")
    wanted = wanted_weeks(weeks, column).withColumn("__have", distinct_values(edges, column))
    return copied_to_weeks(wanted.withColumn("__source", asof_source(F.col("__have"), column)), edges, column)


def fixed_fallback(weeks: DataFrame, edges: DataFrame, fallback, column: str = "week") -> DataFrame:
    """Edges for every wanted week; a week without edges takes those of one fixed week."""
    wanted = wanted_weeks(weeks, column).withColumn("__have", distinct_values(edges, column))
    return copied_to_weeks(wanted.withColumn("__source", fallback_source(F.col("__have"), fallback, column)), edges, column)


def copied_to_weeks(wanted: DataFrame, edges: DataFrame, column: str = "week") -> DataFrame:
    """Weeks that share a ``__source`` travel together, so each edge is read once and then copied."""
    plan = wanted.filter(F.col("__source").isNotNull()).groupBy("__source").agg(F.collect_set(column).alias("__to"))
    plan = plan.withColumnRenamed("__source", column)
    placed = attach(edges, plan, [column], "inner")
    kept = [F.explode("__to").alias(column) if c == column else F.col(c) for c in edges.columns]
    return placed.select(*kept)


def _coupled_edges(edges: DataFrame, endpoints: DataFrame, missing_self: str | int) -> DataFrame:
    """Recoded edges between places that are known in the week -> week, i, k, v, one row per (week, i, k).

    With ``missing_self='null'`` a place that occurs in a week without an edge to itself gets one of
    unknown weight. Every edge brings a marker for the loop of both its ends; the map-side part of
    the sum reduces the markers to one per place, so no second pass over the edges is needed.
    """
    if missing_self not in ("null", 0):
        raise ValueError("missing_self is 'null' or 0")
    rows = edges.select(
        "week",
        places.renamed(F.col(ORIGIN)).alias("i"),
        places.renamed(F.col(DEST)).alias("k"),
        F.col("prop_population").alias("v"),
    )
    for end in ("i", "k"):
        named = endpoints.select("week", F.col("fips").alias(end))
        rows = attach(rows, named, ["week", end], "semi")
    if missing_self == "null":
        edge = F.struct("i", "k", "v", F.lit(True).alias("real"))
        loops = [
            F.struct(F.col(c).alias("i"), F.col(c).alias("k"), F.lit(0.0).alias("v"), F.lit(False).alias("real"))
            for c in ("i", "k")
        ]
        rows = rows.select("week", F.inline(F.array(edge, *loops)))
    else:
        rows = rows.withColumn("real", F.lit(True))
    return rows.groupBy("week", "i", "k").agg(F.when(F.bool_or("real"), strict_sum(F.col("v"))).alias("v"))


def _block_product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Product of two row blocks over one column block, stored entries only."""
    week, first, second, _ = key
    _, column = np.unique(pdf["k"].to_numpy(), return_inverse=True)
    width = int(column.max()) + 1
    block = pdf["block"].to_numpy()

    def dense(which: int):
        chosen = block == which
        names, row = np.unique(pdf["i"].to_numpy()[chosen], return_inverse=True)
        col, v = column[chosen], pdf["v"].to_numpy(dtype="float64")[chosen]
        lost = np.isnan(v)
        value = np.zeros((len(names), width))
        stored, unknown = (np.zeros((len(names), width), dtype="float32") for _ in range(2))
        value[row, col] = np.where(lost, 0.0, v)
        stored[row, col] = 1.0
        unknown[row, col] = lost
        return names, value, stored, unknown

    a_names, a, a_stored, a_unknown = dense(first)
    b_names, b, b_stored, b_unknown = (a_names, a, a_stored, a_unknown) if first == second else dense(second)
    part = a @ b.T
    present = (a_stored @ b_stored.T) > 0
    unknown = (a_unknown @ b_stored.T + a_stored @ b_unknown.T) > 0
    rows, cols = np.nonzero(present)
    i, j = a_names[rows], b_names[cols]
    out = {"i": i, "j": j, "part": part[rows, cols], "self": np.zeros(len(i)), "unknown": unknown[rows, cols]}
    if first == second:
        loops = pdf[(pdf["i"] == pdf["k"]) & pdf["v"].notna()]
        weight = dict(zip(loops["i"].to_numpy(), loops["v"].to_numpy()))
        same = np.nonzero(i == j)[0]
        out["self"][same] = [weight.get(n, 0.0) for n in i[same]]
    else:
        mirrored = {**out, "i": j, "j": i}
        out = {c: np.concatenate([out[c], mirrored[c]]) for c in out}
    return pd.DataFrame({"week": week, **out})


def overlap(
    edges: DataFrame,
    place_list: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    columns_per_block: int = COLUMNS_PER_BLOCK,
) -> DataFrame:
    """(A A^T)_ij per week from unique edges (week, i, k, v) -> week, i, j, s, self.

    ``s`` is missing where a product with an unknown entry takes part; ``self`` is A_ii on the
    diagonal. Only pairs of blocks are multiplied once, the rest is their mirror. ``place_list``
    (fips) sets the number of blocks. The result is partitioned by (week, i).
    """
    known = place_list.agg(F.count_distinct("fips").alias("n")).scalar()
    placed = edges.withColumn("rows", F.greatest(F.lit(1), F.ceil(known / rows_per_block)).cast("int"))
    placed = placed.withColumn("cols", F.greatest(F.lit(1), F.ceil(known / columns_per_block)).cast("int"))
    placed = placed.withColumns(
        {
            "block": F.pmod(F.xxhash64("i"), F.col("rows")).cast("int"),
            "col_block": F.pmod(F.xxhash64("k", F.lit(1)), F.col("cols")).cast("int"),
        }
    )
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    copies = copies.select(
        "week",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "col_block",
        "block",
        "i",
        "k",
        "v",
    )
    parts = copies.groupBy("week", "first", "second", "col_block").applyInPandas(_block_product, BLOCK_SCHEMA)
    # (week, i) holds at most one row per place and column block, and serves the sum as well as
    # the join with the rates of i.
    return (
        parts.repartition("week", "i")
        .groupBy("week", "i", "j")
        .agg(F.sum("part").alias("s"), F.sum("self").alias("self"), F.bool_or("unknown").alias("unknown"))
        .select("week", "i", "j", F.when(~F.col("unknown"), F.col("s")).alias("s"), "self")
    )


def _endpoint_rates(contact: DataFrame, household: DataFrame) -> DataFrame:
    """Contact rate and household size of every place and week that takes part.

    A place that is listed under its old and its new code counts once, with the larger size.
    """
    keys = ["fips", "week"] if "week" in household.columns else ["fips"]
    sizes = household.withColumn("fips", places.renamed(F.col("fips"))).groupBy(*keys).agg(F.max("hh_size").alias("hh_size"))
    rates = natural_join(contact.select("week", "fips", "fit"), sizes, keys, "inner")
    return rates.filter((F.col("fips") < places.FIRST_TERRITORY) & ~in_set(F.col("fips"), places.UNCOUPLED))


def coupling(
    edges_week: DataFrame,
    contact: DataFrame,
    household: DataFrame,
    min_value: float = 1e-4,
    missing_self: str | int = "null",
    rows_per_block: int = ROWS_PER_BLOCK,
    columns_per_block: int = COLUMNS_PER_BLOCK,
) -> DataFrame:
    """Contact coupling per week -> week, i, j, mean."""
    rates = _endpoint_rates(contact, household)
    edges = _coupled_edges(edges_week, rates, missing_self)
    product = overlap(edges, household, rows_per_block, columns_per_block)
    named = rates.withColumnRenamed("fips", "i")
    scaled = natural_join(product, named, ["week", "i"], "inner", null_safe=False)
    diagonal = F.when(F.col("i") == F.col("j"), F.col("hh_size") * F.col("self") * F.col("self")).otherwise(0.0)
    mean = F.col("fit") * F.col("s") + diagonal
    return scaled.select("week", "i", "j", mean.alias("mean")).filter(F.col("mean") > min_value)


def coupling_variance(
    edges_week: DataFrame,
    contact_var: DataFrame,
    place_list: DataFrame,
    missing_self: str | int = "null",
    rows_per_block: int = ROWS_PER_BLOCK,
    columns_per_block: int = COLUMNS_PER_BLOCK,
) -> DataFrame:
    """Variance of the coupling when contacts are independent -> week, i, j, var.

    ``contact_var`` is (week, fips, var): the squared standard error of the contact rate. Blocks are laid for its places
    and those of ``place_list``, so they stay bounded when the list misses some.
    """
    edges = _coupled_edges(edges_week, contact_var, missing_self)
    known = place_list.select("fips").union(contact_var.select("fips")).distinct()
    product = overlap(edges, known, rows_per_block, columns_per_block)
    named = contact_var.select("week", F.col("fips").alias("i"), "var")
    scaled = natural_join(product, named, ["week", "i"], "inner", null_safe=False)
    return scaled.select("week", "i", "j", (F.col("var") * F.col("s") * F.col("s")).alias("var")).filter(
        F.col("var").isNotNull()
    )

"""Every operator as a query over the star-schema tables: name -> function of (spark, folder).

Doubles are rounded, as sums of doubles depend on the order of the rows. A small shift before the
rounding keeps exact ties from being decided by the last bit.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, nulls, places, stats, text
from ..operators import (
    bias,
    coupling,
    diagnostics,
    immunity,
    incidence,
    joins,
    mobility,
    panel,
    prevalence,
    quantiles,
    renewal,
    reproduction,
    reshape,
    serology,
    smoothing,
    vaccination,
    variants,
    venues,
)
from ..session import configure, scratch_path, settle
from ..sources import partitions, readers, sinks
from . import flagship
from .views import Views

ORIGIN, DEST = mobility.ORIGIN, mobility.DEST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 8
NUDGE = 3.71e-10


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column."""
    return df.select(
        [F.round(F.col(f"`{n}`") + NUDGE, digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(fn(Views(configure(spark), folder)))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def some_null(column, modulus: int):
    """A column with holes, for the missing-value rules."""
    return F.when(column % modulus != 0, column)


# Scans and sinks: each writes a derived table to the shared folder and reads it back.


@query
def csv_typed_scan(v: Views):
    path = scratch_path(v.spark, "reports")
    sinks.write_csv(v.reports("o_orderstatus", "o_totalprice"), path)
    return readers.read_csv(v.spark, path, "iiDcd")


@query
def csv_projected_scan(v: Views):
    path = scratch_path(v.spark, "lines")
    sinks.write_csv(v.table("lineitem").drop("l_shipdate"), path)
    return readers.read_csv(v.spark, path, "i--id---c-").withColumnRenamed("l_returnflag", "flag")


@query
def tsv_clean_names(v: Views):
    path = scratch_path(v.spark, "survey")
    sinks.write_csv(v.serosurvey(), path, sep="\t")
    return readers.read_tsv(v.spark, path, "ccdi---d", clean_names=True)


@query
def headerless_scan(v: Views):
    path = scratch_path(v.spark, "pairs")
    v.reports().select("fips", "o_orderkey").write.csv(path)
    return readers.read_csv(v.spark, path, "ii", names=["fips", "record"], header=False)


@query
def utf16_regions(v: Views):
    path = scratch_path(v.spark, "regions")
    customers = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = customers.select(
        "c_custkey", "c_mktsegment", F.concat(F.lit("Region"), "n_regionkey", F.lit(".csv")).alias("file")
    )
    named.write.partitionBy("file").option("header", "true").option("sep", "\t").option("encoding", "UTF-16LE").csv(path)
    return readers.read_regions(v.spark, f"{path}/file=*", "ic")


@query
def weekly_csv_files(v: Views):
    path = scratch_path(v.spark, "weekly")
    sinks.write_by_week(v.weekly_edges(), path, fmt="csv")
    return readers.read_weekly_files(v.spark, f"{path}/week=*", "iid")


@query
def parquet_week_range(v: Views):
    path = scratch_path(v.spark, "weeks")
    sinks.write_by_week(v.weekly_edges(), path)
    return readers.read_partitions(v.spark, path, "1996-01-01", "1997-06-30")


@query
def parquet_round_trip(v: Views):
    path = scratch_path(v.spark, "means")
    sinks.write_parquet(v.weekly_means(), path)
    return v.spark.read.parquet(path)


def _numbered_edges(v: Views) -> DataFrame:
    """Edges keyed by year and number of the week since the first Monday of the year."""
    monday = F.date_sub("date", F.weekday("date"))
    number = F.floor((F.dayofyear(monday) - 1) / 7).cast("int") + 1
    return (
        v.mobility_edges()
        .select(ORIGIN, DEST, F.year(monday).alias("year"), number.alias("week"), "num_visits", "origin_total_num_visits")
        .groupBy(ORIGIN, DEST, "year", "week")
        .agg(F.sum("num_visits").alias("__visits"), F.max("origin_total_num_visits").alias("__total"))
        .select(ORIGIN, DEST, "year", "week", (F.col("__visits") / F.col("__total")).alias("prop_of_origin_visits_to_dest"))
    )


@query
def week_number_slices(v: Views):
    path = scratch_path(v.spark, "slices")
    sinks.write_week_number_slices(_numbered_edges(v), path)
    return v.spark.read.parquet(path)


@query
def upserted_versions(v: Views):
    """Two revisions in a row as versions that share the folders of untouched weeks."""
    edges = v.weekly_edges()
    schema = ", ".join(f"`{name}` {kind}" for name, kind in edges.dtypes)
    first, second, third = (scratch_path(v.spark, name) for name in ("first", "second", "third"))
    partitions.write_version(edges.filter(F.col("week") < F.lit("1999-01-01").cast("date")), first)
    late = edges.filter(F.col("week") >= F.lit("1998-01-01").cast("date"))
    partitions.upsert_version(v.spark, first, late.withColumn("prop_population", F.col("prop_population") * 0.5), second, schema)
    year = edges.filter(F.year("week") == 1996).withColumn("prop_population", F.col("prop_population") * 3)
    partitions.upsert_version(v.spark, second, year, third, schema)
    return partitions.read_version(v.spark, third, schema)


@query
def upserted_edges(v: Views):
    path = scratch_path(v.spark, "version")
    edges = v.weekly_edges()
    early = edges.filter(F.col("week") < F.lit("1999-01-01").cast("date"))
    late = edges.filter(F.col("week") >= F.lit("1998-01-01").cast("date"))
    revised = late.withColumn("prop_population", F.col("prop_population") * 0.5)
    sinks.write_upserted(early, revised, path)
    return v.spark.read.parquet(path)


def _sparse_edges(v: Views) -> DataFrame:
    """Edges with a week missing here and there."""
    return v.weekly_edges().filter(F.weekofyear("week") % 9 != 4)


@query
def asof_edges(v: Views):
    return coupling.asof_partition(v.weekly_means().select("week"), _sparse_edges(v))


@query
def fallback_edges(v: Views):
    return coupling.fixed_fallback(v.weekly_means().select("week"), _sparse_edges(v), "1996-01-07")


def _stored_by_week(v: Views) -> str:
    path = scratch_path(v.spark, "edges-by-week")
    sinks.write_by_week(_sparse_edges(v), path)
    return path


@query
def asof_partitions(v: Views):
    """As ``asof_edges``, from folders by week."""
    return partitions.read_asof(v.spark, v.weekly_means().select("week"), _stored_by_week(v))


@query
def fallback_partitions(v: Views):
    """As ``fallback_edges``, from folders by week; only weeks of 1997 are wanted."""
    wanted = v.weekly_means().select("week").filter(F.year("week") == 1997)
    return partitions.read_with_fallback(v.spark, wanted, _stored_by_week(v), "1996-01-07")


@query
def directory_union(v: Views):
    """Files of three shapes in one folder, matched by the names in their first lines."""
    path = scratch_path(v.spark, "shapes")
    customer = v.table("customer").select(F.col("c_nationkey").alias("fips"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    sinks.write_csv(customer.repartition(4, "segment"), f"{path}/a")
    sinks.write_csv(v.table("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("fips")).repartition(3, "fips"), f"{path}/b")
    sinks.write_csv(v.geo().select("name", "fips", "state"), f"{path}/c")
    return readers.read_union(v.spark, f"{path}/*", {"fips": "i", "balance": "d"})


@query
def union_of_shapes(v: Views):
    customer = v.table("customer").select(
        F.col("c_nationkey").alias("fips"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    supplier = v.table("supplier").select(F.col("s_nationkey").alias("fips"), F.col("s_acctbal").alias("balance"))
    return reshape.stack(customer, supplier)


# Projections and filters


@query
def recoded_population(v: Views):
    """Two places renamed, three merged into one unit, with its state given."""
    mapping = {3: 103, 4: 104, 7: 200, 8: 200, 9: 200}
    unit = places.recode(F.col("fips"), mapping)
    sized = v.population().select(unit.alias("fips"), "pop").groupBy("fips").agg(F.sum("pop").alias("pop"))
    joined = joins.natural_join(sized, v.geo().select("fips", "state"), ["fips"])
    defaults = {103: "AFRICA", 104: "AMERICA", 200: "UNIT"}
    return joined.withColumn("state", places.unit_state(F.col("fips"), F.col("state"), defaults))


@query
def split_reporting_units(v: Views):
    unit = places.recode(F.col("fips"), {7: 2998, 8: 2997})
    weekly = v.weekly_means().select("week", unit.alias("fips"), "n_sample")
    return places.split_units(weekly)


@query
def excluded_places(v: Views):
    """A deny-list keeps rows without a code."""
    rows = v.table("orders").select("o_orderkey", some_null((F.col("o_custkey") % 25), 6).alias("fips"))
    return places.without(rows, [1, 2, 3])


@query
def allowed_origins(v: Views):
    return mobility.allow_list(v.mobility_edges(), v.geo(), drop=[5, 6])


@query
def city_override(v: Views):
    """Reports under the name of a city take its code, its population and a mark; the rest keep theirs."""
    return incidence.city_panel(_city_reports(v), v.population())


@query
def city_cumulative(v: Views):
    return incidence.mean_cumulative(_city_reports(v))


def _city_reports(v: Views) -> DataFrame:
    named = joins.natural_join(v.cases_daily(), v.geo().select("fips", F.col("name").alias("county")), ["fips"])
    return named.withColumn("fips", F.when(F.col("county") != "NATION_3", F.col("fips"))).withColumn(
        "county", F.when(F.col("county") == "NATION_3", places.CITY_REPORT_NAME).otherwise(F.col("county"))
    )


@query
def sentinels_and_clamps(v: Views):
    x = F.col("c_acctbal")
    rate = F.when(F.col("c_custkey") % 10 == 0, F.lit(666.0)).when(F.col("c_custkey") % 11 == 0, F.lit(777.0)).otherwise(x / 100)
    rows = v.table("customer").withColumn("rate", nulls.sentinel_to_null(rate, 666, 777))
    r = F.col("rate")
    return rows.select(
        "c_custkey",
        "rate",
        nulls.floor_at(r, 0.0).alias("floored"),
        nulls.cap_at(r, 50.0).alias("capped"),
        nulls.null_above(r, 50.0).alias("cut"),
        nulls.null_outside(r, 0.0, 50.0).alias("inside"),
        F.coalesce(r, F.lit(0.9)).alias("filled"),
        nulls.if_else(r > 10, F.lit("high"), F.lit("low")).alias("label"),
        nulls.ratio(r, nulls.floor_at(r, 0.0)).alias("share"),
    )


@query
def large_pairs(v: Views):
    """Visits above a minimum, of pairs with enough of them."""
    rows = v.mobility_edges().filter(F.col("num_visits") > 40)
    return panel.keep_large_groups(rows, mobility.PAIR, 5).select(*mobility.PAIR, "date", "num_visits")


@query
def null_duplicates(v: Views):
    rows = v.table("customer").select(
        (F.col("c_custkey") % 400).alias("k"), some_null(F.col("c_custkey"), 3).alias("bg"), "c_custkey"
    )
    return panel.drop_null_duplicates(rows, ["k"], "bg")


@query
def well_observed_places(v: Views):
    rows = v.weekly_means().filter(F.col("n_sample") >= 8).select("week", "fips", "n_sample")
    return panel.well_observed(rows, ["fips"], "week", 0.35)


@query
def corrected_cells(v: Views):
    weekly = v.weekly_means().select("week", "fips", "n_sample")
    fixes = weekly.filter((F.col("n_sample") == 3)).select("week", "fips", (F.col("n_sample") * 100).alias("n_sample"))
    return panel.correct_cells(weekly, fixes, ["week", "fips"], "n_sample")


# Joins


@query
def full_join_null_keys(v: Views):
    """Keys of both sides once; a missing key meets a missing key."""
    a = v.table("orders").groupBy(some_null(F.col("o_custkey") % 30, 7).alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    b = v.table("customer").groupBy(some_null(F.col("c_custkey") % 40, 9).alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return joins.natural_join(a, b, ["k"], "full")


@query
def members_and_others(v: Views):
    """Reports of places with listed neighbours, and places without a list."""
    lists = v.geo_neighbors().select("fips").distinct()
    inside = joins.keep_members(v.reports(), "fips", lists).groupBy("fips").agg(F.count(F.lit(1)).alias("n"))
    outside = joins.drop_members(v.geo().select("fips"), "fips", lists).withColumn("n", F.lit(0).cast("long"))
    return reshape.stack(inside, outside)


@query
def cases_at_both_ends(v: Views):
    cases = v.weekly_means().select("fips", "week", F.col("n_sample").alias("cases"))
    edges = v.weekly_edges().select("week", F.col(ORIGIN).alias("i"), F.col(DEST).alias("j"))
    return joins.lookup_two_roles(edges, cases, "fips", "i", "j", ["week"])


@query
def positional_pairs(v: Views):
    a = v.weekly_means().select("fips", F.col("week").alias("week_a"), "n_sample")
    b = v.daily_new().select("fips", F.col("date").alias("date_b"), "cases")
    return joins.positional_join(a, b, ["fips"], ["week_a"], ["date_b"])


@query
def versions_apart(v: Views):
    old = v.weekly_means().select("fips", "week", "n_contact")
    new = old.withColumn("n_contact", F.when(F.month("week") == 3, F.col("n_contact") + 0.5).otherwise(F.col("n_contact") + 1e-5))
    return joins.version_diff(old, new, ["fips", "week"], "n_contact")


# Aggregation


@query
def strict_and_skip(v: Views):
    rows = v.table("orders").select(
        (F.col("o_custkey") % 300).alias("k"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice") / 1000).alias("x"),
        F.when(F.col("o_orderkey") % 70 != 0, F.col("o_orderkey") % 7 + 1).alias("w"),
    )
    x, w = F.col("x"), F.col("w")
    return rows.groupBy("k").agg(
        nulls.strict_sum(x).alias("sum_strict"), nulls.skip_sum(x, 0.0).alias("sum_skip"),
        nulls.strict_mean(x).alias("mean_strict"), F.avg(x).alias("mean_skip"),
        nulls.strict_sd(x).alias("sd_strict"), nulls.weighted_mean(x, w).alias("mean_weighted"),
        nulls.root_mean_square(x).alias("rms"), F.avg(x).cast("int").alias("mean_int"), F.count(F.lit(1)).alias("n"),
    )


@query
def group_shares(v: Views):
    return panel.share_of_group(v.weekly_means().select("week", "fips", "n_sample"), "n_sample", ["week"], "total", "share")


@query
def distinct_counts(v: Views):
    rows = v.reports().select("fips", dates.week_of(F.col("date")).alias("week")).distinct()
    return rows.groupBy("fips").agg(F.count_distinct("week").alias("weeks"), F.min("week").alias("first"), F.max("week").alias("last"))


@query
def residual_shares(v: Views):
    scored = mobility.edge_residuals(v.weekly_edges())
    two = mobility.threshold_shares(scored, "z_resid", (3, 2, 1)).withColumn("sides", F.lit(2))
    one = mobility.threshold_shares(scored, "z_resid", (3, 2, 1), two_sided=False).withColumn("sides", F.lit(1))
    return reshape.stack(two, one)


@query
def draw_summaries(v: Views):
    return quantiles.draw_summary(v.draws())


@query
def draws_by_place(v: Views):
    return diagnostics.draw_index_join(v.draws(), v.geo(), v.weekly_means())


# Windows


@query
def daily_steps(v: Views):
    return v.cases_daily().withColumn("new", panel.first_difference("cases", ["fips"], ["date"]))


def _gappy(v: Views) -> DataFrame:
    return v.weekly_means().select("fips", "week", F.when(F.col("n_sample") % 3 == 0, F.col("n_sample")).alias("x"))


@query
def filled_series(v: Views):
    by, order = ["fips"], ["week"]
    return _gappy(v).withColumns(
        {
            "down": panel.filled_down("x", by, order),
            "down_up": panel.filled_down_up("x", by, order),
            "up_down": panel.filled_up_down("x", by, order),
        }
    )


@query
def rolling_means(v: Views):
    rows = v.weekly_means().select("fips", "week", F.when(F.col("n_sample") % 5 != 0, F.col("n_contact")).alias("x"))
    by, order = ["fips"], ["week"]
    return rows.withColumns(
        {"centred": panel.rolling_mean("x", by, order, 1, 1), "ahead": panel.rolling_mean("x", by, order, 0, 2)}
    )


@query
def group_scores(v: Views):
    """z-score, ratio to the mean and imputation within states."""
    rows = joins.natural_join(v.weekly_means(), v.geo().select("fips", "state"), ["fips"])
    rows = rows.select("fips", "week", "state", F.when(F.col("n_sample") % 4 != 0, F.col("n_contact")).alias("x"))
    scored = panel.over_group_mean(panel.z_score(rows, "x", ["state"]), "x", ["state"], "relative")
    return panel.impute_group_mean(scored, "x", ["state"])


@query
def time_indexed(v: Views):
    indexed = panel.time_index(v.weekly_means().select("fips", "week"), "week")
    return joins.with_scalars(indexed, t_max=F.max("t"))


@query
def sampled_place(v: Views):
    return panel.one_entity(v.weekly_means().select("fips", "week", "n_sample"), "fips", "seed")


@query
def reference_weeks(v: Views):
    return panel.reference_calendar(v.weekly_means(), "fips", 1, start="1996-01-28")


# Shape


@query
def dense_panel(v: Views):
    return panel.complete(v.weekly_means().select("fips", "week", "n_sample"), ["fips"], "week")


@query
def dense_within_states(v: Views):
    rows = joins.natural_join(v.weekly_means(), v.geo().select("fips", "state"), ["fips"])
    rows = rows.filter(F.month("week") != F.col("fips") % 12 + 1).select("state", "fips", "week", "n_sample")
    return panel.complete(rows, ["fips"], "week", within=["state"])


@query
def status_columns(v: Views):
    counts = v.reports("o_orderstatus").groupBy("fips", "date", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return reshape.widen(counts, ["fips", "date"], "o_orderstatus", "n", ["F", "O", "P"])


@query
def week_columns(v: Views):
    """All weeks of the reporting period as columns, one row per place."""
    first = datetime.date(1995, 1, 1)
    days = [str(first + datetime.timedelta(days=7 * k)) for k in range(345)]
    weekly = v.weekly_means().select("fips", F.date_format("week", "yyyy-MM-dd").alias("week"), "n_sample")
    wide = reshape.widen(weekly, ["fips"], "week", "n_sample", days)
    return wide.select("fips", *[F.col(f"`{d}`").alias("w" + d.replace("-", "_")) for d in days])


@query
def long_measures(v: Views):
    wide = v.weekly_means().select("fips", "week", "n_contact", F.col("n_sample").cast("double").alias("n_sample"))
    return reshape.lengthen(wide, ["fips", "week"], ["n_contact", "n_sample"])


@query
def nested_series(v: Views):
    nested = reshape.nest(v.weekly_means(), ["fips"], ["week", "n_sample"])
    return reshape.unnest(nested.withColumn("weeks", F.size("data")))


@query
def key_value_edges(v: Views):
    """Destination counts packed as 'place: n, place: n' and taken apart again."""
    counts = v.mobility_edges().groupBy(F.col(ORIGIN).alias("fips"), "date", F.col(DEST).alias("dest")).agg(
        F.sum("num_visits").cast("int").alias("n")
    )
    # At most one entry per destination.
    entry = F.concat_ws(": ", F.col("dest").cast("string"), F.col("n").cast("string"))
    packed = counts.groupBy("fips", "date").agg(F.array_join(F.collect_list(entry), ", ").alias("destinations"))
    return reshape.explode_pairs(packed, "destinations", "dest", "n")


@query
def union_without_repeats(v: Views):
    a = v.weekly_means().select("fips", "week").filter(F.month("week") <= 7)
    b = v.weekly_means().select("fips", "week").filter(F.month("week") >= 6)
    return reshape.union_distinct(a, b)


# Scalars


@query
def text_functions(v: Views):
    name = F.concat_ws(" / ", "c_mktsegment", "c_name", F.col("c_custkey").cast("string"))
    rows = v.table("customer").select("c_custkey", "c_acctbal", name.alias("s"))
    s = F.col("s")
    return rows.select(
        "c_custkey",
        text.piece(s, "/", 3, 2).alias("second"),
        text.piece(s, "/", 5, 5).alias("absent"),
        F.lower(text.piece(s, "/", 2, 1)).alias("first"),
        text.words_from(s, 3).alias("tail"),
        text.parse_number(text.piece(s, "#", 2, 2)).alias("number"),
        stats.inverse_logit(F.col("c_acctbal") / 5000).alias("logit"),
        stats.se_from_interval(F.col("c_acctbal") * 0.9, F.col("c_acctbal") * 1.1).alias("se"),
        F.sqrt(F.abs("c_acctbal")).alias("root"),
    )


@query
def date_functions(v: Views):
    day = F.col("day")
    rows = v.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    hours = F.make_dt_interval(F.lit(0), F.dayofmonth(day))
    return rows.select(
        "day",
        dates.week_of(day).alias("week"),
        dates.week_of_instant(day.cast("timestamp") + hours).alias("week_of_instant"),
        dates.month_of(day).alias("month"),
        dates.shift_weeks(day, 3).alias("later"),
        dates.weeks_between(F.lit("1995-01-01").cast("date"), day).alias("weeks"),
        dates.week_from_number(F.year(day), F.month(day)).alias("numbered"),
        dates.parse_month_day_year(F.date_format(day, "MMM d, yyyy")).alias("parsed"),
    )


# Incidence


@query
def weekly_incidence(v: Views):
    return incidence.weekly_incidence(v.cases_daily())


@query
def incidence_per_capita(v: Views):
    return incidence.weekly_incidence(v.cases_daily(), population=v.population(), geo=v.geo(), per_capita=True)


@query
def incidence_from_mean(v: Views):
    return incidence.weekly_incidence_from_mean(v.cases_daily(), "2000-01-01")


@query
def city_weekly_sum(v: Views):
    return incidence.weekly_sum(v.daily_new(), [1, 2, 3, 4, 5])


@query
def combined_reports(v: Views):
    return incidence.combine_reports(
        incidence.weekly_incidence_from_mean(v.cases_daily()), incidence.weekly_sum(v.daily_new(), [1, 2, 3, 4, 5])
    )


# Mobility and coupling


@query
def clean_edges(v: Views):
    return flagship.cleaned_edges(v)


@query
def clean_edges_skip(v: Views):
    """A pair without spread keeps its shares; rows stay daily."""
    return mobility.clean_edges(v.mobility_edges(), after="1996-06-30", z_cap=1.5, null_policy="skip", dedupe=False)


@query
def edge_residuals(v: Views):
    return mobility.edge_residuals(v.weekly_edges())


@query
def edge_standardise(v: Views):
    return mobility.edge_standardise(v.weekly_edges(), min_obs=60)


@query
def edge_scaled(v: Views):
    bg = v.population().select("fips", (F.col("pop") / 50000).alias("bg"))
    return mobility.edge_scaled(v.weekly_edges(), v.contact_fit(), bg, min_obs=60)


@query
def contact_rates(v: Views):
    return flagship.contacts(v)


@query
def endpoint_universe(v: Views):
    household = v.household().filter(F.col("fips") % 6 != 0)
    fit = v.contact_fit().withColumn("fit", F.when(F.col("fips") % 7 != 0, F.col("fit")))
    return coupling.endpoint_universe(fit, household, v.geo())


@query
def coupling_by_week(v: Views):
    return coupling.coupling(v.weekly_edges(), v.contact_fit(), v.household())


@query
def coupling_blocks(v: Views):
    """The same product cut into many small blocks; a missing loop weighs nothing."""
    return coupling.coupling(
        v.weekly_edges(), v.contact_fit(), v.household(), missing_self=0, rows_per_block=9, columns_per_block=13
    )


@query
def coupling_variance(v: Views):
    var = v.contact_fit().select("week", "fips", (F.col("se_fit") * F.col("se_fit")).alias("var"))
    return coupling.coupling_variance(v.weekly_edges(), var, v.household())


# Variants and vaccination


@query
def lineage_shares(v: Views):
    return variants.lineage_shares(v.genomes(), "1996-01-01", "2000-12-31")


@query
def collapsed_lineages(v: Views):
    return variants.collapse_lineages(variants.lineage_shares(v.genomes()))


@query
def transmissibility(v: Views):
    """With a lineage the table does not know, its weeks are missing."""
    known = {k: x for k, x in variants.TRANSMISSIBILITY.items() if k != "iota"}
    return variants.transmissibility_multiplier(
        variants.lineage_shares(v.genomes()), variants.transmissibility_table(v.spark, known)
    )


@query
def multiplier_by_state_code(v: Views):
    """Full state names swapped for codes; a state without a code keeps its name."""
    names = v.geo().filter(F.col("state") != "ASIA").select(F.col("state").alias("state_name"), F.substring("state", 1, 2).alias("state"))
    return variants.with_state_names(flagship.multiplier(v), names.distinct())


@query
def vaccine_effectiveness(v: Views):
    return variants.vaccine_effectiveness(variants.collapse_lineages(variants.lineage_shares(v.genomes())))


@query
def vaccination_coverage(v: Views):
    return vaccination.vaccination_coverage(v.vax_long(), "2000-01-01", v.geo())


@query
def partial_coverage(v: Views):
    return vaccination.partial_only(vaccination.vaccination_coverage(v.vax_long()))


@query
def coverage_lagged(v: Views):
    return vaccination.coverage_lagged(v.vax_long(), units={7: 2998, 8: 2998})


# Serology and immunity


@query
def serosurvey_prepare(v: Views):
    return serology.serosurvey_prepare(v.serosurvey())


@query
def serosurvey_smooth(v: Views):
    return rounded(serology.serosurvey_smooth(serology.serosurvey_prepare(v.serosurvey())), 4)


def _short_surveys(v: Views) -> DataFrame:
    """The survey where states have 4, 6, 8, 10 and 12 known rounds, by name; the other rounds have no estimate."""
    prepared = serology.serosurvey_prepare(v.serosurvey())
    order = F.array_position(F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]), F.col("state"))
    known = F.col("t") <= 4 * F.col("mean_round")
    kept = prepared.withColumn("mean_round", (2 + 2 * order).cast("int"))
    # every fourth round up to the state's number, so that the curve is asked far beyond its data too
    here = known & (F.col("t") % 4 == 0) & F.col("mean_sero").isNotNull()
    return kept.withColumns({c: F.when(here, F.col(c)) for c in ("mean_sero", "success", "n")}).drop("mean_round")


@query
def serosurvey_few_rounds(v: Views):
    """Basis size per state, and how far the fit is from its score equations; the constant fit beside the plain share.

    A curve of one to seven functions without penalty solves one equation per function: over the rounds, the function's
    values times what is left of the successes sum to zero. Only the functions that a size has in common with polynomials
    are asked here: the constant, from two functions on the line, from three on the parabola.
    """
    short = _short_surveys(v)
    fitted = serology.serosurvey_smooth(short, penalty=0.0)
    rows = joins.natural_join(short, fitted, ["state", "week"]).filter(F.col("success").isNotNull() & (F.col("n") > 0))
    left, u = F.col("success") - F.col("n") * F.col("mean_pred"), F.col("t") / 80.0
    share = F.sum("success") / F.sum("n")
    sums = rows.groupBy("state").agg(
        F.sum(left).alias("s0"), F.sum(left * u).alias("s1"), F.sum(left * u * u).alias("s2"), share.alias("share"),
        F.count(F.lit(1)).alias("fitted_rounds"), (F.sum(F.col("n") * F.col("mean_pred")) / F.sum("n")).alias("mean_fit"),
    )
    sized = joins.natural_join(serology.basis_sizes(short), sums, ["state"])
    score = lambda column, least: F.round(F.when(F.col("size") >= least, F.abs(column)), 6)
    return sized.select("state", "rounds", "size", "fitted_rounds", "share", "mean_fit", score(F.col("s0"), 1).alias("constant"), score(F.col("s1"), 2).alias("line"), score(F.col("s2"), 3).alias("parabola"))


@query
def poststratify(v: Views):
    return serology.poststratify(v.cases_daily(), v.geo(), v.sero_fit(), v.population(), dropped=(4,))


@query
def state_sero_counts(v: Views):
    rounds = serology.serosurvey_prepare(v.serosurvey()).select(
        "state", "week", "pop", (F.col("rate") * 100).alias("mean_sero"), F.col("n").cast("double").alias("suspected_covid_cases")
    )
    return serology.state_sero_counts(rounds, leave_out=("ASIA",))


@query
def immunity_share(v: Views):
    return flagship.immune_share(v)


@query
def immunity_effective(v: Views):
    """Coverage weighted by the lineage mix, units split, values above one missing."""
    cases = incidence.weekly_incidence(v.cases_daily(), population=v.population(), geo=v.geo(), per_capita=True)
    cases = cases.withColumn("se_incidence", F.col("mean_incidence") / 10)
    coverage = vaccination.coverage_lagged(v.vax_long(), units={})
    effect = variants.vaccine_effectiveness(variants.collapse_lineages(variants.lineage_shares(v.genomes())))
    sero = serology.poststratify(v.cases_daily(), v.geo(), v.sero_fit(), v.population()).select("week", "fips", "p_immune")
    return immunity.immunity(cases, coverage, sero, effect, apply_effectiveness=True, cap="null", units={21: 7, 22: 7})


def prevalence_by_state(v: Views):
    """One state on the second source alone, one on it until a week and on the survey after, the rest on the survey."""
    cases = incidence.weekly_incidence(v.cases_daily(), population=v.population(), geo=v.geo(), per_capita=True)
    survey = serology.poststratify(v.cases_daily(), v.geo(), v.sero_fit(), v.population())
    second = prevalence.interval_prevalence(v.county_draws(), variable="pred_county_cumulative_incidence")
    until = F.lit(datetime.date(1995, 6, 18))
    open_end = F.lit(None).cast("date")
    rules = [("EUROPE", "model", 1, open_end), ("ASIA", "model", 1, until), ("ASIA", "survey", 2, open_end)]
    row = lambda state, source, place, end: F.struct(F.lit(state).alias("state"), F.lit(source).alias("source"), F.lit(place).alias("place"), open_end.alias("since"), end.alias("until"))
    precedence = v.spark.range(1).select(F.inline(F.array(*[row(*r) for r in rules])))
    sources = {"survey": prevalence.survey_prevalence(survey), "model": second}
    return cases, prevalence.resolve_prevalence(cases.select("week", "fips", "state"), sources, precedence, "survey", ("survey",))


@query
def prevalence_sources(v: Views):
    """Which source each place takes in each week, with its value and error."""
    return prevalence_by_state(v)[1]


@query
def immunity_two_sources(v: Views):
    """Immune share where states differ in their source of seroprevalence."""
    cases, sero = prevalence_by_state(v)
    coverage = vaccination.partial_only(vaccination.vaccination_coverage(v.vax_long())).select(
        "week", "fips", F.col("Complete").alias("complete"), F.col("Partial").alias("partial")
    )
    return immunity.immunity(cases, coverage, sero, resolved=True)


@query
def sigma_breakdown(v: Views):
    cases = incidence.weekly_incidence(v.cases_daily(), population=v.population(), per_capita=True)
    coverage = vaccination.coverage_lagged(v.vax_long(), units={})
    sero = serology.poststratify(v.cases_daily(), v.geo(), v.sero_fit(), v.population())
    return immunity.sigma_breakdown(flagship.immune_share(v), coverage, cases, sero)


# Reproduction


def _r_ij(v: Views) -> DataFrame:
    """R_ij over the edge shares themselves, with a simple sigma."""
    coupled = v.weekly_edges().select("week", F.col(ORIGIN).alias("i"), F.col(DEST).alias("j"), F.col("prop_population").alias("mean"))
    sigma = v.weekly_means().filter(F.col("n_sample") % 11 != 0).select(
        "week", "fips", (F.col("n_contact") / 99).alias("mean_sigma")
    )
    bg = v.population().filter(F.col("fips") % 9 != 0).select("fips", (F.col("pop") / 49000).alias("bg"))
    return reproduction.pair_reproduction(coupled, sigma, flagship.multiplier(v), v.geo(), bg, left_out=(5,))


@query
def pair_reproduction(v: Views):
    return _r_ij(v)


@query
def total_reproduction(v: Views):
    return reproduction.total_reproduction(_r_ij(v))


@query
def import_risk(v: Views):
    return flagship.risk_chain(v, stage=settle)


@query
def chain_bias(v: Views):
    """All chains with their stages written and read back: mean Rt over the mean of the modelled risk."""
    return flagship.run_chains(v)["bg"].select("fips", *[F.round(c, 6).alias(c) for c in ("R_risk", "Rt", "bg")])


@query
def import_risk_of_shares(v: Views):
    return reproduction.import_risk(_r_ij(v), incidence.weekly_incidence(v.cases_daily()), 0)


@query
def import_risk_variance(v: Views):
    squared = _r_ij(v).select("i", "j", "week", (F.col("mean_R") * F.col("mean_R") / 100).alias("var_R"))
    return reproduction.import_risk_variance(squared, incidence.weekly_incidence(v.cases_daily()), 1)


@query
def renewal_rt(v: Views):
    return renewal.renewal_rt(incidence.weekly_incidence(v.cases_daily()))


@query
def renewal_rt_reference(v: Views):
    return renewal.renewal_rt(incidence.weekly_incidence(v.cases_daily()), start="1996-04-01", align="reference")


def _estimates(v: Views) -> DataFrame:
    """A table in the shape of the joined estimates, straight from the line items."""
    lines = v.visits(line_columns=("l_quantity", "l_discount"))
    return lines.groupBy("fips", dates.week_of(F.col("date")).alias("week")).agg(
        F.avg(F.col("l_quantity") / 25).alias("Rt"),
        F.avg(F.col("l_discount") * 20).alias("Ri"),
        F.count(F.lit(1)).alias("cases_j"),
    )


def _risk(v: Views) -> DataFrame:
    known = F.when(F.col("cases_j") % 5 != 0, F.col("Ri")).alias("Ri")
    return _estimates(v).select(F.col("fips").alias("j"), "week", known, "cases_j")


@query
def bias_ratios(v: Views):
    rt = renewal.renewal_rt(incidence.weekly_incidence(v.cases_daily()))
    return bias.bias_ratio(_risk(v), rt, "1996-12-01", "1999-02-01", min_incidence=1)


def _gappy_bias(v: Views) -> DataFrame:
    return v.population().filter((F.col("fips") % 4 != 1) & (F.col("fips") < 20)).select("fips", (F.col("pop") / 50000).alias("bg"))


@query
def neighbor_impute(v: Views):
    return bias.neighbor_impute(_gappy_bias(v), v.geo_neighbors(), v.geo(), collapse=[0, 1, 2], collapse_key=1)


@query
def neighbor_impute_second(v: Views):
    values = _gappy_bias(v).filter(F.col("fips") < 12)
    return bias.neighbor_impute(
        values, v.geo_neighbors(), v.geo(), second_pass="neighbors", collapse=[0, 1, 2], collapse_key=1
    )


@query
def state_fill(v: Views):
    return bias.fill_from_state(_gappy_bias(v), v.weekly_means().select("fips"), v.geo())


# Venues


@query
def poi_prepare(v: Views):
    """Two overlapping years of files; a place's maximum is known in some weeks only."""
    poi = v.poi_visits().withColumn("indoor_max_2019", F.when(F.month("date") == 5, F.col("indoor_max_2019")))
    early = poi.filter(F.year("date") <= 1998)
    late = poi.filter(F.year("date") >= 1998).withColumn("raw_visitor_counts_Outdoor", F.col("raw_visitor_counts_Outdoor") + 1)
    return venues.poi_prepare(early, late)


POI_LEAST = {"min_indoor": 1, "min_outdoor": 1, "min_maximum": 100}


def _poi(v: Views) -> DataFrame:
    """Odd places are always counted on both sides, so that some places are large enough."""
    poi = venues.poi_prepare(v.poi_visits())
    odd = F.col("fips") % 2 == 1
    return poi.withColumns(
        {c: F.when(odd, F.coalesce(c, F.lit(5.0))).otherwise(F.col(c)) for c in (venues.IN, venues.OUT)}
    )


@query
def small_sample_places(v: Views):
    return venues.small_sample_set(_poi(v), v.geo(), **POI_LEAST)


@query
def neighbor_pool(v: Views):
    targets = venues.small_sample_set(_poi(v), v.geo(), **POI_LEAST)
    return venues.neighbor_pool(_poi(v), v.geo_neighbors(), v.geo(), targets)


@query
def indoor_outdoor(v: Views):
    return venues.indoor_outdoor_ratio(_poi(v), v.geo_neighbors(), v.geo(), **POI_LEAST)


@query
def indoor_outdoor_dwell(v: Views):
    return venues.indoor_outdoor_ratio(_poi(v), v.geo_neighbors(), v.geo(), dwell=True, **POI_LEAST)


# Smoothing


def _monthly(v: Views) -> DataFrame:
    """Reports per place and month of 1995 to 2001, none where there are none."""
    month = (12 * (F.year("date") - 1995) + F.month("date")).cast("int")
    places_ = v.geo().select("fips", "state").withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(80))))
    counts = v.reports().groupBy("fips", month.alias("t")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return joins.natural_join(places_, counts, ["fips", "t"]).withColumn("y", F.coalesce("y", F.lit(0.0)))


@query
def spline_fixed_penalty(v: Views):
    """Smooth monthly reports of every place under a given penalty."""
    fitted = smoothing.spline_smooth(_monthly(v), "fips", "t", "y", knots=12, penalty=0.5)
    return fitted.withColumns({c: F.round(c, 5) for c in ("fit", "se_fit")})


@query
def spline_smooth(v: Views):
    indexed = panel.time_index(v.weekly_means(), "week", "t")
    return rounded(smoothing.smooth_observed(indexed.select("fips", "t", "n_contact"), "fips", "t", "n_contact"), 4)


@query
def panel_fixed_penalty(v: Views):
    """Quarterly reports as trend and deviations under given penalties; place 3 is a group of its own."""
    quarter = ((F.col("t") - 1) / 3 + 1).cast("int")
    group = F.when(F.col("fips") == 3, F.lit("ALONE")).otherwise(F.col("state"))
    rows = _monthly(v).groupBy(group.alias("state"), "fips", quarter.alias("t")).agg(F.sum("y").alias("y")).withColumn("w", F.lit(1.0))
    fitted = smoothing.panel_smooth(rows, "state", "fips", "t", "y", "w", 10, 6, 0.5, 8, group_penalty=0.3, entity_penalty=0.8)
    return fitted.select("state", "fips", "t", F.round("fit", 5).alias("fit"))


@query
def panel_smooth(v: Views):
    indexed = panel.time_index(v.weekly_means(), "week", "t")
    placed = joins.natural_join(indexed, v.geo().select("fips", "state"), ["fips"])
    return rounded(smoothing.panel_smooth(placed, "state", "fips", "t", "n_contact", "n_sample"), 4)


# Diagnostics


@query
def estimates_joined(v: Views):
    rt = _estimates(v).select("fips", "week", F.when(F.col("cases_j") % 3 != 0, F.col("Rt")).alias("Rt"))
    return diagnostics.join_estimates(rt, _risk(v))


@query
def shifted_estimates(v: Views):
    return diagnostics.shifted_compare(_risk(v), _estimates(v).select("fips", "week", "Rt"))


@query
def z_estimates(v: Views):
    return diagnostics.z_compare(_estimates(v))


@query
def forecast_errors(v: Views):
    return diagnostics.compare_forecasts(_estimates(v), limit=1.8)


@query
def residuals_by_state(v: Views):
    rows = joins.natural_join(_estimates(v), v.geo().select("fips", "state"), ["fips"])
    return diagnostics.residual_z(rows, ["state"], min_incidence=5)


@query
def residuals_scaled(v: Views):
    return diagnostics.residual_z(_estimates(v), ["fips"], scale="mean", min_incidence=5)


@query
def residuals_of_steps(v: Views):
    """Rt with a trend, so that its mean step is not zero."""
    trend = F.datediff("week", F.lit("1990-01-01").cast("date")) / 1000
    return diagnostics.residual_z(_estimates(v).withColumn("Rt", F.col("Rt") + trend), ["fips"], diff=True)


@query
def residuals_by_region(v: Views):
    regions = v.geo().select("fips", F.when(F.col("fips") % 4 != 0, F.concat(F.lit("R"), F.col("fips") % 3)).alias("region"))
    return diagnostics.region_rollup(_estimates(v), regions, scale="mean")


@query
def granger_tests(v: Views):
    return diagnostics.granger(_estimates(v))


@query
def granger_share(v: Views):
    return diagnostics.granger_share(diagnostics.granger(_estimates(v)), level=0.3)


@query
def estimate_correlation(v: Views):
    rows = joins.natural_join(_estimates(v), v.geo().select("fips", "state"), ["fips"])
    return diagnostics.group_correlation(rows, ["state"])


@query
def linear_trend(v: Views):
    return diagnostics.lm_trend(_estimates(v), ["fips"])

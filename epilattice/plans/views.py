"""Epidemic tables derived from the star-schema tables.

A place is a nation and its state a region; orders are case reports, line items are visits from the
customer's place to the supplier's place, and so on. The check SQL uses the same definitions.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import week_of
from ..functions.nulls import ratio

# Stated, so that no job has to look into the files first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def once(view):
    """Build a view's plan on first use and hand out the same lazy table afterwards."""

    @wraps(view)
    def get(self, *args):
        key = (view.__name__, *args)
        if key not in self.built:
            self.built[key] = view(self, *args)
        return self.built[key]

    return get


class Views:
    """Lazy views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.built: dict[tuple, DataFrame] = {}

    @once
    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        return reader.parquet(f"{self.folder}/{name}.parquet")

    # Dimensions

    @once
    def geo(self) -> DataFrame:
        nation = self.table("nation")
        region = self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("fips"), F.col("n_name").alias("name"), F.col("r_name").alias("state")
        )

    @once
    def geo_neighbors(self) -> DataFrame:
        """A ring of 25 places, both directions; every eighth place has no list of its own."""
        return (
            self.table("nation")
            .select(F.col("n_nationkey").alias("fips"))
            .filter(F.col("fips") % 8 != 0)
            .select("fips", F.explode(F.array((F.col("fips") + 1) % 25, (F.col("fips") + 24) % 25)).alias("neighb"))
        )

    @once
    def population(self) -> DataFrame:
        return (
            self.table("customer")
            .groupBy(F.col("c_nationkey").alias("fips"))
            .agg((F.count(F.lit(1)) * 1000).alias("pop"))
        )

    @once
    def household(self) -> DataFrame:
        return (
            self.table("customer")
            .groupBy(F.col("c_nationkey").alias("fips"))
            .agg(F.round(1 + F.avg("c_acctbal") / 5000, 3).alias("hh_size"))
        )

    # Facts

    @once
    def reports(self, *columns: str) -> DataFrame:
        """Orders with the place of their customer."""
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("fips"))
        kept = [F.col(c) for c in columns]
        return (
            self.table("orders")
            .join(customer, "o_custkey")
            .select("o_orderkey", "fips", F.col("o_orderdate").cast("date").alias("date"), *kept)
        )

    def visits(self, order_columns: tuple = (), line_columns: tuple = ()) -> DataFrame:
        """Line items with the place and the date of their order."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *line_columns)
        return lines.join(self.reports(*order_columns), "o_orderkey")

    @once
    def cases_daily(self) -> DataFrame:
        """Cumulative reports per place and day, with a downward correction on each 17th."""
        days = self.reports().groupBy("fips", "date").agg(F.count(F.lit(1)).alias("n"))
        running = F.sum("n").over(Window.partitionBy("fips").orderBy("date"))
        correction = F.when(F.dayofmonth("date") == 17, 3).otherwise(0)
        return days.select("date", "fips", (running - correction).alias("cases"))

    @once
    def daily_new(self) -> DataFrame:
        return self.reports().groupBy("fips", "date").agg(F.count(F.lit(1)).alias("cases"))

    @once
    def mobility_edges(self) -> DataFrame:
        supplier = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("destination_county_fips")
        )
        daily = (
            self.visits(line_columns=("l_suppkey", "l_quantity"))
            .join(supplier, "l_suppkey")
            .groupBy(F.col("fips").alias("origin_county_fips"), "destination_county_fips", "date")
            .agg(F.sum("l_quantity").alias("num_visits"))
        )
        # At most seven days times the number of destinations per window partition.
        week = Window.partitionBy("origin_county_fips", week_of(F.col("date")))
        return daily.withColumn("origin_total_num_visits", F.sum("num_visits").over(week))

    @once
    def weekly_edges(self) -> DataFrame:
        """Share of an origin's visits of a week that go to each destination."""
        edges = self.mobility_edges().withColumn("week", week_of(F.col("date")))
        return (
            edges.groupBy("week", "origin_county_fips", "destination_county_fips")
            .agg(F.sum("num_visits").alias("visits"), F.max("origin_total_num_visits").alias("total"))
            .select(
                "week", "origin_county_fips", "destination_county_fips",
                ratio(F.col("visits"), F.col("total")).alias("prop_population"),
            )
        )

    @once
    def genomes(self) -> DataFrame:
        places = self.geo().select("fips", "state")
        names = _by_priority("Alpha", "Delta", "Iota", "undefined", "Other")
        country = F.when(F.col("l_linenumber") == 7, "Canada").otherwise("USA")
        return (
            self.visits(("o_orderpriority",), ("l_shipdate", "l_linenumber", "l_returnflag"))
            .join(places, "fips")
            .select(
                F.col("l_shipdate").cast("date").alias("collection_date"),
                F.concat(F.lit("North America / "), country, F.lit(" / "), "state").alias("location"),
                F.concat(F.lit("VOC "), names, F.lit(" x")).alias("variant"),
                F.when(F.col("l_returnflag") == "R", "BA.1").otherwise("B.1").alias("pango_lineage"),
            )
        )

    @once
    def vax_long(self) -> DataFrame:
        kinds = _by_priority("Partial", "Complete", "Booster", "Partial Coverage", "Complete Coverage")
        return self.reports("o_orderpriority", "o_totalprice").select(
            F.col("date").alias("DATE"),
            F.col("fips").alias("COUNTY"),
            kinds.alias("CASE_TYPE"),
            (F.col("o_totalprice") / 4000).alias("CASES"),
            F.lit(100.0).alias("POPN"),
        )

    @once
    def poi_visits(self) -> DataFrame:
        """Indoor and outdoor visits per place and week, with the maxima of the place."""
        lines = self.visits(line_columns=("l_shipdate", "l_quantity", "l_returnflag", "l_linenumber"))
        lines = lines.withColumn("date", week_of(F.col("l_shipdate")))
        outdoor = F.col("l_returnflag") == "N"
        weekly = lines.groupBy("fips", "date").agg(
            F.sum(F.when(~outdoor, F.col("l_quantity"))).alias("raw_visitor_counts_Indoors"),
            F.sum(F.when(outdoor, F.col("l_quantity"))).alias("raw_visitor_counts_Outdoor"),
            F.avg(F.when(~outdoor, F.col("l_linenumber"))).alias("median_dwell_Indoors"),
            F.avg(F.when(outdoor, F.col("l_linenumber"))).alias("median_dwell_Outdoor"),
        )
        # One row per week and place: the window partition is bounded by the calendar.
        place = Window.partitionBy("fips")
        return weekly.select(
            F.col("fips").alias("countyFIPS"),
            "date",
            "raw_visitor_counts_Indoors",
            "raw_visitor_counts_Outdoor",
            F.max("raw_visitor_counts_Indoors").over(place).alias("indoor_max_2019"),
            F.max("raw_visitor_counts_Outdoor").over(place).alias("outdoor_max_2019"),
            "median_dwell_Indoors",
            "median_dwell_Outdoor",
        )

    @once
    def weekly_means(self) -> DataFrame:
        return (
            self.visits(line_columns=("l_quantity",))
            .groupBy(week_of(F.col("date")).alias("week"), "fips")
            .agg(F.avg("l_quantity").alias("n_contact"), F.count(F.lit(1)).alias("n_sample"))
        )

    @once
    def contact_fit(self) -> DataFrame:
        """Weekly contacts per place, scaled to a daily mean, in the shape of a smoothed fit."""
        return self.weekly_means().select(
            "week", "fips", (F.col("n_contact") / 7).alias("fit"), (1 / F.sqrt("n_sample")).alias("se_fit")
        )

    @once
    def serosurvey(self) -> DataFrame:
        """Monthly rounds per state; every thirteenth sample size stands for a suppressed rate."""
        first = F.trunc("date", "MM")
        rounds = (
            self.reports("o_orderstatus")
            .join(self.geo().select("fips", "state"), "fips")
            .groupBy("state", first.alias("first"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share"))
        )
        month = F.date_format("first", "MMM d")
        until = F.date_format(F.date_add("first", 13), "MMM d, yyyy")
        rate = F.when(F.col("n") % 13 == 0, F.lit(666.0)).otherwise(100 * F.col("share"))
        return rounds.select(
            F.col("state").alias("Site"),
            F.concat(month, F.lit(" - "), until).alias("Date Range of Specimen Collection"),
            rate.alias("Rate (%) [Cumulative Prevalence]"),
            F.col("n").alias("n [Cumulative Prevalence]"),
            (rate * F.col("n")).alias("Estimated cumulative infections count"),
            (rate * F.col("n") * 0.9).alias("Estimated cumulative infections lower CI"),
            (rate * F.col("n") * 1.1).alias("Estimated cumulative infections upper CI"),
            F.when(F.month("first") == 6, F.col("n") * 1000).alias("Catchment population"),
        )

    @once
    def sero_fit(self) -> DataFrame:
        """State share of closed reports per week, standing in for a fitted seroprevalence."""
        return (
            self.reports("o_orderstatus")
            .join(self.geo().select("fips", "state"), "fips")
            .groupBy(week_of(F.col("date")).alias("week"), "state")
            .agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("mean_pred"))
        )

    @once
    def county_draws(self) -> DataFrame:
        """Share of closed reports per place and week with an uneven interval, standing in for a model of each place.

        Weeks with a multiple of five reports are missing.
        """
        weekly = self.reports("o_orderstatus").groupBy(week_of(F.col("date")).alias("week"), "fips")
        shares = weekly.agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
        return shares.filter("n % 5 <> 0").select(
            F.lit("pred_county_cumulative_incidence").alias("variable"), "week", "fips", "mean",
            (F.col("mean") - 1.0 / (F.col("n") + 1)).alias("2.5%"), (F.col("mean") + 0.5 / (F.col("n") + 1)).alias("97.5%"),
        )

    @once
    def draws(self) -> DataFrame:
        """Model draws: one indexed variable for each element of the vectors, with one value per vector."""
        k = F.col("pos")
        name = F.concat(
            F.lit("mult["), (k % 5 + 1).cast("string"), F.lit(","), F.floor(k / 5 + 1).cast("string"), F.lit("]")
        )
        return (
            self.table("embeddings")
            .select("vec_id", F.posexplode("embedding").alias("pos", "x"))
            .select(F.col("vec_id").alias("draw"), name.alias("variable"), F.col("x").cast("double").alias("value"))
        )


def _by_priority(*labels: str) -> Column:
    """Label of an order by the leading digit of its priority."""
    digit = F.substring("o_orderpriority", 1, 1)
    out = F.lit(labels[-1])
    for k, label in reversed(list(enumerate(labels[:-1], 1))):
        out = F.when(digit == str(k), label).otherwise(out)
    return out

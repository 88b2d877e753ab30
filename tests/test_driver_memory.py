"""What a query sends to the driver stays within the session's own limits, on tables made here."""

import pytest
from pyspark.sql import functions as F

from epilattice.plans import flagship
from epilattice.plans.catalog import QUERIES, rounded
from epilattice.plans.views import SCHEMAS, Views
from epilattice.session import configure

LIMIT = "spark.sql.autoBroadcastJoinThreshold"
LEAST = 10 * 1024
ORDERS = 16000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders that take more than LEAST bytes with their place and day, two lines each, and small other tables."""
    path = tmp_path_factory.mktemp("tables")
    k = F.col("id")
    some = lambda seed, n: F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(n))
    day = lambda key: F.date_add(F.lit("1996-01-01").cast("date"), (key % 200).cast("int")).cast("timestamp_ntz")
    flag = F.element_at(F.array(*map(F.lit, "RNA")), some(5, 3).cast("int") + 1)
    values = {
        "region": (5, [k, F.concat(F.lit("R"), k)]),
        "nation": (25, [k, F.concat(F.lit("N"), k), k % 5]),
        "customer": (500, [k, F.lit("c"), k % 25, k * 7.0, F.lit("m")]),
        "supplier": (50, [k, F.lit("s"), k % 25, k * 1.0]),
        "orders": (ORDERS, [k, some(1, 500), F.lit("F"), some(2, 400000) * 1.0, day(k), F.concat(some(3, 5) + 1, F.lit("-X"))]),
        "lineitem": (2 * ORDERS, [k % ORDERS, k, some(4, 50), some(6, 7) + 1, some(7, 50) + 1.0, k * 1.0, some(8, 11) / 100, F.lit(0.0), flag, F.lit("O"), day(k % ORDERS)]),
    }
    for name, (rows, columns) in values.items():
        fields = [x.rsplit(" ", 1) for x in SCHEMAS[name].split(", ")]
        table = spark.range(rows).select(*[c.cast(kind).alias(n) for c, (n, kind) in zip(columns, fields, strict=True)])
        table.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture
def low_limit(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, str(LEAST))
    yield LEAST
    spark.conf.set(LIMIT, before)


def nodes(plan):
    """The plan that ran, with what lies below its stages."""
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(k) for k in range(plan.children().size())]
    for x in below:
        yield from nodes(x)


def broadcasts(df):
    """Rows of every table that the driver collected and sent out for a query."""
    assert df.collect()
    ran = nodes(df._jdf.queryExecution().executedPlan())
    return [x.metrics().apply("numOutputRows").value() for x in ran if x.getClass().getSimpleName() == "BroadcastExchangeExec"]


def test_the_limit_of_the_session_stands(spark, low_limit):
    assert configure(spark).conf.get(LIMIT) == str(low_limit)


@pytest.mark.parametrize("name", ["import_risk_of_shares", "import_risk_variance", "total_reproduction", "z_estimates"])
def test_no_broadcast_beyond_the_limit(spark, folder, low_limit, name):
    """The orders are beyond the limit; other tables are small or go as rows per place and week."""
    sent = broadcasts(QUERIES[name](spark, folder))
    assert sent and max(sent) < ORDERS


def test_import_risk_plans_one_stage_at_a_time(spark, folder):
    """The plan in one piece had thousands of nodes, all held by the driver; the rows are the same."""
    df = QUERIES["import_risk"](spark, folder)
    got = sorted(map(tuple, df.collect()))
    assert sum(1 for _ in nodes(df._jdf.queryExecution().executedPlan())) < 100
    assert got and got == sorted(map(tuple, rounded(flagship.risk_chain(Views(spark, folder))).collect()))

"""The account book under skew, with missing rows, and the plans behind it."""

from pathlib import Path

import duckdb
import pytest

from stayline.operators import metrics, survival
from stayline.plans import oracle, registry, views
from stayline.sources import order_history

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = ("nation", "customer", "part", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of the lines on one part, a third on one order, a third of the orders on one customer;
    customers without orders or of an unknown nation, orders without lines, lines whose part or order is unknown."""
    out = tmp_path_factory.mktemp("skewed")
    changed = {
        "nation": "SELECT * FROM t WHERE n_nationkey <> 4",
        "part": "SELECT * FROM t WHERE p_partkey <> 3",
        "customer": "SELECT * FROM t",
        "orders": """SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_custkey = 9 THEN 10 ELSE o_custkey END AS o_custkey)
            FROM t WHERE o_orderkey <> 21""",
        "lineitem": """SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey,
            CASE WHEN (l_orderkey + l_linenumber) % 3 = 1 THEN 11 ELSE l_orderkey END AS l_orderkey)
            FROM t WHERE l_orderkey <> 22""",
    }
    connection = duckdb.connect()
    for name in TABLES:
        select = changed[name].replace("FROM t", f"FROM '{SF_DIR}/{name}.parquet'")
        connection.execute(f"COPY ({select}) TO '{out}/{name}.parquet' (FORMAT parquet)")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet'")
    return str(out), connection


@pytest.mark.parametrize("name", ["raw_scan", "account_features", "decile_table"])
def test_skewed_tables_give_the_same_answers(spark, skewed, name):
    folder, connection = skewed
    frame = registry.queries()[name](spark, folder)
    result = connection.execute(oracle.statements()[name])
    names = [column[0] for column in result.description]
    assert sorted(map(repr, frame.select(*names).collect())) == sorted(
        map(repr, spark.createDataFrame(result.fetchall(), frame.select(*names).schema).collect())
    )


def test_hot_part_is_split_across_tasks(spark, skewed):
    folder, _ = skewed
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.files.maxPartitionBytes": "8k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet").repartition(16)
    part = spark.read.parquet(f"{folder}/part.parquet")
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        lines = order_history._line_facts(lineitem, part)
        rows = lines.collect()
        assert "skew=true" in lines._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, order_history._line_facts(lineitem, part).collect()))


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {line for line in plan.splitlines() if "Relation" in line}


def test_queries_read_only_the_tables_they_need(spark):
    accounts = registry.accounts(spark, str(SF_DIR))
    for frame in (metrics.portfolio_position(accounts), survival.kaplan_meier(accounts)):
        assert not [scan for scan in scans(frame) if "l_orderkey" in scan or "p_partkey" in scan]
    assert [scan for scan in scans(metrics.attachment_effect(accounts)) if "l_orderkey" in scan]


def test_no_cartesian_product_anywhere(spark):
    for name in ("account_features", "segment_performance", "logrank_covariance", "programme_options", "metrics_document"):
        frame = registry.queries()[name](spark, str(SF_DIR))
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_order_facts_are_hash_aggregates(spark):
    frame = registry.queries()["account_features"](spark, str(SF_DIR))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_account_frame_columns(spark):
    accounts = views.accounts_of(order_history.raw_accounts(spark, str(SF_DIR)))
    kinds = dict(accounts.dtypes)
    assert kinds["monthly_charges"] == "decimal(10,2)" and kinds["total_charges"] == "decimal(12,2)"
    assert kinds["arpu_realised"] == "double" and kinds["arpu_realised_2dp"] == "decimal(12,2)"
    assert kinds["addon_count"] == kinds["tenure_months"] == kinds["is_churned"] == "int"

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stayline.functions.columns import decile
from stayline.operators import ranking, targeting
from tests.frames import book, rows


@pytest.fixture
def many_slices(spark):
    """Keep every sorted partition, so that ranks really have to be put together."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "13")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_ranks_over_many_partitions(spark, many_slices):
    random.seed(3)
    # A third of all rows share one score, and a third one id.
    data = [(f"id{i % 3 and i:05d}", random.choice([0.5, random.random(), random.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "id string, score double")
    found = rows(ranking.ranked(df, F.desc("score"), "id"))
    assert sorted(row["rn"] for row in found) == list(range(1, 3001))
    assert {row["n"] for row in found} == {3000}
    in_rank_order = [(-row["score"], row["id"]) for row in sorted(found, key=lambda row: row["rn"])]
    assert in_rank_order == sorted((-score, name) for name, score in data)


def test_copies_spread_over_partitions(spark, many_slices):
    # All rows the same: only the row id can split them.
    copies = spark.range(0, 20000, 1, 8).select(F.lit("x").alias("id"), F.lit(0.5).alias("score"))
    placed = ranking.with_row_ids(copies).orderBy("score", "id", ranking.ROW)
    sizes = [row["count"] for row in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 13 and max(sizes) < 20000 / 13 * 2
    assert ranking.ranked(copies, "score", "id").agg(F.count_distinct("rn")).first()[0] == 20000


def test_no_account_window_runs_in_one_task(spark):
    df = spark.range(1000).select(F.col("id").cast("string"), F.rand(1).alias("score"))
    plan = ranking.ranked(df, "score")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    # The only windows are over the partition sizes.
    assert windows and all("size" in line for line in windows)


def sizes(spark, n):
    ranks = spark.range(1, n + 1).withColumn("n", F.lit(n))
    return [row["count"] for row in ranks.groupBy(F.expr(decile("id", "n")).alias("d")).count().orderBy("d").collect()]


def test_decile_sizes(spark):
    assert sizes(spark, 7043) == [705, 704, 704, 704, 705, 704, 704, 704, 704, 705]
    assert sizes(spark, 10) == [1] * 10
    assert sizes(spark, 1) == [1]
    assert sum(sizes(spark, 9)) == 9


def test_equal_scores_rank_by_id(spark):
    accounts = book(spark, *[{"customerID": name} for name in "dbca"]).withColumn("churn_probability", F.lit(0.5))
    found = {row["customer_id"]: row["risk_rank"] for row in rows(targeting.scored_accounts(accounts))}
    assert found == {"a": 1, "b": 2, "c": 3, "d": 4}


def brute_auc(pairs):
    wins = [(p > q) + (p == q) / 2 for p, left in pairs if left for q, stayed in pairs if not stayed]
    return sum(wins) / len(wins)


def test_auc_with_ties_and_groups(spark, many_slices):
    random.seed(5)
    data = [(random.choice("ab"), round(random.random(), 1), int(random.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(data, "split string, p double, y int")
    found = {row["split"]: row["auc"] for row in rows(ranking.auc(df, "p", "y", by="split"))}
    for split in "ab":
        assert found[split] == pytest.approx(brute_auc([(p, y) for s, p, y in data if s == split]), rel=1e-14)
    (overall,) = rows(ranking.auc(df, "p", "y"))
    assert overall["auc"] == pytest.approx(brute_auc([(p, y) for _, p, y in data]), rel=1e-14)
    (squared,) = rows(ranking.auc(df.withColumn("p", F.col("p") * F.col("p")), "p", "y"))
    assert squared == overall


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int")
    assert rows(ranking.auc(df, "p", "y")) == [{"auc": None}]


def test_split_takes_the_exact_share_of_each_stratum(spark, many_slices):
    # Class counts of the published book: 1,869 leavers of 7,043.
    df = spark.range(7043).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") < 1869).cast("int").alias("is_churned"))
    split = ranking.stratified_split(df)
    found = Counter((row["is_churned"], row["split"]) for row in rows(split))
    assert found == {(1, "test"): 561, (1, "train"): 1308, (0, "test"): 1552, (0, "train"): 3622}
    again = ranking.stratified_split(df.repartition(5))
    assert sorted(map(repr, rows(split))) == sorted(map(repr, rows(again)))
    other = ranking.stratified_split(df, seed=1)
    assert sorted(map(repr, rows(split))) != sorted(map(repr, rows(other)))


def test_split_is_exact_when_one_id_holds_a_third_of_the_rows(spark, many_slices):
    df = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS customer_id", "0 AS is_churned")
    found = Counter(row["split"] for row in rows(ranking.stratified_split(df)))
    assert found == {"test": 270, "train": 630}


def test_split_of_a_tiny_stratum(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "customer_id string, is_churned int")
    found = Counter((row["is_churned"], row["split"]) for row in rows(ranking.stratified_split(df)))
    assert found == {(1, "train"): 1, (0, "test"): 1, (0, "train"): 1}


def test_deciles_by_cut_keys_equal_deciles_by_rank(spark, many_slices):
    random.seed(9)
    scores = [None, float("nan"), 0.5, 0.5, -0.0, 0.0]
    data = [(random.choice(["hot", None, f"id{i}"]), random.choice([*scores, random.random()])) for i in range(997)]
    for size in (0, 1, 3, 9, 11, 997):
        df = spark.createDataFrame(data[:size], "customer_id string, churn_probability double")
        by_rank = targeting.scored_accounts(df).drop("risk_rank")
        by_cuts = targeting.with_deciles(df)
        assert by_cuts.dtypes == by_rank.dtypes
        assert sorted(map(repr, by_cuts.collect())) == sorted(map(repr, by_rank.collect()))


def test_wide_accounts_are_not_shuffled_for_deciles(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("customer_id"), F.rand(1).alias("churn_probability"), F.lit("x").alias("wide"))
    plan = targeting.with_deciles(df)._jdf.queryExecution().sparkPlan().toString()
    # The file scan is the only thing under the accounts; sorting happened on the key.
    assert "Exchange" not in plan.split("Subquery")[0]

import math

import pytest
from pyspark.sql import functions as F

from stayline.operators import logrank, survival
from stayline.sources import scratch
from tests.frames import book, lives, rows

# At-risk and leaver counts of months 0 to 72 of a published 7,043-account book.
AT_RISK = [
    7043, 7032, 6419, 6181, 5981, 5805, 5672, 5562, 5431, 5308, 5189, 5073, 4974, 4857, 4748, 4672, 4573, 4493, 4406,
    4309, 4236, 4165, 4102, 4012, 3927, 3833, 3754, 3675, 3603, 3546, 3474, 3402, 3337, 3268, 3204, 3139, 3051, 3001,
    2936, 2877, 2821, 2757, 2687, 2622, 2557, 2506, 2445, 2371, 2303, 2239, 2173, 2105, 2037, 1957, 1887, 1819, 1755,
    1675, 1610, 1543, 1483, 1407, 1331, 1261, 1189, 1109, 1033, 944, 846, 746, 651, 532, 362,
]
EVENTS = [
    0, 380, 123, 94, 83, 64, 40, 51, 42, 46, 45, 31, 38, 38, 24, 37, 28, 26, 24, 19, 18, 17, 27, 13, 23, 23, 15, 13, 12,
    15, 16, 16, 19, 14, 12, 15, 10, 15, 13, 14, 13, 14, 14, 15, 6, 6, 12, 14, 9, 15, 10, 8, 8, 14, 13, 9, 10, 8, 11, 8,
    6, 8, 5, 4, 4, 9, 13, 10, 9, 8, 11, 6, 6,
]


@pytest.fixture(scope="module")
def published(spark):
    counts = [(t, n, d) for t, (n, d) in enumerate(zip(AT_RISK, EVENTS))]
    return survival.curve(spark.createDataFrame(counts, "tenure_month int, at_risk bigint, events bigint")).cache()


def test_published_curve(published):
    found = {row["tenure_month"]: row for row in rows(published)}
    assert len(found) == 73
    expected = {
        1: (0.0540386803185438, 0.9459613196814562, 0.0026961846106099726, 0.9406767978446607, 0.9512458415182518),
        36: (0.0032776138970829235, 0.7485454148763729, 0.005744058431998145, 0.7372870603496565, 0.7598037694030894),
        72: (0.016574585635359115, 0.5927901520522304, 0.009918766870762761, 0.5733493689855353, 0.6122309351189255),
    }
    for month, values in expected.items():
        row = found[month]
        ours = [row[name] for name in ("hazard", "survival", "survival_se", "survival_lo", "survival_hi")]
        assert ours == pytest.approx(values, rel=1e-12)


def test_published_summaries(published):
    (peak,) = rows(survival.peak_hazard(published))
    assert peak == {"tenure_month": 1, "hazard": pytest.approx(0.0540386803185438)}
    (phases,) = rows(survival.hazard_phases(published))
    assert phases["early_mean_hazard"] == pytest.approx(0.01719, abs=5e-6)
    assert phases["late_mean_hazard"] == pytest.approx(0.00645, abs=5e-6)
    smooth = rows(survival.smoothed_hazard(published))
    assert smooth[0]["hazard_3m_mean"] == pytest.approx((0 + 380 / 7032) / 2)
    assert smooth[-1]["hazard_3m_mean"] == pytest.approx((6 / 532 + 6 / 362) / 2)


def test_month_that_everyone_leaves(spark):
    accounts = lives(spark, (1, 0), (2, 1), (3, 1), (3, 1))
    curve = rows(survival.kaplan_meier(accounts))
    assert [row["survival"] for row in curve] == pytest.approx([1.0, 2 / 3, 0.0])
    assert curve[-1]["survival_se"] == 0.0 and curve[-1]["survival_hi"] == 0.0
    assert [row["tenure_month"] for row in rows(survival.tenure_hazard(accounts))] == [1, 2]


def test_survival_stays_zero_after_it_got_there(spark):
    grid = spark.createDataFrame([(1, 2, 2), (2, 2, 1)], "tenure_month int, at_risk bigint, events bigint")
    assert [row["survival"] for row in rows(survival.curve(grid).orderBy("tenure_month"))] == [0.0, 0.0]


def test_median_not_reached_is_null(spark):
    accounts = lives(spark, (1, 1), (2, 0), (3, 0), (4, 0))
    assert rows(survival.median_survival(accounts)) == [{"median_tenure_months": None}]


def test_restricted_mean(spark):
    # Survival 1 until month 2, 3/4 until month 4, 3/8 until the horizon of 10.
    accounts = lives(spark, (2, 1), (3, 0), (4, 1), (20, 0))
    (row,) = rows(survival.restricted_mean(accounts, horizon=10))
    assert row["expected_months_to_horizon"] == pytest.approx(2 + 0.75 * 2 + 0.375 * 6)


def test_restricted_mean_without_a_point_before_the_horizon(spark):
    accounts = lives(spark, (70, 1), (80, 0))
    assert rows(survival.restricted_mean(accounts, horizon=60)) == [{"expected_months_to_horizon": 0.0}]


def test_groups_equal_separate_runs(spark):
    one = [(1, 1), (4, 0), (4, 1), (9, 0)]
    two = [(2, 0), (4, 1), (7, 1), (7, 0), (8, 1)]
    both = lives(spark, *one, Contract="One year").unionByName(lives(spark, *two, Contract="Two year"))
    found = rows(survival.kaplan_meier(both, "contract_type"))
    for name, pairs in (("One year", one), ("Two year", two)):
        alone = rows(survival.kaplan_meier(lives(spark, *pairs)))
        assert [{k: v for k, v in row.items() if k != "segment"} for row in found if row["segment"] == name] == alone
    summary = {row["segment"]: row for row in rows(survival.survival_summary(both))}
    assert summary["One year"]["customers"] == 4 and summary["Two year"]["churn_rate"] == 0.6


def test_curve_properties(spark):
    pairs = [((7 * i * i + 3 * i) % 40, i % 3 == 0) for i in range(200)]
    curve = rows(survival.kaplan_meier(lives(spark, *pairs)))
    assert curve[0]["at_risk"] == 200
    values = [row["survival"] for row in curve]
    assert all(1 >= a >= b >= 0 for a, b in zip(values, values[1:]))
    assert all(0 <= row["survival_lo"] <= row["survival"] <= row["survival_hi"] <= 1 for row in curve)


def by_definition(data):
    """Log-rank moments from draws without replacement: in each month, the leavers are a random draw of the accounts at
    risk. Every account leaves with the same chance, and two accounts leave together a little less often than alone."""
    import numpy as np

    groups = sorted({group for group, _, _ in data})
    member = np.array([[group == name for name in groups] for group, _, _ in data], dtype=float)
    tenure, left = np.array([t for _, t, _ in data]), np.array([bool(x) for _, _, x in data])
    observed, expected, covariance = 0, 0, 0
    for month in np.unique(tenure[left]):
        pool = member[tenure >= month]
        size, drawn = len(pool), int((left & (tenure == month)).sum())
        if size == 1:
            continue
        chance = drawn / size
        together = chance * (drawn - 1) / (size - 1) - chance**2
        draws = np.full((size, size), together) + np.eye(size) * (chance - chance**2 - together)
        observed = observed + member[left & (tenure == month)].sum(axis=0)
        expected = expected + chance * pool.sum(axis=0)
        covariance = covariance + pool.T @ draws @ pool
    return groups, list(observed), list(expected), covariance


def test_logrank_equals_its_definition(spark):
    data = [("ABCD"[(i * i + i // 3) % 4], (5 * i * i + i) % 23, i % 3 != 1) for i in range(90)]
    accounts = book(spark, *[{"Contract": g, "tenure": t, "Churn": "Yes" if e else "No"} for g, t, e in data])
    groups, observed, expected, cov = by_definition(data)
    terms = rows(logrank.logrank_terms(accounts))
    assert [row["segment"] for row in terms] == groups
    assert [row["observed"] for row in terms] == observed
    assert [row["expected"] for row in terms] == pytest.approx(expected)
    assert sum(observed) == pytest.approx(sum(expected))
    cells = {(row["segment"], row["peer"]): row["covariance"] for row in rows(logrank.logrank_covariance(accounts))}
    for i, a in enumerate(groups):
        for j, b in enumerate(groups):
            assert cells[a, b] == pytest.approx(cov[i][j], abs=1e-12)

    import numpy as np

    gap = np.array(observed) - np.array(expected)
    statistic = gap[:-1] @ np.linalg.pinv(np.array(cov)[:-1, :-1]) @ gap[:-1]
    (test,) = rows(logrank.logrank_test(accounts, groups=True))
    assert test["statistic"] == pytest.approx(statistic) and test["degrees_of_freedom"] == 3
    assert test["groups"] == groups


def test_logrank_without_leavers(spark):
    accounts = book(spark, {"Contract": "One year"}, {"Contract": "Two year"})
    (test,) = rows(logrank.logrank_test(accounts, groups=True))
    assert (test["statistic"], test["degrees_of_freedom"], test["p_value"]) == (0.0, 1, 1.0)


def test_logrank_of_many_segments(spark):
    """Two thousand segments: the same statistic as from the covariance of all of them."""
    import numpy as np

    data = [(f"plan {i % 2000:04}", (5 * i * i + i // 7) % 11, i % 3 != 1) for i in range(6000)]
    accounts = book(spark, *[{"Contract": g, "tenure": t, "Churn": "Yes" if e else "No"} for g, t, e in data])
    (test,) = rows(logrank.logrank_test(accounts, groups=True))
    groups, observed, expected, covariance = by_definition(data)
    gap = np.array(observed) - np.array(expected)
    statistic = gap[:-1] @ np.linalg.pinv(covariance[:-1, :-1], hermitian=True) @ gap[:-1]
    assert test["statistic"] == pytest.approx(statistic, rel=1e-9) and test["degrees_of_freedom"] == 1999
    assert test["groups"] == groups


def test_unreadable_tenures_are_left_out(spark):
    """Of four accounts the one without a readable tenure belongs to no curve."""
    accounts = lives(spark, (1, 1), (2, 0), (3, 0), (None, 1))
    assert [(r["tenure_month"], r["at_risk"], round(r["survival"], 6)) for r in rows(survival.kaplan_meier(accounts))] == [
        (1, 3, 0.666667), (2, 2, 0.666667), (3, 1, 0.666667)
    ]
    assert [r["tenure_month"] for r in rows(survival.tenure_hazard(accounts))] == [1, 2, 3]
    known = lives(spark, (1, 1), (2, 0), (3, 0))
    for curve in (lambda x: survival.restricted_mean(x, "contract_type"), logrank.logrank_terms, logrank.logrank_test):
        assert rows(curve(accounts)) == rows(curve(known))


def test_chi_square_tail():
    assert logrank.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert logrank.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert logrank.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert logrank.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert logrank.chi_square_tail(4.0, 2) == pytest.approx(math.exp(-2))
    assert logrank.chi_square_tail(0.0, 2) == 1.0


def test_accounts_without_a_segment_are_left_out(spark):
    accounts = lives(spark, (1, 1), (2, 0)).withColumn("team", F.when(F.col("tenure_months") == 1, "x"))
    assert [row["segment"] for row in rows(survival.survival_summary(accounts, "team"))] == ["x"]


def test_logrank_takes_five_jobs_from_a_written_book(spark):
    data = [("ABC"[i % 3], (5 * i * i + i) % 23, i % 3 != 1) for i in range(90)]
    accounts = scratch.table(book(spark, *[{"Contract": g, "tenure": t, "Churn": "Yes" if e else "No"} for g, t, e in data]), "book")
    spark.sparkContext.setJobGroup("logrank", "one test")
    logrank.logrank_test(accounts).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("logrank")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 5


def test_logrank_system_is_summed_over_tasks(spark):
    """More segments than a block and than tasks, in any partitioning: one statistic."""
    data = [(f"plan {i % 1500:04}", (3 * i * i + i // 5) % 17, i % 4 != 1) for i in range(4500)]
    accounts = scratch.table(book(spark, *[{"Contract": g, "tenure": t, "Churn": "Yes" if e else "No"} for g, t, e in data]), "book")
    found = [rows(logrank.logrank_test(some))[0] for some in (accounts, accounts.repartition(40))]
    assert found[0]["statistic"] == pytest.approx(found[1]["statistic"], rel=1e-9)
    assert found[0]["degrees_of_freedom"] == found[1]["degrees_of_freedom"] == 1499

import math
from pathlib import Path

import numpy as np
import pytest

from stayline.operators import model, targeting
from stayline.plans import registry, report
from stayline.sources import scratch
from tests.frames import book, rows

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("test tables are not here")
    split = model.split_accounts(registry.staged(spark, SF_DIR))
    return model.fit(split), split


def test_likelihood_equations_hold(fitted):
    found = {row["term"]: row["relative_residual"] for row in rows(model.likelihood_equations(*fitted))}
    assert set(found) == {"intercept", *fitted[0].weights} and len(found) == 21
    assert max(map(abs, found.values())) < 1e-8


def test_deciles_of_the_holdout_alone(fitted):
    scored = targeting.scored_accounts(fitted[0].score(fitted[1]), split="test")
    sizes = [row["customers"] for row in rows(targeting.decile_table(scored))]
    assert sizes == [45] * 10


def test_standard_errors_come_from_the_information_matrix(fitted):
    model_, split = fitted
    terms = model.design_terms(model_.levels)
    sample = model_.score(split).filter("split = 'train'")
    data = sample.selectExpr("churn_probability", *[f"{sql} AS `{t}`" for t, sql in terms.items()]).toPandas()
    p = data.pop("churn_probability").to_numpy()
    x = np.column_stack([np.ones(len(data)), data.to_numpy()])
    errors = np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)))
    assert [model_.standard_errors[term] for term in terms] == pytest.approx(errors[1:], rel=1e-5)


def test_pseudo_r2(fitted):
    model_, split = fitted
    train = model_.score(split).filter("split = 'train'")
    likelihood, rate, n = train.selectExpr(
        "sum(ln(CASE WHEN is_churned = 1 THEN churn_probability ELSE 1 - churn_probability END))", "avg(is_churned)", "count(1)"
    ).first()
    null = n * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    assert model_.pseudo_r2 == pytest.approx(1 - likelihood / null)


def test_fit_stats(fitted):
    model_, split = fitted
    (stats,) = rows(model.fit_stats(model_, model_.score(split)))
    assert (stats["n_train"], stats["n_test"]) == (1050, 450)
    assert 0.5 < stats["auc_test"] < 1 and 0.5 < stats["auc_train"] < 1


def test_design_terms(spark):
    accounts = book(
        spark,
        {"Contract": "Two year", "PaymentMethod": "Credit card (automatic)", "InternetService": "No"},
        {"Contract": "Month-to-month", "PaymentMethod": "Bank transfer (automatic)", "Partner": "Yes"},
    )
    matrix = model.design_matrix(accounts)
    # First levels and fields with a single level give no term.
    assert matrix.columns == [
        "customer_id",
        "tenure",
        "MonthlyCharges",
        "senior",
        "Contract_Two_year",
        "InternetService_No",
        "PaymentMethod_Credit_card_automatic",
        "Partner_Yes",
    ]
    first, second = sorted(rows(matrix), key=lambda row: row["customer_id"])
    assert list(first.values())[1:] == [10.0, 50.0, 0.0, 1.0, 1.0, 1.0, 0.0]
    assert list(second.values())[1:] == [10.0, 50.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_any_number_of_levels(spark):
    accounts = book(spark, *[{"Contract": f"plan {i}"} for i in range(5000)])
    assert len(model.category_levels(accounts)["Contract"]) == 5000


def test_report_writes_everything(spark):
    if not Path(SF_DIR).exists():
        pytest.skip("test tables are not here")
    out = scratch.path(spark, "report")
    report.run(registry.raw(spark, SF_DIR), out)

    def csv(name):
        return spark.read.option("header", True).csv(f"{out}/{name}")

    assert csv("tables/risk_deciles").count() == 10
    assert csv("tables/driver_odds_ratios").columns == ["term", "coefficient", "odds_ratio", "or_lo", "or_hi", "p_value"]
    assert csv("tables/breakeven_sensitivity").count() == 30
    assert csv("tables/programme_options").count() == 12
    assert csv("tables/survival_by_contract").count() == 3
    assert csv("tables/revenue_lost_by_segment").count() == 9
    extract = csv("extracts/fct_customer_risk")
    assert extract.count() == 1500 and len(extract.columns) == 12
    hazard = csv("tables/hazard_by_tenure_month")
    assert sorted(map(tuple, hazard.collect())) == sorted(map(tuple, csv("extracts/dim_tenure_hazard").collect()))
    assert spark.read.parquet(f"{out}/processed/customers.parquet").count() == 1500
    document = spark.read.json(f"{out}/metrics").first()
    assert document["data_quality"]["rows_in"] == document["portfolio"]["customers"] == 1500
    assert len(document["targeting"]["decile_table"]) == 10
    assert len(document["model"]["top_risk_terms"]) == len(document["model"]["top_protective_terms"]) == 6
    assert document["economics"]["recommended_option"]["net_value"] == max(
        option["net_value"] for option in document["economics"]["programme_options"]
    )


def test_field_models_of_hand_made_cells(spark):
    """Log odds from counts; a level that everybody left has no estimate, a field of one level no term."""
    changes = [{"Contract": c, "Churn": "Yes" if left else "No", "PaymentMethod": p} for c, p, left, n in [
        ("Month-to-month", "Mailed check", 1, 6), ("Month-to-month", "Electronic check", 0, 2),
        ("One year", "Mailed check", 1, 3), ("One year", "Electronic check", 0, 9), ("Two year", "Mailed check", 1, 4),
    ] for _ in range(n)]
    split = book(spark, *changes).selectExpr("*", "'train' AS split")
    found = {row["term"]: row for row in rows(model.field_odds_ratios(split))}
    assert set(found) == {"Contract_One_year", "Contract_Two_year", "PaymentMethod_Mailed_check"}
    one = found["Contract_One_year"]
    assert one["field"] == "Contract" and one["odds_ratio"] == pytest.approx((3 / 9) / (6 / 2))
    error = math.sqrt(1 / 3 + 1 / 9 + 1 / 6 + 1 / 2)
    assert one["or_hi"] == pytest.approx(one["odds_ratio"] * math.exp(1.959963984540054 * error))
    assert one["p_value"] == pytest.approx(math.erfc(abs(math.log(1 / 9)) / error / math.sqrt(2)))
    for term in ("Contract_Two_year", "PaymentMethod_Mailed_check"):
        assert [found[term][name] for name in ("coefficient", "odds_ratio", "or_lo", "or_hi", "p_value")] == [None] * 5
    assert rows(model.field_odds_ratios(split.where("false"))) == []


def test_field_models_equal_fitted_ones(spark, fitted):
    """The closed form is where the fit of one field ends."""
    closed = {row["term"]: row for row in rows(model.field_odds_ratios(fitted[1]))}
    one = rows(model.fit(fitted[1], ["PaymentMethod"]).coefficients(spark))
    assert len(one) == 3
    for row in one:
        for name in ("coefficient", "or_lo", "or_hi", "p_value"):
            assert closed[row["term"]][name] == pytest.approx(row[name], rel=1e-5)

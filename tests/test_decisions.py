"""Deciles, gains and economics against published results."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stayline.assumptions import DEFAULTS
from stayline.functions.columns import annuity
from stayline.operators import economics, model, survival, targeting
from tests.frames import rows

# Published deciles as customers, churners, revenue, churned revenue.
DECILES = [
    (705, 540, "59458.60", "45425.25"),
    (704, 412, "55803.30", "32497.55"),
    (704, 290, "50357.45", "20215.95"),
    (704, 241, "48373.05", "16658.05"),
    (705, 147, "44926.20", "9162.55"),
    (704, 117, "38496.10", "6427.45"),
    (704, 59, "45694.00", "4262.10"),
    (704, 38, "43735.80", "3021.30"),
    (704, 17, "40633.20", "958.15"),
    (705, 8, "28638.90", "502.50"),
]
MONTHS_GAINED = 23.83955275542064
# Published segments as churn rate, expected months, mean bill, lifetime value.
SEGMENTS = {
    "Month-to-month": (0.4270967741935484, 33.50207906991764, 66.39849032258066, 1280.8663547446624),
    "One year": (0.11269517990495587, 57.34163182533828, 65.04860828241684, 1930.6132834372881),
    "Two year": (0.02831858407079646, 59.86184792152745, 60.77041297935103, 1877.8072910290205),
}


@pytest.fixture(scope="module")
def deciles(spark):
    data = [
        (i, n, d, d / n, 0.5, Decimal(revenue), Decimal(lost)) for i, (n, d, revenue, lost) in enumerate(DECILES, start=1)
    ]
    schema = """decile int, customers bigint, churners bigint, churn_rate double, mean_probability double,
        monthly_revenue decimal(20,2), churn_revenue_monthly decimal(20,2)"""
    return targeting.with_gains(spark.createDataFrame(data, schema)).cache()


def test_lift_and_gains(deciles):
    found = rows(deciles)
    assert [row["lift_vs_base"] for row in found] == pytest.approx(
        [2.8863768313923703, 2.2053267425458434, 1.5522930954812975, 1.2900090896930785, 0.7857359152123674,
         0.6262699730045235, 0.315811353908264, 0.20340392285617004, 0.09099649180407607, 0.04276113824284993],
        rel=1e-12,
    )
    second, last = found[1], found[-1]
    assert second["cumulative_churners_pct"] == pytest.approx(0.5093632958801498)
    assert second["cumulative_base_pct"] == pytest.approx(0.20005679397983814)
    assert second["cumulative_churn_revenue_pct"] == pytest.approx(0.560068453545709)
    assert [last[name] for name in last if name.startswith("cumulative")] == [1.0, 1.0, 1.0]


def test_gains_curve_starts_at_the_origin(deciles):
    curve = rows(targeting.gains_curve(deciles))
    assert curve[0] == {"decile": 0, "base_share": 0.0, "revenue_share": 0.0, "is_target": False}
    assert len(curve) == 11 and [row["decile"] for row in curve if row["is_target"]] == [2]


def test_programme_options(deciles):
    options = rows(economics.programme_options(deciles, F.lit(MONTHS_GAINED)))
    assert list(options[0]) == list(economics.PROGRAMME_COLUMNS)
    expected_net = {
        (1, 0.10): 81262.6743094483, (1, 0.15): 45587.51430944831, (1, 0.20): 9912.354309448274,
        (2, 0.10): 120210.19190050318, (2, 0.15): 51053.05190050317, (2, 0.20): -18104.08809949679,
        (3, 0.10): 120200.43286515213, (3, 0.15): 20828.822852165147, (3, 0.20): -78542.78714783484,
        (4, 0.10): 107838.81935922825, (4, 0.15): -20556.620640771755, (4, 0.20): -148952.06064077176,
    }
    assert {(o["deciles_targeted"], o["offer_discount"]): o["net_value"] for o in options} == pytest.approx(expected_net)
    case = next(o for o in options if (o["deciles_targeted"], o["offer_discount"]) == (2, 0.10))
    assert case["customers_contacted"] == 1409 and case["wasted_contacts"] == 457
    assert case["monthly_churn_revenue_in_target"] == Decimal("77922.80")
    assert case["return_on_spend"] == pytest.approx(1.7744390296322359)
    assert case["offer_cost_per_contact"] == pytest.approx(110.16485450674236)
    assert case["margin_saved_per_save"] == pytest.approx(1157.2792936995932)
    assert case["breakeven_save_rate"] == pytest.approx(0.09519297122699491)


def test_recommended_and_base_case(deciles):
    (best,) = rows(economics.recommended_programme(economics.programme_options(deciles, F.lit(MONTHS_GAINED))))
    assert (best["deciles_targeted"], best["offer_discount"]) == (2, 0.10)
    assert best["save_rate_headroom"] == pytest.approx(0.25 / 0.09519297122699491)
    (case,) = rows(economics.programme_case(deciles, F.lit(MONTHS_GAINED)))
    assert (case["deciles_targeted"], case["offer_discount"]) == (2, 0.15)
    assert case["net_value"] == pytest.approx(51053.05190050317)


def test_offer_and_sensitivity(deciles):
    (offer,) = rows(economics.offer_breakeven(deciles, F.lit(MONTHS_GAINED)))
    assert offer["mean_bill"] == pytest.approx(81.8040454222853)
    assert offer["breakeven_save_rate"] == pytest.approx(0.13760488295874668)
    sweep = economics.breakeven_sensitivity(deciles, F.lit(MONTHS_GAINED))
    found = {(row["contribution_margin"], row["offer_discount"]): row["breakeven_save_rate"] for row in rows(sweep)}
    assert len(found) == 30
    assert found[0.50, 0.05] == pytest.approx(0.06861537734381608)
    assert found[0.65, 0.15] == pytest.approx(0.13760488295874668)
    assert found[0.75, 0.25] == pytest.approx(0.1927715455659502)
    matrix = rows(economics.breakeven_matrix(sweep))
    assert len(matrix) == 6 and matrix[0]["offer_5"] == found[0.50, 0.05] and matrix[5]["offer_25"] == found[0.75, 0.25]


def test_no_months_gained_never_breaks_even(deciles):
    (offer,) = rows(economics.offer_breakeven(deciles, F.lit(0.4)))
    assert offer["margin_saved_per_save"] == 0.0 and offer["breakeven_save_rate"] is None
    (best,) = rows(economics.recommended_programme(economics.programme_options(deciles, F.lit(0.4))))
    assert best["programme_benefit"] == 0.0 and best["save_rate_headroom"] is None


def test_lifetime_value_and_months_gained(spark):
    data = [(name, rate, months, bill) for name, (rate, months, bill, _) in SEGMENTS.items()]
    summary = spark.createDataFrame(
        data, "segment string, churn_rate double, expected_months_to_horizon double, mean_monthly_bill double"
    )
    found = {row["segment"]: row["lifetime_value"] for row in rows(economics.lifetime_value_by_segment(summary))}
    assert found == pytest.approx({name: value for name, (_, _, _, value) in SEGMENTS.items()})
    assert rows(survival.months_gained(summary)) == [{"months_gained": pytest.approx(MONTHS_GAINED)}]


@pytest.mark.parametrize("months, whole", [(2.5, 2), (3.5, 4), (0.5, 0), (0.51, 1), (-3.0, 0), (60.2, 60)])
def test_annuity_rounds_months_half_to_even(spark, months, whole):
    rate = DEFAULTS.monthly_discount_rate
    value = spark.range(1).selectExpr(f"{annuity(f'{months}D', rate)} AS v").first().v
    assert value == pytest.approx(sum((1 + rate) ** -m for m in range(1, whole + 1)))
    flat = spark.range(1).selectExpr(f"{annuity(f'{months}D', 0.0)} AS v").first().v
    assert flat == whole


def test_coefficient_table(spark):
    fitted = model.DriverModel(
        levels={},
        intercept=0.0,
        weights={"InternetService_Fiber_optic": 1.4768354953764475, "tenure": -0.03364612891104206, "custom_term": 0.0},
        standard_errors={"InternetService_Fiber_optic": 0.25134, "tenure": 0.00284, "custom_term": 1.0},
        pseudo_r2=0.0,
    )
    table = fitted.coefficients(spark)
    found = rows(table)
    assert [row["term"] for row in found] == ["InternetService_Fiber_optic", "custom_term", "tenure"]
    top = found[0]
    assert top["odds_ratio"] == pytest.approx(4.379066156492649)
    assert (top["or_lo"], top["or_hi"]) == pytest.approx((2.675756378168131, 7.166654094296758), rel=1e-3)
    assert top["p_value"] == pytest.approx(4.2026e-09, rel=1e-2)
    # Far tails keep their digits.
    assert 0 < found[-1]["p_value"] < 1e-30
    drivers = rows(model.significant_drivers(table))
    assert [(row["term"], row["label"]) for row in drivers] == [
        ("tenure", "Each additional month on book"),
        ("InternetService_Fiber_optic", "Fibre broadband"),
    ]
    (fallback,) = rows(model.significant_drivers(table, top=1, level=1.1).unionByName(
        table.filter("term = 'custom_term'").selectExpr("*", "0D AS distance", f"{model.term_label('term')} AS label")
    ).filter("term = 'custom_term'"))
    assert fallback["label"] == "custom term"
    assert [row["side"] for row in rows(model.top_terms(table, 1))] == ["risk", "protective"]
    assert math.isclose(found[1]["p_value"], 1.0)

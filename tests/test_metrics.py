from decimal import Decimal

import pytest

from stayline.operators import dashboard, metrics
from tests.frames import book, rows

LEAVER = {"Churn": "Yes"}


@pytest.fixture(scope="module")
def accounts(spark):
    fibre, none = {"InternetService": "Fiber optic"}, {"InternetService": "No", "Contract": "Two year"}
    return book(
        spark,
        {**fibre, **LEAVER, "MonthlyCharges": "100.00"},
        {**fibre, "MonthlyCharges": "60.00"},
        {**LEAVER, "MonthlyCharges": "40.00", "TechSupport": "Yes"},
        {**none, "MonthlyCharges": "20.00"},
    )


def test_portfolio(accounts):
    (row,) = rows(metrics.portfolio_position(accounts))
    assert row["mrr"] == Decimal("220.00") and row["arr"] == Decimal("2640.00")
    assert row["mrr_lost"] == Decimal("140.00") and row["arr_lost"] == Decimal("1680.00")
    assert row["churn_rate_accounts"] == 0.5 and row["churn_rate_revenue"] == 140 / 220
    assert row["avg_bill_leaver"] == 70.0 and row["avg_bill_stayer"] == 40.0


def test_empty_book_gives_nulls_not_errors(accounts):
    (row,) = rows(metrics.portfolio_position(accounts.filter("false")))
    assert row["accounts"] == 0 and row["churn_rate_accounts"] is None and row["churn_rate_revenue"] is None
    (risk,) = rows(metrics.revenue_at_risk(accounts.filter("false")))
    assert risk["monthly_revenue_lost"] == 0 and risk["mean_bill_churner"] is None


def test_segment_without_leavers_is_null_and_first(accounts):
    first, *others = rows(metrics.segment_performance(accounts))
    assert first["contract_type"] == "Two year"
    assert first["mrr_lost"] is None and first["cumulative_share_of_loss"] is None
    assert [row["cumulative_share_of_loss"] for row in others] == [100 / 140, 1.0]
    ranked = rows(metrics.loss_concentration(accounts))
    assert [(row["segment"], row["rank_by_loss"]) for row in ranked] == [
        ("Month-to-month / Fiber optic", 1),
        ("Month-to-month / DSL", 2),
    ]


def test_segment_without_leavers_lost_zero(accounts):
    found = {row["segment"]: row["monthly_revenue_lost"] for row in rows(metrics.segment_revenue_lost(accounts))}
    assert found == {
        "Month-to-month / fibre": Decimal("100.00"),
        "Month-to-month / DSL": Decimal("40.00"),
        "Two year / no internet": Decimal("0.00"),
    }
    assert len(rows(metrics.top_segments(accounts, 2))) == 2


def test_equal_losses_share_one_running_total(spark):
    tied = book(spark, LEAVER, {**LEAVER, "InternetService": "Fiber optic"})
    assert [row["cumulative_share_of_loss"] for row in rows(metrics.segment_performance(tied))] == [1.0, 1.0]


def test_attachment_against_base(accounts):
    found = {row["addon_count"]: row["vs_base_rate"] for row in rows(metrics.attachment_effect(accounts))}
    assert found == {0: pytest.approx(1 / 3 - 0.5), 1: 0.5}


def test_dashboard_filters_and_fixed_share(accounts):
    cells = dashboard.cells(accounts)
    (row,) = rows(dashboard.kpis(dashboard.apply_filters(cells, internet=["Fiber optic"])))
    assert row["accounts"] == 2 and row["churn_rate_accounts"] == 0.5
    assert row["leaver_premium"] == pytest.approx(100 / 60 - 1)
    (kept,) = rows(dashboard.loss_share(cells, ["internet_service"], internet=["Fiber optic"]))
    # Anchored to the whole book, not to the selection.
    assert kept["share_of_total_loss"] == 100 / 140 and kept["lift_vs_base"] == 1.0
    (quiet,) = rows(dashboard.kpis(dashboard.apply_filters(cells, contract=["Two year"])))
    assert quiet["mrr_lost"] is None and quiet["leaver_premium"] is None


def test_selection(accounts):
    (row,) = rows(dashboard.selection_quality(dashboard.cells(accounts)))
    assert row == {"customers": 4, "churners": 2, "precision_in_selection": 0.5, "wasted_contacts": 2}

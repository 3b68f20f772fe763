"""What churn costs: portfolio, segment, attachment and band KPIs.

Accounts are aggregated once; shares, running shares and base rates are windows over the
few grouped rows that remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..assumptions import DEFAULTS, Assumptions
from ..functions.columns import MONEY, grouped, literal, mean, money_or_zero, money_total, number, ratio

LEFT = "is_churned = 1"
STAYED = "is_churned = 0"

# Internet service levels as shown in segment labels.
INTERNET_LABELS = {"Fiber optic": "fibre", "No": "no internet"}


def _yearly(monthly: str) -> str:
    return f"CAST({monthly} * 12 AS {MONEY})"


# The definitions as SQL text: measures of a book, and columns over them. Views are made of the same text.
PORTFOLIO = {
    "accounts": "count(1)",
    "mrr": money_total("monthly_charges"),
    "churned_accounts": "sum(is_churned)",
    "churn_rate_accounts": mean("is_churned"),
    "mrr_lost": money_total("monthly_charges", LEFT),
    "avg_bill_leaver": mean("monthly_charges", LEFT),
    "avg_bill_stayer": mean("monthly_charges", STAYED),
}
PORTFOLIO_COLUMNS = (
    "accounts",
    "mrr",
    f"{_yearly('mrr')} AS arr",
    "churned_accounts",
    "churn_rate_accounts",
    "mrr_lost",
    f"{_yearly('mrr_lost')} AS arr_lost",
    f"{ratio('mrr_lost', 'mrr')} AS churn_rate_revenue",
    "avg_bill_leaver",
    "avg_bill_stayer",
)


def portfolio_position(accounts: DataFrame) -> DataFrame:
    return grouped(accounts, {}, PORTFOLIO).selectExpr(*PORTFOLIO_COLUMNS)


def revenue_at_risk(accounts: DataFrame, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    book = grouped(
        accounts,
        {},
        {
            "churned_customers": "coalesce(sum(is_churned), 0)",
            "monthly_revenue_lost": money_or_zero("monthly_charges", LEFT),
            "mrr": money_total("monthly_charges"),
            "mean_bill_churner": mean("monthly_charges", LEFT),
            "mean_bill_retained": mean("monthly_charges", STAYED),
        },
    )
    yearly = _yearly("monthly_revenue_lost")
    return book.selectExpr(
        "churned_customers",
        "monthly_revenue_lost",
        f"{yearly} AS annualised_revenue_lost",
        f"{yearly} * {number(assumptions.contribution_margin)} AS annualised_margin_lost",
        f"{ratio('monthly_revenue_lost', 'mrr')} AS share_of_book_monthly",
        "mean_bill_churner",
        "mean_bill_retained",
    )


SEGMENT_KEYS = {"contract_type": "contract_type", "internet_service": "internet_service"}
SEGMENT = {
    "accounts": "count(1)",
    "churned_accounts": "sum(is_churned)",
    "churn_rate": mean("is_churned"),
    "mrr": money_total("monthly_charges"),
    "mrr_lost": money_total("monthly_charges", LEFT),
    "avg_bill": mean("monthly_charges"),
    "avg_tenure": mean("tenure_months"),
    "avg_addons": mean("addon_count"),
}
# The running total's frame is by value: segments with the same loss are peers.
_RUNNING = "sum(mrr_lost) OVER (ORDER BY mrr_lost DESC NULLS FIRST)"
SEGMENT_COLUMNS = (
    "*",
    f"{ratio('mrr_lost', 'sum(mrr_lost) OVER ()')} AS share_of_total_loss",
    f"{ratio(_RUNNING, 'sum(mrr_lost) OVER ()')} AS cumulative_share_of_loss",
)
CONCENTRATED = "mrr_lost > 0"
CONCENTRATION_COLUMNS = (
    "contract_type || ' / ' || internet_service AS segment",
    "mrr_lost",
    "share_of_total_loss",
    "cumulative_share_of_loss",
    """row_number() OVER (ORDER BY mrr_lost DESC, contract_type || ' / ' || internet_service)
        AS rank_by_loss""",
)


def segment_performance(accounts: DataFrame) -> DataFrame:
    """By contract and internet service. A segment nobody left has NULL loss and sorts first."""
    return (
        grouped(accounts, SEGMENT_KEYS, SEGMENT)
        .selectExpr(*SEGMENT_COLUMNS)
        .orderBy(F.desc_nulls_first("mrr_lost"), "contract_type", "internet_service")
    )


def loss_concentration(accounts: DataFrame) -> DataFrame:
    return segment_performance(accounts).filter(CONCENTRATED).selectExpr(*CONCENTRATION_COLUMNS).orderBy("rank_by_loss")


def segment_label() -> str:
    cases = " ".join(f"WHEN {literal(level)} THEN {literal(label)}" for level, label in INTERNET_LABELS.items())
    return f"contract_type || ' / ' || CASE internet_service {cases} ELSE internet_service END"


def segment_revenue_lost(accounts: DataFrame) -> DataFrame:
    """By labelled segment. A segment nobody left has lost zero, not NULL."""
    return (
        grouped(
            accounts,
            {"segment": segment_label()},
            {
                "customers": "count(1)",
                "churn_rate": mean("is_churned"),
                "monthly_revenue_lost": money_or_zero("monthly_charges", LEFT),
            },
        )
        .filter("segment IS NOT NULL")
        .orderBy(F.desc("monthly_revenue_lost"), "segment")
    )


def top_segments(accounts: DataFrame, count: int = 8) -> DataFrame:
    return segment_revenue_lost(accounts).limit(count)


ATTACHMENT_KEYS = {"addon_count": "addon_count"}
ATTACHMENT = {
    "accounts": "count(1)",
    "churned_accounts": "sum(is_churned)",
    "churn_rate": mean("is_churned"),
    "avg_bill": mean("monthly_charges"),
    "avg_tenure": mean("tenure_months"),
}
ATTACHMENT_COLUMNS = (
    "addon_count",
    "accounts",
    "churn_rate",
    "avg_bill",
    "avg_tenure",
    f"churn_rate - {ratio('sum(churned_accounts) OVER ()', 'sum(accounts) OVER ()')} AS vs_base_rate",
)


def attachment_effect(accounts: DataFrame) -> DataFrame:
    """By number of add-ons, against the churn rate of the whole book."""
    return grouped(accounts, ATTACHMENT_KEYS, ATTACHMENT).selectExpr(*ATTACHMENT_COLUMNS).orderBy("addon_count")


def tenure_band_counts(accounts: DataFrame) -> DataFrame:
    return grouped(
        accounts,
        {"tenure_band": "tenure_band", "tenure_band_order": "tenure_band_order"},
        {"accounts": "count(1)", "churned_accounts": "sum(is_churned)", "churn_rate": mean("is_churned")},
    ).orderBy("tenure_band_order")

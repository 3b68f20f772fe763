"""Dashboard measures and the account-level extracts.

Every measure is a ratio of sums, so accounts are summed once into cells of the filter
dimensions; filters and filter-proof totals then work on those few cells.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..assumptions import DASHBOARD_DEFAULTS, DEFAULTS, Assumptions
from ..functions.columns import MONEY, grouped, money_total, named, number, quoted, ratio
from .economics import offer_cost

DIMENSIONS = ("contract_type", "internet_service", "tenure_band", "decile")


def cells(accounts: DataFrame) -> DataFrame:
    """Additive sums per combination of the filter dimensions the accounts carry."""
    return grouped(
        accounts,
        {name: name for name in DIMENSIONS if name in accounts.columns},
        {
            "accounts": "count(1)",
            "churned": "sum(is_churned)",
            "mrr": money_total("monthly_charges"),
            "mrr_lost": money_total("monthly_charges", "is_churned = 1"),
            "mrr_kept": money_total("monthly_charges", "is_churned = 0"),
        },
    )


def apply_filters(
    df: DataFrame,
    contract: Iterable[str] | None = None,
    internet: Iterable[str] | None = None,
    band: Iterable[str] | None = None,
    decile: Iterable[int] | None = None,
) -> DataFrame:
    """Keep the chosen values of each dimension; a dimension without a choice is left alone."""
    for name, chosen in zip(DIMENSIONS, (contract, internet, band, decile)):
        if chosen is not None:
            df = df.filter(F.col(name).isin(*chosen))
    return df


def kpis(selected: DataFrame) -> DataFrame:
    """The KPI row of a selection of cells."""
    sums = grouped(
        selected, {}, {name: f"sum({name})" for name in ("accounts", "churned", "mrr", "mrr_lost", "mrr_kept")}
    )
    leaver_bill, stayer_bill = ratio("mrr_lost", "churned"), ratio("mrr_kept", "(accounts - churned)")
    return sums.selectExpr(
        "accounts",
        f"CAST(mrr AS {MONEY}) AS mrr",
        f"{ratio('churned', 'accounts')} AS churn_rate_accounts",
        f"{ratio('mrr_lost', 'mrr')} AS churn_rate_revenue",
        f"CAST(mrr_lost AS {MONEY}) AS mrr_lost",
        f"CAST(mrr_lost * 12 AS {MONEY}) AS annualised_loss",
        f"{ratio(f'({leaver_bill})', f'({stayer_bill})')} - 1 AS leaver_premium",
    )


def loss_share(all_cells: DataFrame, by: Iterable[str], **filters) -> DataFrame:
    """Loss and churn of a selection against the whole book, which no filter narrows."""
    anchored = all_cells.selectExpr(
        "*",
        "sum(mrr_lost) OVER () AS book_lost",
        f"{ratio('sum(churned) OVER ()', 'sum(accounts) OVER ()')} AS book_rate",
    )
    rate = ratio("sum(churned)", "sum(accounts)")
    return grouped(
        apply_filters(anchored, **filters),
        {name: quoted(name) for name in by},
        {
            "mrr_lost": money_total("mrr_lost"),
            "share_of_total_loss": ratio("sum(mrr_lost)", "first(book_lost)"),
            "churn_rate": rate,
            "lift_vs_base": ratio(f"({rate})", "first(book_rate)"),
        },
    ).orderBy(*by)


def selection_quality(selected: DataFrame) -> DataFrame:
    """How much of a contact list would have left, and how much is wasted on stayers."""
    return grouped(
        selected,
        {},
        {
            "customers": "sum(accounts)",
            "churners": "sum(churned)",
            "precision_in_selection": ratio("sum(churned)", "sum(accounts)"),
            "wasted_contacts": "sum(accounts) - sum(churned)",
        },
    )


def simple_economics(
    selected: DataFrame, months_gained: Column, assumptions: Assumptions = DASHBOARD_DEFAULTS
) -> DataFrame:
    """Offer economics of a selection as the dashboard shows them: months are not discounted."""
    base = grouped(selected, {}, {"customers": "sum(accounts)", "mean_bill": ratio("sum(mrr)", "sum(accounts)")})
    offer = base.withColumn("months_gained", months_gained).selectExpr(
        "customers",
        f"{offer_cost('mean_bill', number(assumptions.offer_discount), assumptions)} AS offer_cost_per_contact",
        f"mean_bill * {number(assumptions.contribution_margin)} * months_gained AS margin_retained_per_save_simple",
    )
    return offer.selectExpr(
        "customers",
        "offer_cost_per_contact",
        "customers * offer_cost_per_contact AS programme_cost",
        "margin_retained_per_save_simple",
        f"{ratio('offer_cost_per_contact', 'margin_retained_per_save_simple')} AS breakeven_save_rate_simple",
    )


def account_action_list(
    scored: DataFrame, deciles: Iterable[int] | None = None, limit: int | None = None
) -> DataFrame:
    """Accounts to contact, largest bill first; a limit only where the reader asks for one."""
    chosen = range(1, DEFAULTS.targeting_deciles + 1) if deciles is None else deciles
    accounts = (
        apply_filters(scored, decile=chosen)
        .select("customer_id", "contract_type", "tenure_months", "monthly_charges", "churn_probability", "decile")
        .orderBy(F.desc("monthly_charges"), "customer_id")
    )
    return accounts if limit is None else accounts.limit(limit)


# Columns of the account extract and where they come from.
ACCOUNT_EXTRACT = {
    "customerID": "customer_id",
    "Contract": "contract_type",
    "InternetService": "internet_service",
    "PaymentMethod": "payment_method",
    "tenure": "tenure_months",
    "tenure_band": "tenure_band",
    "MonthlyCharges": "monthly_charges",
    "TotalCharges": "total_charges",
    "addon_count": "addon_count",
    "churned": "is_churned",
    "churn_probability": "churn_probability",
    "decile": "decile",
}


def customer_risk(scored: DataFrame) -> DataFrame:
    return scored.selectExpr(*named(ACCOUNT_EXTRACT))

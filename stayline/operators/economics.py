"""Whether a retention offer pays for itself.

Works on decile and segment tables. Parameter grids are arrays exploded on those few rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..assumptions import DEFAULTS, Assumptions
from ..functions.columns import annuity, grouped, number, ratio

PROGRAMME_COLUMNS = (
    "deciles_targeted",
    "offer_discount",
    "customers_contacted",
    "precision_in_target",
    "wasted_contacts",
    "share_of_base_contacted",
    "churners_captured",
    "share_of_churners_captured",
    "share_of_churn_revenue_captured",
    "monthly_churn_revenue_in_target",
    "assumed_save_rate",
    "programme_cost",
    "programme_benefit",
    "net_value",
    "return_on_spend",
    "offer_cost_per_contact",
    "margin_saved_per_save",
    "breakeven_save_rate",
    "months_gained",
)


def lifetime_value(monthly_bill: str, months: str, assumptions: Assumptions = DEFAULTS) -> str:
    """Discounted contribution over the expected months, as SQL text."""
    worth = annuity(months, assumptions.monthly_discount_rate)
    return f"CAST({monthly_bill} AS DOUBLE) * {number(assumptions.contribution_margin)} * ({worth})"


def lifetime_value_by_segment(summary: DataFrame, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    value = lifetime_value("mean_monthly_bill", "expected_months_to_horizon", assumptions)
    return summary.selectExpr("segment", f"{value} AS lifetime_value").orderBy("segment")


def offer_cost(mean_bill: str, offer: str, assumptions: Assumptions) -> str:
    """Discount held for the offer's duration, and one-off servicing."""
    return f"{mean_bill} * {offer} * {assumptions.offer_duration_months} + {number(assumptions.offer_servicing_cost)}"


def with_offer(df: DataFrame, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    """Cost per contact, margin per save and breakeven save rate of rows that carry
    ``mean_bill``, ``months_gained``, ``offer_discount`` and ``contribution_margin``."""
    worth = annuity("months_gained", assumptions.monthly_discount_rate)
    return df.selectExpr(
        "*",
        f"{offer_cost('mean_bill', 'offer_discount', assumptions)} AS offer_cost_per_contact",
        f"mean_bill * contribution_margin * ({worth}) AS margin_saved_per_save",
    ).selectExpr("*", f"{ratio('offer_cost_per_contact', 'margin_saved_per_save')} AS breakeven_save_rate")


def target(deciles: DataFrame, depths: Iterable[int]) -> DataFrame:
    """Per targeting depth, what the deciles up to it hold, beside what the whole base holds."""
    reached = f"filter(array({', '.join(map(str, depths))}), depth -> depth >= decile)"
    return grouped(
        # The base is summed before its rows are multiplied by depth.
        deciles.selectExpr(
            "*",
            "sum(customers) OVER () AS base_customers",
            "sum(churners) OVER () AS base_churners",
            "sum(churn_revenue_monthly) OVER () AS base_revenue",
        ).selectExpr("*", f"explode({reached}) AS deciles_targeted"),
        {"deciles_targeted": "deciles_targeted"},
        {
            "customers_contacted": "sum(customers)",
            "churners_captured": "sum(churners)",
            "monthly_churn_revenue_in_target": "sum(churn_revenue_monthly)",
            "base_customers": "first(base_customers)",
            "base_churners": "first(base_churners)",
            "base_revenue": "first(base_revenue)",
            "mean_bill": ratio("sum(monthly_revenue)", "sum(customers)"),
        },
    )


def _each(values: Iterable[float]) -> str:
    return f"explode(array({', '.join(map(number, values))}))"


def programme_options(
    deciles: DataFrame,
    months_gained: Column,
    depths: Iterable[int] | None = None,
    offers: Iterable[float] | None = None,
    save_rate: float | None = None,
    assumptions: Assumptions = DEFAULTS,
) -> DataFrame:
    """One row per targeting depth and offer. Every contact costs, only saved leavers pay."""
    depths = assumptions.option_depths if depths is None else depths
    offers = assumptions.option_offers if offers is None else offers
    save_rate = assumptions.assumed_save_rate if save_rate is None else save_rate
    grid = (
        target(deciles, depths)
        .selectExpr(
            "*",
            f"{_each(offers)} AS offer_discount",
            f"{number(assumptions.contribution_margin)} AS contribution_margin",
            f"{number(save_rate)} AS assumed_save_rate",
        )
        .withColumn("months_gained", months_gained)
    )
    return (
        with_offer(grid, assumptions)
        .selectExpr(
            "*",
            f"{ratio('churners_captured', 'customers_contacted')} AS precision_in_target",
            "customers_contacted - churners_captured AS wasted_contacts",
            f"{ratio('customers_contacted', 'base_customers')} AS share_of_base_contacted",
            f"{ratio('churners_captured', 'base_churners')} AS share_of_churners_captured",
            f"{ratio('monthly_churn_revenue_in_target', 'base_revenue')} AS share_of_churn_revenue_captured",
            "customers_contacted * offer_cost_per_contact AS programme_cost",
            "churners_captured * assumed_save_rate * margin_saved_per_save AS programme_benefit",
        )
        .selectExpr(
            "*",
            "programme_benefit - programme_cost AS net_value",
            f"{ratio('programme_benefit', 'programme_cost')} AS return_on_spend",
        )
        .select(*PROGRAMME_COLUMNS)
        .orderBy("deciles_targeted", "offer_discount")
    )


def programme_case(deciles: DataFrame, months_gained: Column, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    """The programme at its configured depth and offer."""
    depths, offers = (assumptions.targeting_deciles,), (assumptions.offer_discount,)
    return programme_options(deciles, months_gained, depths, offers, assumptions=assumptions)


def recommended_programme(options: DataFrame) -> DataFrame:
    """The option with the highest net value, and how far the save rate clears breakeven."""
    return (
        options.orderBy(F.desc_nulls_last("net_value"), "deciles_targeted", "offer_discount")
        .limit(1)
        .selectExpr("*", f"{ratio('assumed_save_rate', 'breakeven_save_rate')} AS save_rate_headroom")
    )


def offer_breakeven(deciles: DataFrame, months_gained: Column, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    """The configured offer made to the targeted deciles."""
    base = (
        target(deciles, [assumptions.targeting_deciles])
        .selectExpr(
            "mean_bill",
            f"{number(assumptions.offer_discount)} AS offer_discount",
            f"{number(assumptions.contribution_margin)} AS contribution_margin",
        )
        .withColumn("months_gained", months_gained)
    )
    return with_offer(base, assumptions).select(
        "mean_bill", "offer_cost_per_contact", "margin_saved_per_save", "breakeven_save_rate", "months_gained"
    )


def breakeven_sensitivity(deciles: DataFrame, months_gained: Column, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    """Breakeven save rate over contribution margins and offers, at the targeted mean bill."""
    grid = (
        target(deciles, [assumptions.targeting_deciles])
        .selectExpr("mean_bill", f"{_each(assumptions.swept_margins)} AS contribution_margin")
        .selectExpr("*", f"{_each(assumptions.swept_offers)} AS offer_discount")
        .withColumn("months_gained", months_gained)
    )
    return (
        with_offer(grid, assumptions)
        .select("contribution_margin", "offer_discount", "breakeven_save_rate")
        .orderBy("contribution_margin", "offer_discount")
    )


def breakeven_matrix(sensitivity: DataFrame, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    """Margins down, offers across; columns are named by the offer in per cent."""
    columns = [f"offer_{round(offer * 100)}" for offer in assumptions.swept_offers]
    return (
        sensitivity.selectExpr("*", "'offer_' || CAST(round(offer_discount * 100) AS INT) AS offer")
        .groupBy("contribution_margin")
        .pivot("offer", columns)
        .agg(F.first("breakeven_save_rate"))
        .orderBy("contribution_margin")
    )

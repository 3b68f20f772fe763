"""Who to contact: risk deciles, lift and gains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..assumptions import DEFAULTS
from ..functions.columns import decile, grouped, mean, money_or_zero, money_total, quoted, ratio
from . import selection
from .ranking import ranked

SCORE = "churn_probability"


def scored_accounts(accounts: DataFrame, split: str | None = None) -> DataFrame:
    """Add ``risk_rank`` (1 is the riskiest) and ``decile`` to scored accounts.

    Equal scores rank by customer id. With a split, only its accounts are ranked.
    """
    if split is not None:
        accounts = accounts.filter(F.col("split") == split)
    columns = accounts.columns
    return ranked(accounts, F.desc(SCORE), F.asc("customer_id")).selectExpr(
        *columns, "rn AS risk_rank", f"{decile('rn', 'n')} AS decile"
    )


def with_deciles(accounts: DataFrame, split: str | None = None) -> DataFrame:
    """Add ``decile`` alone to scored accounts, the same as ``scored_accounts`` gives, without sorting or moving them.

    The last key of each of the first nine tenths is selected by histograms, and the accounts are compared with it. They are
    read a few times: write them first if their scores are costly.
    """
    if split is not None:
        accounts = accounts.filter(F.col("split") == split)
    order = selection.Order(text="customer_id", value=f"-{SCORE}")
    last = selection.cuts(accounts, order, lambda size: [1 + (size - 1) * j // 10 for j in range(1, 10)])
    columns = [quoted(name) for name in accounts.columns]
    return selection.with_cuts_before(accounts, order, last, "_before").selectExpr(*columns, "_before + 1 AS decile")


def decile_table(scored: DataFrame) -> DataFrame:
    return with_gains(
        grouped(
            scored,
            {"decile": "decile"},
            {
                "customers": "count(1)",
                "churners": "sum(is_churned)",
                "churn_rate": mean("is_churned"),
                "mean_probability": mean(SCORE),
                "monthly_revenue": money_total("monthly_charges"),
                "churn_revenue_monthly": money_or_zero("monthly_charges", "is_churned = 1"),
            },
        )
    )


def with_gains(deciles: DataFrame) -> DataFrame:
    """Lift and cumulative shares over the decile rows."""

    def share(name: str) -> str:
        so_far = f"sum({name}) OVER (ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return ratio(so_far, f"sum({name}) OVER ()")

    base_rate = ratio("sum(churners) OVER ()", "sum(customers) OVER ()")
    return deciles.selectExpr(
        "decile",
        "customers",
        "churners",
        "churn_rate",
        "mean_probability",
        "monthly_revenue",
        f"{ratio('churn_rate', f'({base_rate})')} AS lift_vs_base",
        "churn_revenue_monthly",
        f"{share('churners')} AS cumulative_churners_pct",
        f"{share('customers')} AS cumulative_base_pct",
        f"{share('churn_revenue_monthly')} AS cumulative_churn_revenue_pct",
    ).orderBy("decile")


def gains_curve(deciles: DataFrame, depth: int = DEFAULTS.targeting_deciles) -> DataFrame:
    """Share of base against share of lost revenue, from the origin; the chosen depth is marked."""
    point = "struct(decile, cumulative_base_pct AS base_share, cumulative_churn_revenue_pct AS revenue_share)"
    origin = "struct(0 AS decile, 0D AS base_share, 0D AS revenue_share)"
    # The first decile brings the origin along, so the table is read once.
    return (
        deciles.selectExpr(f"inline(CASE WHEN decile = 1 THEN array({origin}, {point}) ELSE array({point}) END)")
        .selectExpr("*", f"decile = {depth} AS is_target")
        .orderBy("decile")
    )

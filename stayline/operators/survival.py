"""When accounts leave: hazards, Kaplan-Meier curves, restricted means.

Tenure is time on book, a leaver is an event at its tenure, everyone else is censored
there. All curves, of the whole book or of every group at once, come from one count per
(group, tenure month); windows then run over that grid, whose size is the number of
months and groups and not the number of accounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..assumptions import DEFAULTS
from ..functions.columns import grouped, literal, mean, money_total, number, quoted, ratio

# Fixed value: half-width of the confidence band in standard errors.
BAND_WIDTH = 1.96

CURVE_COLUMNS = (
    "tenure_month",
    "at_risk",
    "events",
    "hazard",
    "survival",
    "survival_se",
    "survival_lo",
    "survival_hi",
)


# The grid and its steps as SQL text; the view of the hazard is made of the same text.
GRID = {"accounts": "count(1)", "events": "sum(is_churned)", "billing": money_total("monthly_charges")}
HAZARD = "CAST(events AS DOUBLE) / at_risk AS hazard"
OCCUPIED = "at_risk > 0 AND events < at_risk"
HAZARD_COLUMNS = ("tenure_month", "at_risk", "events", "hazard", "survival")


def at_risk_column(by: str | None = None) -> str:
    return f"""sum(accounts) OVER ({_per_curve(by)}ORDER BY tenure_month DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk"""


def tenure_grid(accounts: DataFrame, by: str | None = None, unnamed: bool = False) -> DataFrame:
    """Accounts, leavers and billing per tenure month, optionally per segment; unreadable tenures are left out, and accounts
    without a segment unless ``unnamed``."""
    segment = {"segment": f"CAST({quoted(by)} AS STRING)"} if by else {}
    known = accounts.filter("tenure_months IS NOT NULL")
    if by and not unnamed:
        known = known.filter(f"{quoted(by)} IS NOT NULL")
    return grouped(
        known,
        {**segment, "tenure_month": "tenure_months"},
        GRID,
    )


def _keys(by: str | None) -> list[str]:
    return ["segment"] if by else []


def _per_curve(by: str | None) -> str:
    return "PARTITION BY segment " if by else ""


def with_at_risk(grid: DataFrame, by: str | None = None) -> DataFrame:
    """Everyone whose tenure reached the month: a running count from the longest tenure down."""
    return grid.selectExpr("*", at_risk_column(by))


def with_survival(at_risk: DataFrame, by: str | None = None) -> DataFrame:
    """Hazard of each month and the running product of the shares that stayed."""
    so_far = W.partitionBy(*_keys(by)).orderBy("tenure_month").rowsBetween(W.unboundedPreceding, W.currentRow)
    hazard = at_risk.selectExpr("*", HAZARD)
    return hazard.withColumn("survival", F.product(F.expr("1 - hazard")).over(so_far))


def curve(at_risk: DataFrame, by: str | None = None) -> DataFrame:
    """Hazard, survival and its band from at-risk and event counts per month.

    In a month everyone at risk leaves, survival reaches zero and the variance stops growing.
    """
    so_far = f"({_per_curve(by)}ORDER BY tenure_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    stayers = "CAST(at_risk - events AS DOUBLE)"
    variance = f"coalesce(events / (CAST(at_risk AS DOUBLE) * nullif({stayers}, 0D)), 0D)"
    steps = with_survival(at_risk, by).selectExpr("*", f"sum({variance}) OVER {so_far} AS greenwood")
    with_error = steps.selectExpr("*", "survival * sqrt(greenwood) AS survival_se")
    band = f"{number(BAND_WIDTH)} * survival_se"
    return with_error.selectExpr(
        "*",
        f"greatest(0D, survival - {band}) AS survival_lo",
        f"least(1D, survival + {band}) AS survival_hi",
    )


def whole_grid(grid: DataFrame) -> DataFrame:
    """The grid of all accounts from a grid by segment."""
    return grouped(grid, {"tenure_month": "tenure_month"}, {name: f"sum({name})" for name in GRID})


def curves(accounts: DataFrame, by: str | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Curves of accounts, or of a grid that is there already."""
    grid = tenure_grid(accounts, by) if grid is None else grid
    return curve(with_at_risk(grid, by), by)


def kaplan_meier(accounts: DataFrame, by: str | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Product-limit curve with Greenwood standard errors and 95 % band."""
    return curves(accounts, by, grid).select(*_keys(by), *CURVE_COLUMNS).orderBy(*_keys(by), "tenure_month")


def tenure_hazard(accounts: DataFrame) -> DataFrame:
    """Discrete-time hazard by month; months that everyone at risk leaves are left out."""
    kept = with_at_risk(tenure_grid(accounts)).filter(OCCUPIED)
    return with_survival(kept).select(*HAZARD_COLUMNS).orderBy("tenure_month")


def _per_segment(curve: DataFrame, by: str | None, measures: dict[str, str]) -> DataFrame:
    if not by:
        return grouped(curve, {}, measures)
    return grouped(curve, {"segment": "segment"}, measures).orderBy("segment")


def _with_area(curve: DataFrame, by: str | None, horizon: int) -> DataFrame:
    """Area of each step up to the horizon; the last step before it is held to it."""
    following = f"lead(tenure_month, 1, {horizon}) OVER ({_per_curve(by)}ORDER BY tenure_month)"
    return curve.selectExpr("*", f"least({following}, {horizon}) - tenure_month AS step_width")


def _restricted_mean(horizon: int) -> str:
    """Survival is one before the first point; no point up to the horizon gives zero."""
    inside = f"FILTER (WHERE tenure_month <= {horizon})"
    return f"coalesce(sum(survival * step_width) {inside} + min(tenure_month) {inside}, 0D)"


# First month at which at most half survive; NULL when that is never reached.
_MEDIAN = "CAST(min(tenure_month) FILTER (WHERE survival <= 0.5D) AS DOUBLE)"


def restricted_mean(accounts: DataFrame, by: str | None = None, horizon: int = DEFAULTS.horizon_months) -> DataFrame:
    """Expected months on book up to a horizon: the area under the curve."""
    return _per_segment(
        _with_area(curves(accounts, by), by, horizon), by, {"expected_months_to_horizon": _restricted_mean(horizon)}
    )


def median_survival(accounts: DataFrame, by: str | None = None, grid: DataFrame | None = None) -> DataFrame:
    return _per_segment(curves(accounts, by, grid), by, {"median_tenure_months": _MEDIAN})


def survival_summary(
    accounts: DataFrame, by: str = "contract_type", horizon: int = DEFAULTS.horizon_months, grid: DataFrame | None = None
) -> DataFrame:
    """Per segment: size, churn rate, median, restricted mean and mean bill, all from one grid."""
    return grouped(
        _with_area(curves(accounts, by, grid), by, horizon),
        {"segment": "segment"},
        {
            "customers": "sum(accounts)",
            "churn_rate": ratio("sum(events)", "sum(accounts)"),
            "median_tenure_months": _MEDIAN,
            "expected_months_to_horizon": _restricted_mean(horizon),
            "mean_monthly_bill": ratio("sum(billing)", "sum(accounts)"),
        },
    ).orderBy(F.desc("churn_rate"), "segment")


def months_gained(summary: DataFrame, start: str = "Month-to-month", target: str = "One year") -> DataFrame:
    """Expected months won by moving an account from one segment's curve to another's."""

    def months(name: str) -> str:
        return f"max(expected_months_to_horizon) FILTER (WHERE segment = {literal(name)})"

    return grouped(summary, {}, {"months_gained": f"{months(target)} - {months(start)}"})


def smoothed_hazard(curve: DataFrame) -> DataFrame:
    """Three-month centred mean of the hazard, narrower at the ends."""
    around = "(ORDER BY tenure_month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return curve.selectExpr("tenure_month", "hazard", f"avg(hazard) OVER {around} AS hazard_3m_mean").orderBy(
        "tenure_month"
    )


def peak_hazard(curve: DataFrame) -> DataFrame:
    return curve.select("tenure_month", "hazard").orderBy(F.desc("hazard"), "tenure_month").limit(1)


def hazard_phases(curve: DataFrame, early_until: int = 6, late_after: int = 36) -> DataFrame:
    """Plain means of the monthly hazard early and late in life."""
    return grouped(
        curve,
        {},
        {
            "early_mean_hazard": mean("hazard", f"tenure_month <= {early_until}"),
            "late_mean_hazard": mean("hazard", f"tenure_month > {late_after}"),
        },
    )

"""The whole analysis in one run: tables, extracts and one metrics document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..assumptions import DEFAULTS, Assumptions
from ..operators import dashboard, economics, logrank, metrics, model, quality, survival, targeting
from ..sources import scratch
from .views import create_staging


class Analysis:
    """Every result of one account book.

    The extract, the accounts, the scored accounts and the small tables other results rest on
    are written once and read back; everything else stays lazy on top of them. Accounts are scored by a model fitted to
    them, or by ``scorer``, which adds churn_probability; then there are no coefficients.
    """

    def __init__(
        self,
        raw: DataFrame,
        staging_path: str | None = None,
        assumptions: Assumptions = DEFAULTS,
        scorer: Callable[[DataFrame], DataFrame] | None = None,
    ):
        spark = raw.sparkSession
        # Read twice, for staging and for the quality log.
        self.raw = scratch.table(raw, "raw")
        self.assumptions = assumptions
        self.accounts = create_staging(self.raw, staging_path or scratch.path(spark, "customers"))

        # All curves come from one grid by contract and month.
        self.grid = scratch.table(survival.tenure_grid(self.accounts, "contract_type", unnamed=True), "grid")
        self.contract_grid = self.grid.filter("segment IS NOT NULL")
        self.hazard = survival.kaplan_meier(self.accounts, grid=survival.whole_grid(self.grid))
        self.survival_by_contract = scratch.table(
            survival.survival_summary(self.accounts, "contract_type", assumptions.horizon_months, self.contract_grid), "summary"
        )
        months = survival.months_gained(self.survival_by_contract).first().months_gained
        self.months_gained = F.lit(months).cast("double")

        self.model = self.coefficients = None
        if scorer:
            scores = scorer(self.accounts)
        else:
            split = model.split_accounts(self.accounts, assumptions)
            self.model = model.fit(split)
            self.coefficients = self.model.coefficients(spark)
            scores = self.model.score(split)
        # Written once: scores are read for the cuts, the deciles, the areas and the extracts.
        self.scored = targeting.with_deciles(scratch.table(scores, "scored"))
        self.deciles = scratch.table(targeting.decile_table(self.scored), "deciles")

        self.segments = metrics.segment_revenue_lost(self.accounts)
        self.options = scratch.table(
            economics.programme_options(self.deciles, self.months_gained, assumptions=assumptions), "options"
        )
        self.sensitivity = economics.breakeven_sensitivity(self.deciles, self.months_gained, assumptions)

    def tables(self) -> dict[str, DataFrame]:
        """Result tables, at most a few dozen rows each."""
        drivers = {"driver_odds_ratios": self.coefficients} if self.model else {}
        return {
            "hazard_by_tenure_month": self.hazard,
            "survival_by_contract": self.survival_by_contract,
            **drivers,
            "risk_deciles": self.deciles,
            "revenue_lost_by_segment": self.segments,
            "breakeven_sensitivity": self.sensitivity,
            "programme_options": self.options,
        }

    def extracts(self) -> dict[str, DataFrame]:
        return {
            "fct_customer_risk": dashboard.customer_risk(self.scored),
            "dim_tenure_hazard": self.hazard,
            "agg_risk_deciles": self.deciles,
            "dim_contract_curves": survival.kaplan_meier(self.accounts, "contract_type", self.contract_grid),
        }

    def metrics_document(self) -> DataFrame:
        """One nested row. Each part is a scalar subquery over a small result."""
        assumed = self.assumptions
        risk = metrics.revenue_at_risk(self.accounts, assumed)
        book = self.accounts.agg(
            F.count(F.lit(1)).alias("customers"), F.sum("monthly_charges").alias("monthly_recurring_revenue")
        )
        value = economics.lifetime_value_by_segment(self.survival_by_contract, assumed)
        parts = {
            "data_quality": _record(quality.quality_log(self.raw)),
            "book": _record(book),
            "risk": _record(risk),
            "median_tenure_overall": survival.median_survival(self.accounts, grid=survival.whole_grid(self.grid)).scalar(),
            "by_contract": _records(self.survival_by_contract, "churn_rate", descending=True),
            "logrank": _record(logrank.logrank_test(self.accounts, groups=True, grid=self.contract_grid)),
            "clv_by_contract": F.map_from_entries(_records(value, "segment")),
            **self._model_parts(),
            "decile_table": _records(self.deciles, "decile"),
            "top_decile_lift": self.deciles.filter("decile = 1").select("lift_vs_base").scalar(),
            "breakeven": _record(economics.offer_breakeven(self.deciles, self.months_gained, assumed)),
            "programme": _record(economics.programme_case(self.deciles, self.months_gained, assumed)),
            "programme_options": _records(self.options, "deciles_targeted", "offer_discount"),
            "recommended_option": _record(economics.recommended_programme(self.options)),
            "assumptions": F.struct(*[F.lit(getattr(assumed, name)).alias(name) for name in REPORTED_ASSUMPTIONS]),
        }
        one_row = self.raw.sparkSession.range(1)
        return one_row.select(*[part.alias(name) for name, part in parts.items()]).selectExpr(
            "data_quality",
            "struct(book.*, risk.*) AS portfolio",
            "struct(median_tenure_overall, by_contract, logrank, clv_by_contract) AS survival",
            *(["struct(fit.*, top_risk_terms, top_protective_terms) AS model"] if self.model else []),
            "struct(decile_table, top_decile_lift) AS targeting",
            """struct(breakeven.months_gained AS months_gained_on_contract_move, breakeven.mean_bill AS mean_bill_in_target,
                breakeven.offer_cost_per_contact, breakeven.margin_saved_per_save, breakeven.breakeven_save_rate,
                breakeven.months_gained, programme, programme_options, recommended_option, assumptions) AS economics""",
        )

    def _model_parts(self) -> dict[str, Column]:
        if not self.model:
            return {}
        top = model.top_terms(self.coefficients)
        return {
            "fit": _record(model.fit_stats(self.model, self.scored)),
            "top_risk_terms": _records(_side(top, "risk"), "odds_ratio", descending=True),
            "top_protective_terms": _records(_side(top, "protective"), "odds_ratio", descending=True),
        }


# Assumptions shown in the metrics document.
REPORTED_ASSUMPTIONS = (
    "contribution_margin",
    "discount_rate_annual",
    "offer_discount",
    "offer_duration_months",
    "offer_servicing_cost",
    "horizon_months",
)


def _side(terms: DataFrame, side: str) -> DataFrame:
    return terms.filter(F.col("side") == side).drop("side")


def _record(one_row: DataFrame) -> Column:
    return one_row.select(F.struct(*one_row.columns)).scalar()


def _records(few_rows: DataFrame, *order: str, descending: bool = False) -> Column:
    """A small table as an array of records in the given order."""
    keyed = F.struct(*order, F.struct(*few_rows.columns).alias("_record"))
    listed = F.sort_array(F.collect_list(keyed), asc=not descending)
    return few_rows.agg(F.transform(listed, lambda item: item["_record"])).scalar()


def run(raw: DataFrame, out: str, assumptions: Assumptions = DEFAULTS) -> Analysis:
    """Write customers, result tables, dashboard extracts and the metrics document below ``out``."""
    out = out.rstrip("/")
    analysis = Analysis(raw, f"{out}/processed/customers.parquet", assumptions)
    for name, table in analysis.tables().items():
        _write_csv(table.coalesce(1), f"{out}/tables/{name}")
    for name, extract in analysis.extracts().items():
        # The account extract grows with the book and keeps its partitions.
        _write_csv(extract if name == "fct_customer_risk" else extract.coalesce(1), f"{out}/extracts/{name}")
    analysis.metrics_document().coalesce(1).write.mode("overwrite").json(f"{out}/metrics")
    return analysis


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

"""Named queries over the order-history tables, one per operator.

Each takes a session and a table folder and derives the account book from whole tables.
Doubles are rounded to six places, so that two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import lenient_whole, literal, quoted
from ..operators import (
    dashboard,
    economics,
    logrank,
    metrics,
    model,
    quality,
    ranking,
    staging,
    survival,
    targeting,
)
from ..sources import extract, order_history, scratch
from . import views
from .report import Analysis

Query = Callable[[SparkSession, str], DataFrame]

# A scorecard, so that ranking and targeting have exact expected results.
SCORECARD_INTERCEPT = 8.0
SCORECARD = {
    "tenure": -0.0336,
    "MonthlyCharges": -0.0242,
    "senior": 0.2163,
    "Contract_One_year": -0.7083,
    "Contract_Two_year": -1.298,
    "InternetService_Fiber_optic": 1.4768,
    "InternetService_No": -1.4435,
    "PaymentMethod_Credit_card_automatic": 0.0224,
    "PaymentMethod_Electronic_check": 0.436,
    "PaymentMethod_Mailed_check": -0.0045,
    "OnlineSecurity_Yes": -0.2438,
    "TechSupport_Yes": -0.2359,
    "OnlineBackup_Yes": 0.0349,
    "DeviceProtection_Yes": 0.0979,
    "StreamingTV_Yes": 0.5544,
    "StreamingMovies_Yes": 0.4837,
    "MultipleLines_Yes": 0.4093,
    "PaperlessBilling_Yes": 0.346,
    "Partner_Yes": -0.0751,
    "Dependents_Yes": -0.1465,
}
# Levels the scorecard distinguishes, reference level first.
SCORECARD_LEVELS = {
    "Contract": ["Month-to-month", "One year", "Two year"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "PaymentMethod": [
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ],
    **{field: ["No", "Yes"] for field in model.YES_NO_FIELDS},
}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_history.raw_accounts(spark, sf_dir)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.accounts_of(raw(spark, sf_dir))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts written once, for queries that read them more than once."""
    return scratch.table(accounts(spark, sf_dir), "customers")


def with_scorecard(book: DataFrame) -> DataFrame:
    """Scorecard probabilities to nine places: accounts with the same points must tie in any engine."""
    scores = model.with_score(book, SCORECARD, SCORECARD_INTERCEPT, SCORECARD_LEVELS)
    return scores.withColumn("churn_probability", F.expr("floor(churn_probability * 1e9D + 0.5D) / 1e9D"))


def scored(book: DataFrame) -> DataFrame:
    return targeting.scored_accounts(_scorecard_scores(book))


def in_deciles(book: DataFrame, *columns: str) -> DataFrame:
    """The named columns of scored accounts, written once, and their decile."""
    names = dict.fromkeys(["customer_id", "churn_probability", *columns])
    return targeting.with_deciles(scratch.table(with_scorecard(book).select(*names), "scores"))


def deciles(book: DataFrame) -> DataFrame:
    return targeting.decile_table(in_deciles(book, "is_churned", "monthly_charges"))


def gained(book: DataFrame) -> Column:
    return survival.months_gained(survival.survival_summary(book)).scalar()


def _on_accounts(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(accounts(spark, sf_dir))


def _on_staged(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(staged(spark, sf_dir))


def _on_programme(operator: Callable[[DataFrame, Column], DataFrame]) -> Query:
    return _on_staged(lambda book: operator(deciles(book), gained(book)))


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch.path(spark, "extract")
    extract.write_csv(raw(spark, sf_dir), where)
    return extract.read_csv(spark, where).select(*extract.FIELDS).withColumns({name: F.expr(lenient_whole(name)) for name in ("SeniorCitizen", "tenure")})


def quality_log_of_damaged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality log of the accounts as a CSV file in which some lines end after five fields and some have one too many."""
    book = raw(spark, sf_dir)
    fields = ", ".join(f"CAST({name} AS STRING)" for name in extract.FIELDS)
    line = f"concat_ws(',', {fields})"
    lines = book.selectExpr(
        f"""CASE CAST(customerID AS BIGINT) % 50 WHEN 3 THEN substring_index({line}, ',', 5) WHEN 7 THEN {line} || ',more'
            ELSE {line} END AS value"""
    )
    where = scratch.path(spark, "damaged")
    # Read without quotes, so that the lines are written as they are, below a header in each file.
    lines.withColumnRenamed("value", ",".join(extract.FIELDS)).write.options(header=True, quote="", sep="\u0001").csv(where)
    return quality.quality_log(extract.read_csv(spark, where))


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts staged from a view whose columns are all text."""
    as_text = raw(spark, sf_dir)
    as_text.select([as_text[name].cast("string").alias(name) for name in as_text.columns]).createOrReplaceTempView("raw_accounts")
    return staging.stage(extract.read_table(spark, "raw_accounts"))


def sink_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.create_staging(raw(spark, sf_dir), scratch.path(spark, "processed"))


def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = survival.kaplan_meier(accounts(spark, sf_dir))
    where = scratch.path(spark, "table")
    table.coalesce(1).write.option("header", True).csv(where)
    return spark.read.schema(table.schema).option("header", True).csv(where)


def kpi_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.create_staging(raw(spark, sf_dir), scratch.path(spark, "processed"))
    views.create_views(spark)
    return _all_kpis(spark)


def kpi_views_permanent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI views of the catalog over a catalog table, as another session reads them."""
    suffix = "_" + uuid4().hex
    source = f"stg_customers{suffix}"
    views.save_staging(raw(spark, sf_dir), source, scratch.path(spark, "saved"))
    views.create_permanent_views(spark, source, suffix)
    return _all_kpis(spark.newSession(), suffix)


def _all_kpis(spark: SparkSession, suffix: str = "") -> DataFrame:
    return spark.sql(
        f"""
        SELECT 'portfolio' AS kpi, 'book' AS member, mrr_lost AS lost, churn_rate_accounts AS rate
        FROM vw_portfolio_position{suffix}
        UNION ALL
        SELECT 'segment', concat(contract_type, ' / ', internet_service), mrr_lost, churn_rate
        FROM vw_segment_performance{suffix}
        UNION ALL
        SELECT 'concentration', segment, mrr_lost, share_of_total_loss FROM vw_loss_concentration{suffix}
        UNION ALL
        SELECT 'attachment', cast(addon_count AS string), NULL, churn_rate FROM vw_attachment_effect{suffix}
        UNION ALL
        SELECT 'hazard', cast(tenure_month AS string), NULL, hazard FROM vw_tenure_hazard{suffix}
        """
    )


def _scorecard_scores(book: DataFrame) -> DataFrame:
    return with_scorecard(book).select("customer_id", "churn_probability")


def _score_aucs(book: DataFrame) -> DataFrame:
    scores = scratch.table(with_scorecard(book).select("customer_id", "is_churned", "churn_probability"), "scores")
    return ranking.auc(ranking.stratified_split(scores), "churn_probability", "is_churned", by="split")


def _selection(book: DataFrame) -> DataFrame:
    dimensions = [name for name in dashboard.DIMENSIONS if name != "decile"]
    rows = in_deciles(book, *dimensions, "is_churned", "monthly_charges")
    return dashboard.apply_filters(dashboard.cells(rows), decile=[1, 2])


def _action_list(book: DataFrame) -> DataFrame:
    return dashboard.account_action_list(in_deciles(book, "contract_type", "tenure_months", "monthly_charges"))


def _customer_risk(book: DataFrame) -> DataFrame:
    columns = [name for name in dashboard.ACCOUNT_EXTRACT.values() if name != "decile"]
    return dashboard.customer_risk(in_deciles(book, *columns))


def _contract_model(book: DataFrame) -> tuple[model.DriverModel, DataFrame]:
    """A model of one field: its maximum is known in closed form."""
    split = model.split_accounts(scratch.table(book.select("customer_id", "is_churned", "contract_type"), "labels"))
    return model.fit(split, ["Contract"]), split


def _contract_coefficients(book: DataFrame) -> DataFrame:
    return _contract_model(book)[0].coefficients(book.sparkSession)


def _contract_fit_stats(book: DataFrame) -> DataFrame:
    fitted, split = _contract_model(book)
    return model.fit_stats(fitted, fitted.score(split))


def _field_models(book: DataFrame) -> DataFrame:
    """Models of each field alone: more terms than the reports show."""
    columns = ("customer_id", "is_churned", *model.TEXT_FIELDS.values(), *model.YES_NO_FIELDS.values())
    return model.field_odds_ratios(model.split_accounts(scratch.table(book.select(*columns), "fields")))


def _fitted(book: DataFrame) -> tuple[model.DriverModel, DataFrame]:
    split = model.split_accounts(book)
    return model.fit(split), split


def _coefficients(book: DataFrame) -> DataFrame:
    return _fitted(book)[0].coefficients(book.sparkSession)


def _fit_stats(book: DataFrame) -> DataFrame:
    fitted, split = _fitted(book)
    return model.fit_stats(fitted, fitted.score(split))


def _likelihood_equations(book: DataFrame) -> DataFrame:
    return model.likelihood_equations(*_fitted(book))


def _metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analysis(raw(spark, sf_dir)).metrics_document()


#: Records of the metrics document that rest on no fitted model.
DOCUMENT_PARTS = {
    "quality": "data_quality",
    "risk": "portfolio",
    "logrank": "survival.logrank",
    "programme": "economics.programme",
    "recommended": "economics.recommended_option",
}


def _metrics_document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics document of scorecard scores, with its records as columns."""
    document = Analysis(raw(spark, sf_dir), scorer=with_scorecard).metrics_document()
    shown = []
    for prefix, path in DOCUMENT_PARTS.items():
        record = document.select(f"{path}.*").columns
        shown += [f"{path}.{name} AS {prefix}_{name}" for name in record if name not in DOCUMENT_OWN]
    return document.selectExpr(*shown, "targeting.top_decile_lift AS lift_vs_base")


#: Lists and maps of the document that rest on no fitted model.
DOCUMENT_LISTS = {
    "by_contract": "survival.by_contract",
    "clv_by_contract": "map_entries(survival.clv_by_contract)",
    "decile_table": "targeting.decile_table",
    "programme_options": "economics.programme_options",
}
#: Records and single values, all of their fields.
DOCUMENT_RECORDS = {
    "data_quality": "data_quality.*",
    "portfolio": "portfolio.*",
    "survival": "survival.median_tenure_overall",
    "logrank": "survival.logrank.*",
    "targeting": "targeting.top_decile_lift",
    "economics": "economics.*",
    "programme": "economics.programme.*",
    "recommended_option": "economics.recommended_option.*",
    "assumptions": "economics.assumptions.*",
}


def _cells(rows: DataFrame, part: str) -> DataFrame:
    """One row for each field of each record: numbers as doubles, anything else as text."""
    plain = [name for name, kind in rows.dtypes if name != "place" and not kind.startswith(("struct", "map", "array<struct"))]
    as_text = [
        f"{f'array_join({quoted(name)}, {literal(chr(124))})' if rows.schema[name].dataType.typeName() == 'array' else f'CAST({quoted(name)} AS STRING)'} AS {quoted(name)}"
        for name in plain
    ]
    cells = rows.selectExpr("place", *as_text).unpivot(["place"], plain, "field", "value")
    number = "try_cast(value AS DOUBLE)"
    return cells.selectExpr(
        f"{literal(part)} AS part", "place", "field", f"{number} AS number", f"CASE WHEN {number} IS NULL THEN value END AS text"
    )


def _document_cells(document: DataFrame, records: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """Every value of a metrics document, with its part, place in a list and field."""
    document = scratch.table(document, "document")
    parts = [_cells(document.selectExpr("0 AS place", path), part) for part, path in records.items()]
    for part, path in lists.items():
        listed = document.selectExpr(f"posexplode({path}) AS (place, record)").selectExpr("place", "record.*")
        parts.append(_cells(listed, part))
    return reduce(DataFrame.unionByName, parts)


def _metrics_document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics document of scorecard scores."""
    document = Analysis(raw(spark, sf_dir), scorer=with_scorecard).metrics_document()
    return _document_cells(document, DOCUMENT_RECORDS, DOCUMENT_LISTS)


def _metrics_document_fitted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics document as it is, its scores from the fitted model."""
    sides = {f"top_{side}_terms": f"model.top_{side}_terms" for side in ("risk", "protective")}
    return _document_cells(_metrics_document(spark, sf_dir), DOCUMENT_RECORDS | {"model": "model.*"}, DOCUMENT_LISTS | sides)


#: Fields of the document's records that the queries of the same contents don't have.
DOCUMENT_OWN = ("customers", "monthly_recurring_revenue", "groups")

QUERIES: dict[str, Query] = {
    # Sources, staging, features
    "raw_scan": raw_scan,
    "table_scan": table_scan,
    "stg_customers": lambda spark, sf_dir: staging.stage(raw(spark, sf_dir)),
    "service_levels_collapsed": lambda spark, sf_dir: staging.collapse_service_levels(raw(spark, sf_dir)).select(
        "customerID", *staging.SERVICES
    ),
    "account_features": _on_accounts(lambda book: book),
    "tenure_bands": _on_accounts(metrics.tenure_band_counts),
    "sink_parquet_roundtrip": sink_parquet_roundtrip,
    "sink_csv_roundtrip": sink_csv_roundtrip,
    "kpi_views": kpi_views,
    "kpi_views_permanent": kpi_views_permanent,
    # Quality
    "quality_log": lambda spark, sf_dir: quality.quality_log(raw(spark, sf_dir)),
    "quality_log_of_damaged_file": quality_log_of_damaged_file,
    "quality_checks": _on_accounts(quality.quality_checks),
    # What churn costs
    "portfolio_position": _on_accounts(metrics.portfolio_position),
    "revenue_at_risk": _on_accounts(metrics.revenue_at_risk),
    "segment_performance": _on_accounts(metrics.segment_performance),
    "loss_concentration": _on_accounts(metrics.loss_concentration),
    "segment_revenue_lost": _on_accounts(metrics.segment_revenue_lost),
    "top_segments": _on_accounts(metrics.top_segments),
    "attachment_effect": _on_accounts(metrics.attachment_effect),
    # When accounts leave
    "tenure_hazard": _on_accounts(survival.tenure_hazard),
    "kaplan_meier": _on_accounts(survival.kaplan_meier),
    "km_by_contract": _on_accounts(lambda book: survival.kaplan_meier(book, "contract_type")),
    "survival_by_contract": _on_accounts(survival.survival_summary),
    "median_survival": _on_accounts(lambda book: survival.median_survival(book, "internet_service")),
    "restricted_mean": _on_accounts(lambda book: survival.restricted_mean(book, "internet_service")),
    "hazard_smoothed": _on_accounts(lambda book: survival.smoothed_hazard(survival.kaplan_meier(book))),
    "peak_hazard": _on_accounts(lambda book: survival.peak_hazard(survival.kaplan_meier(book))),
    "hazard_phase_means": _on_accounts(lambda book: survival.hazard_phases(survival.kaplan_meier(book))),
    "months_gained": _on_accounts(lambda book: survival.months_gained(survival.survival_summary(book))),
    "logrank_terms": _on_accounts(logrank.logrank_terms),
    "logrank_covariance": _on_accounts(logrank.logrank_covariance),
    "logrank_test": _on_accounts(logrank.logrank_test),
    # Who to contact
    "design_matrix_dense": _on_staged(model.design_matrix),
    "stratified_split": _on_accounts(
        lambda book: ranking.stratified_split(scratch.table(book.select("customer_id", "is_churned"), "labels"))
    ),
    "scorecard_scores": _on_accounts(_scorecard_scores),
    "scored_accounts": _on_accounts(
        lambda book: scored(book).select("customer_id", "churn_probability", "risk_rank", "decile")
    ),
    "decile_table": _on_accounts(deciles),
    "gains_curve": _on_accounts(lambda book: targeting.gains_curve(deciles(book))),
    "auc": _on_accounts(_score_aucs),
    # Whether an offer pays
    "clv_by_contract": _on_accounts(
        lambda book: economics.lifetime_value_by_segment(survival.survival_summary(book))
    ),
    "clv_by_account": _on_accounts(
        lambda book: book.selectExpr(
            "customer_id", economics.lifetime_value("monthly_charges", "tenure_months / 2") + " AS lifetime_value"
        )
    ),
    "offer_breakeven": _on_programme(economics.offer_breakeven),
    "breakeven_sensitivity": _on_programme(economics.breakeven_sensitivity),
    "breakeven_matrix": _on_programme(
        lambda table, months: economics.breakeven_matrix(economics.breakeven_sensitivity(table, months))
    ),
    "programme_case": _on_programme(economics.programme_case),
    "programme_options": _on_programme(economics.programme_options),
    "recommended_programme": _on_programme(
        lambda table, months: economics.recommended_programme(economics.programme_options(table, months))
    ),
    # Dashboard
    "filtered_kpis": _on_accounts(
        lambda book: dashboard.kpis(
            dashboard.apply_filters(
                dashboard.cells(book), contract=["Month-to-month", "One year"], internet=["Fiber optic", "DSL"]
            )
        )
    ),
    "fixed_loss_share": _on_accounts(
        lambda book: dashboard.loss_share(
            dashboard.cells(book), ["contract_type", "internet_service"], internet=["Fiber optic"]
        )
    ),
    "selection_quality": _on_accounts(lambda book: dashboard.selection_quality(_selection(book))),
    "dashboard_economics": _on_staged(lambda book: dashboard.simple_economics(_selection(book), gained(book))),
    "account_action_list": _on_accounts(_action_list),
    "fct_customer_risk": _on_accounts(_customer_risk),
    # The fitted model
    "contract_odds_ratios": _on_accounts(_contract_coefficients),
    "contract_fit_stats": _on_accounts(_contract_fit_stats),
    "contract_significant_drivers": _on_accounts(lambda book: model.significant_drivers(_contract_coefficients(book))),
    "contract_top_terms": _on_accounts(lambda book: model.top_terms(_contract_coefficients(book))),
    "field_odds_ratios": _on_accounts(_field_models),
    "field_strongest_drivers": _on_accounts(lambda book: model.significant_drivers(_field_models(book), level=2)),
    "field_top_terms": _on_accounts(lambda book: model.top_terms(_field_models(book))),
    "driver_odds_ratios": _on_staged(_coefficients),
    "likelihood_equations": _on_staged(_likelihood_equations),
    "model_fit_stats": _on_staged(_fit_stats),
    "significant_drivers": _on_staged(lambda book: model.significant_drivers(_coefficients(book))),
    "top_terms": _on_staged(lambda book: model.top_terms(_coefficients(book))),
    "metrics_document": _metrics_document,
    "metrics_document_cells": _metrics_document_cells,
    "metrics_document_fitted_cells": _metrics_document_fitted_cells,
    "metrics_document_parts": _metrics_document_parts,
}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, in floating-point steps any engine can repeat."""

    def shown(name: str, kind: str) -> str:
        name = quoted(name)
        return f"floor({name} * 1e6D + 0.5D) / 1e6D AS {name}" if kind == "double" else name

    return df.selectExpr(*[shown(name, kind) for name, kind in df.dtypes])


def queries() -> dict[str, Query]:
    def settled(query: Query) -> Query:
        return lambda spark, sf_dir: rounded(query(spark, sf_dir))

    return {name: settled(query) for name, query in QUERIES.items()}

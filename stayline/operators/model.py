"""What drives churn: an unpenalised logistic model, its coefficients and its scores.

Fitting is Spark ML's distributed iteratively reweighted least squares. Scoring is a sum
of columns, so it runs inside generated code and needs no vectors.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..assumptions import DEFAULTS, Assumptions
from ..functions.columns import few_rows, grouped, literal, named, number, quoted, ratio
from . import ranking

# Model fields. The count of add-ons is the sum of six of them and stays out.
NUMERICS = {"tenure": "tenure_months", "MonthlyCharges": "monthly_charges", "senior": "is_senior"}
TEXT_FIELDS = {
    "Contract": "contract_type",
    "InternetService": "internet_service",
    "PaymentMethod": "payment_method",
}
YES_NO_FIELDS = {
    "OnlineSecurity": "online_security",
    "TechSupport": "tech_support",
    "OnlineBackup": "online_backup",
    "DeviceProtection": "device_protection",
    "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies",
    "MultipleLines": "multiple_lines",
    "PaperlessBilling": "is_paperless",
    "Partner": "has_partner",
    "Dependents": "has_dependents",
}
# Fixed value: two-sided 95 % quantile of the normal distribution.
WALD_QUANTILE = 1.959963984540054

# Plain-English names of model terms.
TERM_LABELS = {
    "InternetService_Fiber_optic": "Fibre broadband",
    "InternetService_No": "No internet service",
    "Contract_One_year": "One-year contract",
    "Contract_Two_year": "Two-year contract",
    "PaymentMethod_Electronic_check": "Pays by electronic cheque",
    "PaymentMethod_Mailed_check": "Pays by mailed cheque",
    "PaymentMethod_Credit_card_automatic": "Card on file",
    "StreamingTV_Yes": "Streaming TV attached",
    "StreamingMovies_Yes": "Streaming films attached",
    "MultipleLines_Yes": "Multiple lines",
    "PaperlessBilling_Yes": "Paperless billing",
    "OnlineSecurity_Yes": "Online security attached",
    "TechSupport_Yes": "Tech support attached",
    "OnlineBackup_Yes": "Online backup attached",
    "DeviceProtection_Yes": "Device protection attached",
    "Partner_Yes": "Has a partner on account",
    "Dependents_Yes": "Has dependents",
    "senior": "Senior citizen",
    "tenure": "Each additional month on book",
    "MonthlyCharges": "Each additional $1 on the bill",
}

Levels = Mapping[str, list[str]]


def _categories() -> dict[str, str]:
    yes_no = {field: f"CASE WHEN {name} = 1 THEN 'Yes' ELSE 'No' END" for field, name in YES_NO_FIELDS.items()}
    return {**TEXT_FIELDS, **yes_no}


def category_levels(accounts: DataFrame, fields: Collection[str] | None = None) -> dict[str, list[str]]:
    """Sorted levels of every chosen categorical field, found in one pass. The solver sets the only limit on their number."""
    chosen = {field: sql for field, sql in _categories().items() if fields is None or field in fields}
    if not chosen:
        return {}
    found = accounts.agg(*[F.collect_set(F.expr(sql)).alias(field) for field, sql in chosen.items()]).first()
    return {field: sorted(found[field]) for field in chosen}


def term_name(field: str, level: str) -> str:
    return f"{field}_{level}".replace(" ", "_").replace("(", "").replace(")", "")


def design_terms(levels: Levels, fields: Collection[str] | None = None) -> dict[str, str]:
    """Model terms: numerics, then one indicator per level but the first of each field."""
    numerics = {term: name for term, name in NUMERICS.items() if fields is None or term in fields}
    terms = {term: f"CAST({name} AS DOUBLE)" for term, name in numerics.items()}
    for field, category in _categories().items():
        for level in levels.get(field, [])[1:]:
            terms[term_name(field, level)] = f"CASE WHEN {category} = {literal(level)} THEN 1D ELSE 0D END"
    return terms


def design_matrix(accounts: DataFrame, levels: Levels | None = None, key: str = "customer_id") -> DataFrame:
    terms = design_terms(category_levels(accounts) if levels is None else levels)
    return accounts.selectExpr(quoted(key), *named(terms))


def logistic_score(terms: Mapping[str, str], weights: Mapping[str, float], intercept: float) -> str:
    """Probability from a coefficient table, as SQL text; a term the data lack counts nothing."""
    parts = [f"{number(weight)} * ({terms[term]})" for term, weight in weights.items() if term in terms]
    return f"1 / (1 + exp(-({' + '.join([number(intercept), *parts])})))"


def with_score(accounts: DataFrame, weights: Mapping[str, float], intercept: float, levels: Levels) -> DataFrame:
    score = logistic_score(design_terms(levels), weights, intercept)
    return accounts.selectExpr("*", f"{score} AS churn_probability")


@dataclass(frozen=True)
class DriverModel:
    levels: Levels
    intercept: float
    weights: dict[str, float]
    standard_errors: dict[str, float]
    pseudo_r2: float

    def score(self, accounts: DataFrame) -> DataFrame:
        return with_score(accounts, self.weights, self.intercept, self.levels)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """One row per term with odds ratio, 95 % Wald bounds and p-value; the intercept is left out."""
        rows = [
            (literal(term), number(weight), number(error), number(_two_sided(weight, error)))
            for (term, weight), error in zip(self.weights.items(), self.standard_errors.values())
        ]
        table = few_rows(spark, ("term", "coefficient", "error", "p_value"), rows)
        return _with_bounds(table, "term")


def _with_bounds(table: DataFrame, *names: str) -> DataFrame:
    reach = f"{number(WALD_QUANTILE)} * error"
    return table.selectExpr(
        *names,
        "coefficient",
        "exp(coefficient) AS odds_ratio",
        f"exp(coefficient - {reach}) AS or_lo",
        f"exp(coefficient + {reach}) AS or_hi",
        "p_value",
    ).orderBy(F.desc("odds_ratio"), "term")


def _two_sided(weight: float | None, error: float | None) -> float | None:
    return math.erfc(abs(weight / error) / math.sqrt(2)) if error and weight is not None else None


def fit(split_accounts: DataFrame, fields: Collection[str] | None = None) -> DriverModel:
    """Maximum-likelihood fit on the rows whose ``split`` is 'train', of all fields or the named ones."""
    levels = category_levels(split_accounts, fields)
    terms = design_terms(levels, fields)
    rows = split_accounts.filter("split = 'train'").selectExpr("CAST(is_churned AS DOUBLE) AS label", *named(terms))
    train = VectorAssembler(inputCols=list(terms), outputCol="features").transform(rows).select("label", "features")
    # Read once per iteration. A lost block is rebuilt from the written split table.
    train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = GeneralizedLinearRegression(
            family="binomial", link="logit", regParam=0.0, maxIter=200, tol=1e-10, featuresCol="features", labelCol="label"
        ).fit(train)
        summary = fitted.summary
        errors = list(summary.coefficientStandardErrors)
        return DriverModel(
            levels=levels,
            intercept=float(fitted.intercept),
            weights=dict(zip(terms, map(float, fitted.coefficients))),
            # The intercept's error comes last.
            standard_errors=dict(zip(terms, errors)),
            pseudo_r2=1 - summary.deviance / summary.nullDeviance,
        )
    finally:
        train.unpersist()


def field_odds_ratios(split_accounts: DataFrame) -> DataFrame:
    """For each categorical field a model of that field alone, fitted to the training rows in closed form: log odds of its
    levels against the one that sorts first. All come from one count of leavers by field and level; a level that nobody or
    everybody left has no finite estimate and NULLs.
    """
    fields = _categories()
    levels = split_accounts.filter("split = 'train'").selectExpr("is_churned", *named(fields)).unpivot(
        ["is_churned"], list(fields), "field", "level"
    )
    counts = grouped(
        levels.filter("level IS NOT NULL"),
        {"field": "field", "level": "level"},
        {"y": "CAST(sum(is_churned) AS DOUBLE)", "m": "CAST(sum(1 - is_churned) AS DOUBLE)"},
    )
    base = "(PARTITION BY field ORDER BY level)"
    slopes = counts.selectExpr("*", f"first(y) OVER {base} AS y0", f"first(m) OVER {base} AS m0", f"row_number() OVER {base} AS n")
    term = "replace(replace(replace(field || '_' || level, ' ', '_'), '(', ''), ')', '')"
    known = slopes.filter("n > 1").selectExpr(
        "field",
        f"{term} AS term",
        "CASE WHEN least(y, m, y0, m0) > 0 THEN ln(y * m0 / (m * y0)) END AS coefficient",
        "sqrt(1 / nullif(y, 0D) + 1 / nullif(m, 0D) + 1 / nullif(y0, 0D) + 1 / nullif(m0, 0D)) AS error",
    )
    # Levels of a few fields: the error function is not among Spark's.
    rows = [
        (literal(row.field), literal(row.term), number(row.coefficient), number(row.error), number(_two_sided(row.coefficient, row.error)))
        for row in known.collect()
    ]
    if not rows:
        return _with_bounds(known.selectExpr("*", "CAST(NULL AS DOUBLE) AS p_value"), "field", "term")
    table = few_rows(split_accounts.sparkSession, ("field", "term", "coefficient", "error", "p_value"), rows)
    return _with_bounds(table, "field", "term")


def fit_stats(model: DriverModel, scored: DataFrame) -> DataFrame:
    """Discrimination on both splits, pseudo R2 and split sizes as one row."""
    areas = ranking.auc(scored, "churn_probability", "is_churned", by="split")
    sizes = grouped(scored, {"split": "split"}, {"size": "count(1)"})

    def of(split: str, value: str) -> str:
        return f"max({value}) FILTER (WHERE split = {literal(split)})"

    return grouped(
        areas.join(sizes, "split"),
        {},
        {
            "auc_test": of("test", "auc"),
            "auc_train": of("train", "auc"),
            "pseudo_r2": number(model.pseudo_r2),
            "n_train": of("train", "size"),
            "n_test": of("test", "size"),
        },
    )


def likelihood_equations(model: DriverModel, split_accounts: DataFrame) -> DataFrame:
    """Per term, the sum of residual times term on the training rows, relative to the term's own sum.

    All are zero where the likelihood is at its maximum.
    """
    terms = {"intercept": "1D", **{term: sql for term, sql in design_terms(model.levels).items() if term in model.weights}}
    residual = "(is_churned - churn_probability)"
    sums = grouped(
        model.score(split_accounts.filter("split = 'train'")),
        {},
        {term: ratio(f"sum({residual} * ({sql}))", f"sum(abs({sql}))") for term, sql in terms.items()},
    )
    return sums.unpivot([], list(terms), "term", "relative_residual").orderBy("term")


def split_accounts(accounts: DataFrame, assumptions: Assumptions = DEFAULTS) -> DataFrame:
    return ranking.stratified_split(accounts, share=assumptions.test_share, seed=assumptions.seed)


def term_label(term: str) -> str:
    names = ", ".join(f"{literal(name)}, {literal(label)}" for name, label in TERM_LABELS.items())
    return f"coalesce(try_element_at(map({names}), {term}), replace({term}, '_', ' '))"


def significant_drivers(coefficients: DataFrame, top: int = 12, level: float = 0.05) -> DataFrame:
    """Labelled significant terms with the largest distance from no effect, by odds ratio."""
    return (
        coefficients.filter(F.col("p_value") < level)
        .selectExpr("*", "abs(odds_ratio - 1) AS distance", f"{term_label('term')} AS label")
        .orderBy(F.desc("distance"), "term")
        .limit(top)
        .orderBy("odds_ratio", "term")
    )


def top_terms(coefficients: DataFrame, count: int = 6) -> DataFrame:
    """The terms that raise the odds most and those that lower them most."""
    risk = coefficients.orderBy(F.desc("odds_ratio"), "term").limit(count)
    protective = coefficients.orderBy(F.asc("odds_ratio"), F.desc("term")).limit(count)
    return (
        risk.withColumn("side", F.lit("risk"))
        .unionByName(protective.withColumn("side", F.lit("protective")))
        .orderBy(F.desc("side"), F.desc("odds_ratio"), "term")
    )

"""The staged accounts and the KPI definitions as SQL names, for a session or for every session of the catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import named
from ..operators import metrics, survival
from ..operators.features import add_features
from ..operators.staging import stage

# View names.
KPI_VIEWS = {
    "vw_portfolio_position": metrics.portfolio_position,
    "vw_segment_performance": metrics.segment_performance,
    "vw_tenure_hazard": survival.tenure_hazard,
    "vw_loss_concentration": metrics.loss_concentration,
    "vw_attachment_effect": metrics.attachment_effect,
}


def accounts_of(raw: DataFrame) -> DataFrame:
    """Raw extract to the account frame every operator works on."""
    return add_features(stage(raw))


def create_staging(raw: DataFrame, path: str) -> DataFrame:
    """Write the account frame once, replacing what is there, and name it ``stg_customers``."""
    accounts = accounts_of(raw)
    accounts.write.mode("overwrite").parquet(path)
    staged = raw.sparkSession.read.schema(accounts.schema).parquet(path)
    staged.createOrReplaceTempView("stg_customers")
    return staged


def save_staging(raw: DataFrame, name: str = "stg_customers", path: str | None = None) -> DataFrame:
    """Write the account frame as a catalog table, replacing what is there: every session of the catalog reads it, and
    ``create_views`` finds it unless the session has a view of that name. With a path the table lies there."""
    writer = accounts_of(raw).write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return raw.sparkSession.table(name)


def create_views(spark: SparkSession) -> None:
    """Define the KPI views of this session over ``stg_customers``; each is computed when it is read."""
    accounts = spark.table("stg_customers")
    for name, define in KPI_VIEWS.items():
        define(accounts).createOrReplaceTempView(name)


def _grouped(source: str, keys: Mapping[str, str], measures: Mapping[str, str]) -> str:
    group = f" GROUP BY {', '.join(keys.values())}" if keys else ""
    return f"SELECT {', '.join(named({**keys, **measures}))} FROM {source}{group}"


def _over(rows: str, columns: Iterable[str], where: str | None = None) -> str:
    return f"SELECT {', '.join(columns)} FROM ({rows})" + (f" WHERE {where}" if where else "")


def kpi_sql(source: str) -> dict[str, str]:
    """The KPI definitions over a table of accounts as statements that any view can hold."""
    segments = _over(_grouped(source, metrics.SEGMENT_KEYS, metrics.SEGMENT), metrics.SEGMENT_COLUMNS)
    attachment = _grouped(source, metrics.ATTACHMENT_KEYS, metrics.ATTACHMENT)
    known = f"(SELECT * FROM {source} WHERE tenure_months IS NOT NULL)"
    months = _grouped(known, {"tenure_month": "tenure_months"}, survival.GRID)
    hazards = _over(_over(months, ("*", survival.at_risk_column())), ("*", survival.HAZARD), survival.OCCUPIED)
    stayed = """aggregate(collect_list(1 - hazard) OVER (ORDER BY tenure_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        1D, (share, stays) -> share * stays) AS survival"""
    return {
        "vw_portfolio_position": _over(_grouped(source, {}, metrics.PORTFOLIO), metrics.PORTFOLIO_COLUMNS),
        "vw_segment_performance": segments,
        "vw_tenure_hazard": _over(_over(hazards, ("*", stayed)), survival.HAZARD_COLUMNS),
        "vw_loss_concentration": _over(segments, metrics.CONCENTRATION_COLUMNS, metrics.CONCENTRATED),
        "vw_attachment_effect": _over(attachment, metrics.ATTACHMENT_COLUMNS),
    }


def create_permanent_views(spark: SparkSession, source: str = "stg_customers", suffix: str = "") -> list[str]:
    """Define the KPI views in the catalog, over a table of it (see ``save_staging``); their names, for every session."""
    made = []
    for name, statement in kpi_sql(source).items():
        spark.sql(f"CREATE OR REPLACE VIEW {name}{suffix} AS {statement}")
        made.append(f"{name}{suffix}")
    return made

"""Data-quality log of the raw extract and named checks of the staged accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import flag, grouped, mean, trimmed
from ..sources.extract import MALFORMED, strip_names
from .staging import READABLE_BILL, READABLE_SENIOR, READABLE_TENURE, READABLE_TOTAL


class QualityError(ValueError):
    """The source broke a rule the analysis relies on."""


def _duplicates(key: str) -> str:
    # Exact; the distinct count collapses each key before and after one shuffle.
    return f"count(1) - count(DISTINCT {key})"


def quality_log(raw: DataFrame) -> DataFrame:
    """One row of counts. A total that cannot be read counts as blank; garbage also on its own."""
    unread = f"{READABLE_TOTAL} IS NULL"
    has_text = f"coalesce({trimmed('TotalCharges')}, '') <> ''"
    raw = strip_names(raw)
    return grouped(
        raw,
        {},
        {
            "rows_in": "count(1)",
            "blank_total_charges": f"count_if({unread})",
            "blank_total_charges_all_tenure_zero": f"""coalesce(
                bool_and(coalesce({READABLE_TENURE} = 0, false)) FILTER (WHERE {unread}), true)""",
            "duplicate_customer_ids": _duplicates("customerID"),
            "negative_charges": f"count_if({READABLE_BILL} < 0)",
            "rows_out": "count(1)",
            "churn_rate": "bround(" + mean(flag(f"{trimmed('Churn')} = 'Yes'")) + ", 6)",
            "garbage_total_charges": f"count_if({unread} AND {has_text})",
            "null_customer_ids": "count_if(customerID IS NULL)",
            "negative_tenure": f"count_if({READABLE_TENURE} < 0)",
            "unreadable_tenure": f"count_if({READABLE_TENURE} IS NULL)",
            "unreadable_senior_flag": f"count_if({READABLE_SENIOR} IS NULL)",
            "unreadable_monthly_charges": f"count_if({READABLE_BILL} IS NULL)",
            # Only files have rows that don't fit their header.
            "malformed_rows": f"count_if({MALFORMED})" if MALFORMED in raw.columns else "0L",
        },
    )


CHECKS = {
    "blank_total_charges_on_tenured_account": "count_if(total_charges = 0 AND tenure_months > 0)",
    "duplicate_customer_id": _duplicates("customer_id"),
    "negative_monthly_charges": "count_if(monthly_charges < 0)",
}


def quality_checks(accounts: DataFrame, raise_on_failure: bool = False) -> DataFrame:
    """Three named checks with their failure counts, from one pass over the accounts."""
    checks = grouped(accounts, {}, CHECKS).unpivot([], list(CHECKS), "check_name", "failures")
    if raise_on_failure:
        broken = {row.check_name: row.failures for row in checks.collect() if row.failures}
        if broken:
            raise QualityError(f"failed checks: {broken}")
    return checks

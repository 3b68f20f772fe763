"""Row-wise features of staged accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import flag, named, tenure_band, tenure_band_order

# The paid add-ons.
ADDONS = (
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
)

_ADDON_COUNT = " + ".join(ADDONS)
_BILL = "CAST(monthly_charges AS DOUBLE)"
_REALISED = f"CASE WHEN tenure_months > 0 THEN CAST(total_charges AS DOUBLE) / tenure_months ELSE {_BILL} END"

FEATURES = {
    "addon_count": _ADDON_COUNT,
    # The internet service has levels but no 'Yes', so it never counts here.
    "services_total": f"{_ADDON_COUNT} + phone_service + multiple_lines",
    "is_autopay": flag("contains(payment_method, 'automatic')"),
    "is_fibre": flag("internet_service = 'Fiber optic'"),
    "no_internet": flag("internet_service = 'No'"),
    "electronic_check": flag("payment_method = 'Electronic check'"),
    "is_month_to_month": flag("contract_type = 'Month-to-month'"),
    "tenure_band": tenure_band("tenure_months"),
    "tenure_band_order": tenure_band_order("tenure_months"),
    "arpu_realised": _REALISED,
    "arpu_realised_2dp": """CAST(CASE WHEN tenure_months > 0 THEN round(total_charges / tenure_months, 2)
        ELSE monthly_charges END AS DECIMAL(12,2))""",
    "bill_vs_realised": f"{_BILL} - {_REALISED}",
}


def add_features(staged: DataFrame) -> DataFrame:
    return staged.selectExpr("*", *named(FEATURES))

"""Raw extract to staged accounts: casts, flags, and one spelling for 'not taken'."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import flag, lenient_number, lenient_whole, named, trimmed
from ..sources.extract import strip_names

# Services an account can take, and the spellings that mean 'No'.
SERVICES = (
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
)
NOT_TAKEN = ("No internet service", "No phone service")

# Raw name to staged name.
KEPT_TEXT = {
    "customerID": "customer_id",
    "Contract": "contract_type",
    "InternetService": "internet_service",
    "PaymentMethod": "payment_method",
}
YES_NO = {
    "PaperlessBilling": "is_paperless",
    "Partner": "has_partner",
    "Dependents": "has_dependents",
    "PhoneService": "phone_service",
    "MultipleLines": "multiple_lines",
    "OnlineSecurity": "online_security",
    "OnlineBackup": "online_backup",
    "DeviceProtection": "device_protection",
    "TechSupport": "tech_support",
    "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies",
}


# NULL for a blank or unparsable field.
READABLE_TOTAL = lenient_number("TotalCharges", 12, 2)
READABLE_BILL = lenient_number("MonthlyCharges", 10, 2)
READABLE_TENURE = lenient_whole("tenure")
READABLE_SENIOR = lenient_whole("SeniorCitizen")


def collapse_service_levels(raw: DataFrame) -> DataFrame:
    return raw.replace({level: "No" for level in NOT_TAKEN}, subset=list(SERVICES))


def stage(raw: DataFrame) -> DataFrame:
    """Typed accounts. The other spellings of 'No' need no extra step: only 'Yes' sets a flag."""
    return strip_names(raw).selectExpr(
        *named(
            {
                **{staged: name for name, staged in KEPT_TEXT.items()},
                "tenure_months": READABLE_TENURE,
                "is_senior": READABLE_SENIOR,
                "monthly_charges": READABLE_BILL,
                # Nothing billed so far, nothing paid.
                "total_charges": f"CAST(coalesce({READABLE_TOTAL}, 0) AS DECIMAL(12,2))",
                "is_churned": flag(f"{trimmed('Churn')} = 'Yes'"),
                **{staged: flag(f"{name} = 'Yes'") for name, staged in YES_NO.items()},
            }
        )
    )

"""Hand-made account books."""

from stayline.plans.views import accounts_of
from stayline.sources.extract import FIELDS, RAW

PLAIN = {
    "customerID": "a",
    "gender": "Female",
    "SeniorCitizen": 0,
    "Partner": "No",
    "Dependents": "No",
    "tenure": 10,
    "PhoneService": "Yes",
    "MultipleLines": "No",
    "InternetService": "DSL",
    "OnlineSecurity": "No",
    "OnlineBackup": "No",
    "DeviceProtection": "No",
    "TechSupport": "No",
    "StreamingTV": "No",
    "StreamingMovies": "No",
    "Contract": "Month-to-month",
    "PaperlessBilling": "No",
    "PaymentMethod": "Mailed check",
    "MonthlyCharges": "50.00",
    "TotalCharges": "500.00",
    "Churn": "No",
}


def raw_book(spark, *changes):
    """One raw account per set of changes to the plain one, with running ids unless given."""
    rows = [{**PLAIN, "customerID": f"c{i:04d}", **change} for i, change in enumerate(changes)]
    return spark.createDataFrame([tuple(row[name] for name in FIELDS) for row in rows], RAW)


def book(spark, *changes):
    return accounts_of(raw_book(spark, *changes))


def lives(spark, *pairs, **same):
    """Accounts from (tenure, left) pairs."""
    return book(spark, *[{"tenure": t, "Churn": "Yes" if left else "No", **same} for t, left in pairs])


def rows(df):
    return [row.asDict() for row in df.collect()]

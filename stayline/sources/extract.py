"""The raw account extract: one row per account, 21 fields."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Field names of the extract, in file order.
FIELDS = (
    "customerID",
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "tenure",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
    "MonthlyCharges",
    "TotalCharges",
    "Churn",
)

#: Flag of rows that don't fit the header: too few or too many fields, a quote that isn't closed.
MALFORMED = "malformed"
_BROKEN = "_broken_row"

# Charges stay text in a derived book, too: a blank total is meaningful and decimals must not pass through double.
_WHOLE_NUMBERS = {"SeniorCitizen", "tenure"}

RAW = StructType([StructField(name, IntegerType() if name in _WHOLE_NUMBERS else StringType()) for name in FIELDS])


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the extract from CSV files with a header, all fields as text, and a flag of malformed rows.

    Columns may come in any order, the same one in every file: a file whose header differs from the first one's fails. A
    malformed row keeps the fields it has, lacks the others, and loses those past the last.
    """
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(
                f"{path} not found: place the account extract there as CSV with a header row"
            ) from error
        raise
    schema = StructType([StructField(label, StringType()) for label in [*header, _BROKEN]])
    # A pruned reader counts no fields.
    reader = spark.read.schema(schema).options(header=True, enforceSchema=False, columnPruning=False)
    whole = strip_names(reader.option("columnNameOfCorruptRecord", _BROKEN).csv(path))
    return whole.select(*FIELDS, whole[_BROKEN].isNotNull().alias(MALFORMED))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Read the extract from a table or view, all fields as text."""
    raw = strip_names(spark.table(name))
    return raw.select(*[raw[field].cast("string").alias(field) for field in FIELDS])


def write_csv(raw: DataFrame, path: str) -> None:
    """Write a frame as CSV with a header, blanks kept as they are."""
    (
        raw.write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )

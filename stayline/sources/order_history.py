"""Derive the raw account extract from an order history.

Everything is integer arithmetic and string comparison, so the result does not depend
on the order rows are summed in. Shape of the plan:

* line items meet parts (narrow rows; adaptive execution broadcasts a small part table
  and splits a hot part key) and collapse to one row per order, partly before the shuffle,
  so a hot order costs one row per map task;
* those rows join orders one to one on the order key and collapse to one row per customer,
  again partly before the shuffle, so a hot customer does too;
* that row joins the customer one to one.

All joins are outer joins, so a customer of an unknown nation and a line of an unknown part count.
The last two are onto a unique key: a query that uses no add-on drops the line item branch
altogether, and one that uses no order fact reads only customers. The date of the book is the
largest order date, a scan of that one column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import flag, grouped, literal, named
from .extract import FIELDS

# Which part type stands for which add-on.
ADDON_PART_TYPES = {
    "OnlineSecurity": "STANDARD",
    "OnlineBackup": "SMALL",
    "DeviceProtection": "LARGE",
    "TechSupport": "ECONOMY",
    "StreamingTV": "MEDIUM",
    "StreamingMovies": "PROMO",
}


# The columns used. Stated, so that planning does not open a file per table;
# orders is left to its files, which say what kind of timestamp they hold.
SCHEMAS = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "orders": None,
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_returnflag STRING",
    "part": "p_partkey BIGINT, p_type STRING",
}


# Date, order key and code of an order as one number: unlike a struct with text it fits a hash aggregate's buffer.
LAST_ORDER = """CAST(unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS DECIMAL(18,0)) * 100000000000000000000
    + CAST(o_orderkey AS DECIMAL(19,0)) * 10
    + CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 6 ELSE 0 END
    + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END"""
LAST_CODE = "CAST(pmod(last_order, 10) AS INT)"


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name: str, schema: str | None) -> DataFrame:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(f"{sf_dir}/{name}.parquet")

    return derive(**{name: read(name, schema) for name, schema in SCHEMAS.items()})


def derive(
    customer: DataFrame, nation: DataFrame, orders: DataFrame, lineitem: DataFrame, part: DataFrame
) -> DataFrame:
    facts = _order_facts(orders, _line_facts(lineitem, part))
    accounts = (
        customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left")
        .join(facts, customer["c_custkey"] == facts["o_custkey"], "left")
        .withColumn("book_date", orders.agg(F.max("o_orderdate")).scalar())
    )
    rules = _rules()
    return accounts.selectExpr(*named({name: rules[name] for name in FIELDS}))


def _line_facts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Lines per order by part type, and returned lines."""
    return grouped(
        lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"], "left"),
        {"l_orderkey": "l_orderkey"},
        {
            **{f"{addon}_lines": f"count_if(p_type = {literal(kind)})" for addon, kind in ADDON_PART_TYPES.items()},
            "returned_lines": "count_if(l_returnflag = 'R')",
        },
    )


def _order_facts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per customer: span, number and value of orders, the last order, line counts."""
    return grouped(
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left"),
        {"o_custkey": "o_custkey"},
        {
            "first_date": "min(o_orderdate)",
            "last_date": "max(o_orderdate)",
            "order_count": "count(1)",
            "cents": "sum(CAST(round(o_totalprice * 100) AS BIGINT))",
            "last_order": f"max({LAST_ORDER})",
            **{f"{addon}_lines": f"sum({addon}_lines)" for addon in ADDON_PART_TYPES},
            "returned_lines": "sum(returned_lines)",
        },
    )


def _yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'Yes' ELSE 'No' END"


def _money_text(cents: str) -> str:
    return f"concat(({cents}) div 100, '.', lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))"


def _rules() -> dict[str, str]:
    months = (
        "coalesce((year(last_date) - year(first_date)) * 12 + month(last_date) - month(first_date), 0)"
    )
    bill = "coalesce(cents div (order_count * 1000), 0)"
    paid = "coalesce(cents, 0) div 1000"
    no_phone = "c_nationkey % 10 = 0"
    rules = {
        "customerID": "CAST(c_custkey AS STRING)",
        "gender": "CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END",
        "SeniorCitizen": flag("c_mktsegment = 'HOUSEHOLD'"),
        "Partner": _yes("c_acctbal >= 4500"),
        "Dependents": _yes("c_nationkey % 3 = 0"),
        "tenure": f"CAST({months} AS INT)",
        "PhoneService": f"CASE WHEN {no_phone} THEN 'No' ELSE 'Yes' END",
        "MultipleLines": f"CASE WHEN {no_phone} THEN 'No phone service' WHEN returned_lines >= 14 THEN 'Yes' ELSE 'No' END",
        "InternetService": "CASE WHEN n_regionkey <= 1 THEN 'Fiber optic' WHEN n_regionkey <= 3 THEN 'DSL' ELSE 'No' END",
        "Contract": """CASE WHEN coalesce(order_count, 0) <= 8 THEN 'Month-to-month'
            WHEN order_count <= 11 THEN 'One year' ELSE 'Two year' END""",
        "PaperlessBilling": _yes(f"{LAST_CODE} % 2 = 1"),
        "PaymentMethod": f"""CASE {LAST_CODE} div 2 WHEN 1 THEN 'Electronic check' WHEN 2 THEN 'Mailed check'
            WHEN 3 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END""",
        "MonthlyCharges": _money_text(bill),
        "TotalCharges": f"CASE WHEN {months} = 0 THEN ' ' ELSE {_money_text(paid)} END",
        "Churn": _yes("datediff(book_date, last_date) > 180"),
    }
    for addon in ADDON_PART_TYPES:
        rules[addon] = (
            f"CASE WHEN n_regionkey = 4 THEN 'No internet service' WHEN {addon}_lines >= 7 THEN 'Yes' ELSE 'No' END"
        )
    return rules

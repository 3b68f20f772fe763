from decimal import Decimal

import pytest

from stayline.operators import quality, staging
from stayline.plans.views import KPI_VIEWS, accounts_of, create_permanent_views, create_staging, create_views, save_staging
from stayline.sources import extract, scratch
from tests.frames import PLAIN, book, raw_book, rows


def test_blank_and_garbage_totals_become_zero(spark):
    totals = [" ", "", "\t\n", "n/a", "12.5x", None, "12.50", " 7.1 "]
    accounts = book(spark, *[{"TotalCharges": total} for total in totals])
    found = [row["total_charges"] for row in sorted(rows(accounts), key=lambda row: row["customer_id"])]
    assert found == [Decimal("0.00")] * 6 + [Decimal("12.50"), Decimal("7.10")]


def test_flags_and_levels(spark):
    (row,) = rows(
        book(
            spark,
            {
                "MultipleLines": "No phone service",
                "OnlineSecurity": "No internet service",
                "TechSupport": "Yes",
                "StreamingTV": "Yes",
                "InternetService": "Fiber optic",
                "PaymentMethod": "Bank transfer (automatic)",
                "Churn": " Yes ",
            },
        )
    )
    assert row["multiple_lines"] == row["online_security"] == 0
    assert row["addon_count"] == 2 and row["services_total"] == 3
    assert row["is_churned"] == row["is_fibre"] == row["is_autopay"] == row["is_month_to_month"] == 1
    assert row["no_internet"] == row["electronic_check"] == 0


@pytest.mark.parametrize(
    "tenure, band, order",
    [(-1, "0-6m", 1), (0, "0-6m", 1), (5, "0-6m", 1), (6, "6-12m", 2), (11, "6-12m", 2), (12, "12-24m", 3),
     (24, "24-48m", 4), (48, "48-72m", 5), (71, "48-72m", 5), (72, "72m+", 6), (1000, "72m+", 6)],
)
def test_tenure_bands(spark, tenure, band, order):
    (row,) = rows(book(spark, {"tenure": tenure}))
    assert (row["tenure_band"], row["tenure_band_order"]) == (band, order)


def test_realised_revenue(spark):
    first, unbilled = sorted(
        rows(book(spark, {"tenure": 3, "TotalCharges": "100.00"}, {"tenure": 0, "TotalCharges": " "})),
        key=lambda row: row["customer_id"],
    )
    assert first["arpu_realised"] == 100 / 3 and first["arpu_realised_2dp"] == Decimal("33.33")
    assert first["bill_vs_realised"] == 50 - 100 / 3
    assert unbilled["arpu_realised"] == 50.0 and unbilled["arpu_realised_2dp"] == Decimal("50.00")


def test_quality_log(spark):
    raw = raw_book(
        spark,
        {"customerID": "x", "tenure": 0, "TotalCharges": " "},
        {"customerID": "x", "MonthlyCharges": "-5.00"},
        {"customerID": None, "TotalCharges": "junk", "tenure": -2},
        {"customerID": "y", "Churn": "Yes"},
    )
    (log,) = rows(quality.quality_log(raw))
    assert log == {
        "rows_in": 4,
        "blank_total_charges": 2,
        "blank_total_charges_all_tenure_zero": False,
        "duplicate_customer_ids": 2,
        "negative_charges": 1,
        "rows_out": 4,
        "churn_rate": 0.25,
        "garbage_total_charges": 1,
        "null_customer_ids": 1,
        "negative_tenure": 1,
        "unreadable_tenure": 0,
        "unreadable_senior_flag": 0,
        "unreadable_monthly_charges": 0,
        "malformed_rows": 0,
    }


def test_quality_log_without_blanks_holds_vacuously(spark):
    (log,) = rows(quality.quality_log(raw_book(spark, {})))
    assert log["blank_total_charges"] == 0 and log["blank_total_charges_all_tenure_zero"] is True


def test_checks_report_and_can_raise(spark):
    accounts = book(spark, {"customerID": "x"}, {"customerID": "x", "MonthlyCharges": "-1", "TotalCharges": " "})
    found = {row["check_name"]: row["failures"] for row in rows(quality.quality_checks(accounts))}
    assert found == {
        "blank_total_charges_on_tenured_account": 1,
        "duplicate_customer_id": 1,
        "negative_monthly_charges": 1,
    }
    with pytest.raises(quality.QualityError):
        quality.quality_checks(accounts, raise_on_failure=True)
    clean = quality.quality_checks(book(spark, {}), raise_on_failure=True)
    assert [row["failures"] for row in rows(clean)] == [0, 0, 0]


def test_csv_columns_in_any_order_with_padded_names(spark, tmp_path):
    names = list(reversed(extract.FIELDS))
    path = tmp_path / "book.csv"
    values = [str(PLAIN[name]) if name != "TotalCharges" else " " for name in names]
    path.write_text(",".join(f" {name} " for name in names) + "\n" + ",".join(values) + "\n")
    raw = extract.read_csv(spark, str(path))
    assert raw.dtypes == [*((name, "string") for name in extract.FIELDS), (extract.MALFORMED, "boolean")]
    (row,) = rows(accounts_of(raw))
    assert row["customer_id"] == "a" and row["total_charges"] == 0


def test_missing_extract_says_what_to_do(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="place the account extract"):
        extract.read_csv(spark, str(tmp_path / "none.csv"))


def test_text_table_and_views(spark):
    raw = raw_book(spark, {}, {"Churn": "Yes"})
    raw.selectExpr(*[f"CAST({name} AS STRING) AS `{name} `" for name in raw.columns]).createOrReplaceTempView("all_text")
    staged = create_staging(extract.read_table(spark, "all_text"), scratch.path(spark, "test"))
    assert staged.count() == 2
    create_views(spark)
    assert spark.sql("SELECT churned_accounts, accounts FROM vw_portfolio_position").first()[:] == (1, 2)
    for view in ("vw_segment_performance", "vw_tenure_hazard", "vw_loss_concentration", "vw_attachment_effect"):
        assert spark.table(view).count() >= 1


def test_another_session_sees_the_saved_table(spark):
    save_staging(raw_book(spark, {}, {"Churn": "Yes"}), "saved_customers")
    try:
        other = spark.newSession()
        other.table("saved_customers").createOrReplaceTempView("stg_customers")
        create_views(other)
        assert other.sql("SELECT churned_accounts, accounts FROM vw_portfolio_position").first()[:] == (1, 2)
    finally:
        spark.sql("DROP TABLE saved_customers")


def test_another_session_reads_the_permanent_views(spark, tmp_path):
    """All five, each equal to its operator, also through NULL losses and months that everybody leaves."""
    changes = [
        {"tenure": t, "Churn": c, "Contract": k, "MonthlyCharges": m, "OnlineBackup": b}
        for t, c, k, m, b in [
            (1, "Yes", "One year", "10.00", "Yes"), (2, "No", "One year", "20.50", "No"), (2, "Yes", "Two year", "30.25", "No"),
            (5, "No", "Month-to-month", "40.00", "Yes"), (5, "Yes", "One year", "1.00", "Yes"), (9, "Yes", "Two year", "2.00", "No"),
            (None, "No", "One year", "7.00", "No"),
        ]
    ]
    saved = save_staging(raw_book(spark, *changes), "stg_for_views", str(tmp_path / "saved"))
    made = create_permanent_views(spark, "stg_for_views", "_seen")
    try:
        other = spark.newSession()
        assert made == [f"{name}_seen" for name in KPI_VIEWS]
        for name, define in KPI_VIEWS.items():
            found, expected = other.table(f"{name}_seen"), define(saved)
            assert found.dtypes == expected.dtypes
            assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
        assert not [table for table in other.catalog.listTables() if table.isTemporary and table.name in made]
    finally:
        for name in made:
            spark.sql(f"DROP VIEW {name}")
        spark.sql("DROP TABLE stg_for_views")


def test_files_with_different_headers_fail(spark, tmp_path):
    names = list(extract.FIELDS)
    for number, header in enumerate((names, names[::-1])):
        (tmp_path / f"{number}.csv").write_text(",".join(header) + "\n" + ",".join(header) + "\n")
    with pytest.raises(Exception, match="header"):
        extract.read_csv(spark, str(tmp_path)).collect()


def test_unreadable_whole_numbers_are_counted(spark):
    changes = [{"tenure": t, "SeniorCitizen": s, "MonthlyCharges": m} for t, s, m in
               (("abc", "1", "x"), ("3.0", "0.5", "2.50"), (" 7 ", "", ""), ("1.5", "0", "-1"))]
    table = spark.createDataFrame([tuple({**PLAIN, **c}[n] for n in extract.FIELDS) for c in changes], ", ".join(f"{n} string" for n in extract.FIELDS), verifySchema=False)
    (log,) = rows(quality.quality_log(table))
    assert (log["unreadable_tenure"], log["unreadable_senior_flag"], log["unreadable_monthly_charges"]) == (2, 2, 2)
    assert [r["tenure_months"] for r in rows(staging.stage(table))] == [None, 3, 7, None]


def test_malformed_rows_are_counted(spark, tmp_path):
    """A short, a long and a badly quoted row, in a file whose columns come in another order."""
    names = list(reversed(extract.FIELDS))
    good = [str(PLAIN[name]) for name in names]
    lines = [names, good, good[:-3], [*good, "more"], ['"' + good[0], *good[1:]], ['"' + good[0] + '"', *good[1:]]]
    (tmp_path / "book.csv").write_text("\n".join(",".join(line) for line in lines) + "\n")
    raw = extract.read_csv(spark, str(tmp_path))
    (log,) = rows(quality.quality_log(raw))
    assert (log["rows_in"], log["rows_out"], log["malformed_rows"]) == (5, 5, 3)
    # Whatever columns are read (Spark wants one beside the flag).
    assert sorted(row[1] for row in raw.select("gender", extract.MALFORMED).collect()) == [False, False, True, True, True]
    assert [row["Churn"] for row in rows(raw.select("Churn", extract.MALFORMED).where("NOT malformed"))] == ["No", "No"]
    assert accounts_of(raw).count() == 5

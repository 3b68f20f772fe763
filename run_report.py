"""The whole analysis as one Spark application.

    spark-submit run_report.py INPUT OUTPUT

INPUT is the path of an account extract in CSV, or ``table:NAME`` of a catalog table.
"""

import argparse

from pyspark.sql import SparkSession

from stayline.plans import report
from stayline.sources import extract, scratch


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("input")
    parser.add_argument("output")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("stayline").getOrCreate()
    kind, _, name = given.input.partition(":")
    raw = extract.read_table(spark, name) if kind == "table" else extract.read_csv(spark, given.input)
    report.run(raw, given.output)
    scratch.clear(spark)


if __name__ == "__main__":
    main()

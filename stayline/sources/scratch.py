"""Written tables that cut lineage.

An intermediate result that is read more than once is written as parquet in a folder that all executors share: the
context's checkpoint folder, else the one ``spark.checkpoint.dir`` names, else the warehouse, unless that is a folder of one
machine of a cluster. A lost executor then costs
a re-read, and readers still get column pruning and true sizes for join planning. The tables of an application lie in
a folder of its own; ``clear`` removes it once nothing that reads them is needed any more.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if shared.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach: the warehouse is a local one")
    return f"{shared.rstrip('/')}/stayline-{spark.sparkContext.applicationId}"


def path(spark: SparkSession, name: str) -> str:
    """A fresh location for one written result."""
    return f"{folder(spark)}/{name}-{uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once and return it as read back from the written table."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def clear(spark: SparkSession) -> None:
    """Delete the tables this application wrote, once nothing that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(folder(spark))
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)

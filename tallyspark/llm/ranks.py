"""Exact global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import scratch_path


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the given order.

    Rows are range-sorted and written to the shared folder; a row's rank is its place in
    its part file plus the rows of the files before it. Only one count per part file goes
    to the driver.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    df.orderBy(*order).write.parquet(path)
    # metadata columns are attached to the scan itself, so the schema is passed to the reader
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at")
    )
    counts = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()
    before, starts = 0, []
    for r in sorted(counts, key=lambda r: r["__file"]):
        starts.append((r["__file"], before))
        before += r["n"]
    if not starts:
        return rows.select(*df.columns, F.lit(0).cast("long").alias(name))
    offsets = spark.createDataFrame(starts, "__file string, __start long")
    # one row per part file: as many as the sort had partitions
    return rows.join(F.broadcast(offsets), "__file").select(*df.columns, (F.col("__start") + F.col("__at")).alias(name))

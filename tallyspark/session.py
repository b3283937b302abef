"""Session helpers shared by every module: shared scratch folder, table reading, materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made within the innermost scratch_scope.
_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    Taken from ``spark.checkpoint.dir``; a local temporary folder is set only where that is
    unset and everything runs on one machine. A cluster without that setting is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(conf)
        return shared_dir(spark)
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the scratch folders that are made inside when it ends; what is to stay is taken off the list.

    A result that reads such a folder must have been written before the scope ends.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Spark removes shuffle files once the driver's JVM has collected the plans that made them; ask for that."""
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, which survives a lost executor."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer partitions than there are cores to all of them, for work that costs more than the exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

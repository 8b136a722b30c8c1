"""Result stores: partitioned parquet with idempotent rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.session import scratch_path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder of the cluster."""
    return scratch_path(spark, name)


def append(df: DataFrame, path: str, keys: list[str]) -> None:
    """Add rows under their key partitions; running a key again replaces its rows.

    Rows are dealt out by key, and keys larger than the session's advisory
    partition size by as many tasks as their size asks for.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def load(spark: SparkSession, path: str, **where) -> DataFrame:
    """Stored rows; conditions on key columns prune partitions."""
    df = spark.read.parquet(path)
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store has been written, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

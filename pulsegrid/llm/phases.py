"""Steps of a long job that end in the shared folder.

A job of several shuffles runs as phases: each one is written to the folder that
``spark.checkpoint.dir`` names and read back, so a lost executor costs at most one
phase, and the shuffle files of a phase go as soon as it has been written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.session import shared_dir

# Let Spark delete a query's shuffle files when that query has ended.
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Whole texts to Python workers in small batches: a batch of the default row count holds tens of MB, several times over.
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


@contextmanager
def _with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def phase(df: DataFrame, name: str, small_batches: bool = False) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back; the folder goes when the application ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with _with_settings(spark, {**_CLEANUP, **(_SMALL_BATCHES if small_batches else {})}):
        df.write.mode("error").parquet(path)
    jvm, context = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)

"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Fallback folder of a local session, by application id.
_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Shuffle partitions are left to adaptive execution: it starts from a high
    count and coalesces small partitions, so the same code suits a laptop and
    a large cluster.  Pass ``spark.sql.shuffle.partitions`` to override.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder of the cluster.

    Only a local session (tests) may fall back to a temporary folder; on a
    cluster the setting has to be there, as executors cannot share ``/tmp``.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} is not set; name a folder all executors can reach")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="pulsegrid-")
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with data that outlives any executor, for inputs that
    several jobs read (model fitting, for instance).
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``materialize`` for the length of a block; the folder goes with it."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("error").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Session defaults and durable lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "evalspark", shuffle: int = 8,
                  **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle),
                 "spark.ui.enabled": "false",
                 "spark.ui.showConsoleProgress": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``; only a session without one (tests, a laptop)
    gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, count: int | None = None) -> DataFrame:
    """Few bytes that make much work, dealt by ``keys`` into parts of about ``rows`` of its (or of ``count``) rows, as many as there are
    cores at least."""
    count = df.count() if count is None else count
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-count // rows)), *keys)

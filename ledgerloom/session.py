"""Session settings and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on (UTC clock, adaptive skew handling)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; only local runs get a scratch one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
    sc.setCheckpointDir(shared)


_FOLDERS: list[str] = []  # scratch folders of this driver that have not been released


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, until :func:`release`."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Delete the durable steps this driver has written so far; their number. Call it when results that read them are stored."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step as a table in the shared folder and read it back.

    Every later branch sees the same rows, lost executors cannot change them, and being columnar with known size
    it still prunes columns and lets the optimizer choose joins.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

"""Session helpers: a local session for tests/bench and the shared scratch folder.

On a cluster the session is created by the caller; nothing here overrides its
settings.  The only thing the library needs from the session is a *shared*
folder for intermediate tables (``spark.checkpoint.dir``).  If the session does
not name one (tests, local runs) we create one under ``/tmp`` and record it in
the session so that every later call agrees on it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "logsift") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOGSIFT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``, else the folder set on the context.
    Only a local session may leave both unset (tests): it gets a private folder.
    """
    sc = spark.sparkContext
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="logsift-ckpt-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, conf)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf)
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per SparkContext).

    Operators that run Python on executors (``mapInPandas``) call this; on a
    cluster where the package is installed on every node it is a no-op cost.
    """
    sc = spark.sparkContext
    if getattr(sc, "_logsift_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="logsift-py-"), "logsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._logsift_shipped = True


def materialize(df, name: str):
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor recomputes nothing upstream) and lets
    later passes prune columns at the scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)

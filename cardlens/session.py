"""SparkSession defaults for cardlens jobs.

Everything that changes query *results* (time zone) or survivability
(checkpoint folder) is pinned here; everything that only changes speed is a
plain Spark conf the cluster owner may override.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    # Results depend on UTC hours / weekdays; pin the session zone.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce tiny shuffle partitions, split skewed
    # join partitions, switch to broadcast when a side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed streaming state lives in RocksDB, off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    # Looking up the calling line for every column expression doubles the time
    # it takes to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cardlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with cardlens defaults.

    ``master`` is only set for local runs; on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster
        builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cardlens`` importable by executor-side Python (pandas UDFs,
    ``mapInPandas``) wherever the driver runs: zip the package once per
    application and ``addPyFile`` it (Spark distributes it to executors)."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="cardlens-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for f in pkg.rglob("*.py"):
            zf.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, may go without: it
    gets a fresh scratch folder.  On a cluster a folder of one machine would
    lose data, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="cardlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def is_local(master: str) -> bool:
    """Driver and executors are one process (not so for ``local-cluster``)."""
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and streaming checkpoints."""
    return ensure_checkpoint_dir(spark)


def materialize(df):
    """Cut lineage: write ``df`` as parquet under the shared checkpoint folder
    and read it back.

    Used where one expensive intermediate feeds several consumers.  Unlike an
    eager RDD checkpoint this computes the input once, stores it columnar
    (later scans prune columns and push filters), and the files survive the
    loss of the executors that wrote them.
    """
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Session construction and the shared scratch location used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on; a cluster may override sizes but not semantics.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows are whole e-mails: keep Arrow batches small for the MIME job
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # a message file is some 20 KB: a task should take hundreds of them, not 32
    "spark.sql.files.openCostInBytes": "524288",
    "spark.ui.enabled": "false",
}


_LOCAL_ROOT: str | None = None


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "mailsift") -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    On a cluster call it without ``master``; the launcher decides. Tests pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("MAILSIFT_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``mailsift`` importable in the Python workers (``addPyFile`` of a zip of the
    package, once per SparkContext) — needed by the steps that run Python in tasks (the
    message parser, the message-file writer). On a cluster this is what ``--py-files`` does."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="mailsift-pyfiles-"), "mailsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names it, and without it this is an error there; only with a local master (tests) a
    private temporary folder is created and registered, so lineage cuts and stream checkpoints always land in the
    folder the cluster declared.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _LOCAL_ROOT
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="mailsift-ckpt-")
        root = _LOCAL_ROOT
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for a written intermediate table."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` once as a Parquet table in the shared checkpoint folder and
    continue from that table.

    Used after a stage whose result several later steps read (the deduplicated corpus, a
    fitted model), so the upstream runs exactly once and a lost executor never replays it.
    (An RDD checkpoint would run the upstream twice — once for the action, once for the
    write — unless cached; a written table is one pass, columnar and compressed.)
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

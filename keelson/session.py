"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "keelson", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application, wherever the driver was started."""
    context = spark.sparkContext
    name = f"keelson-{context.applicationId}.zip"
    if any(str(f).endswith(name) for f in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    # the driver serves the file as long as it lives, so its folder goes at exit only
    folder = tempfile.mkdtemp(prefix="keelson-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / name
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; taken from ``spark.checkpoint.dir``.

    Only when the session names none (a local run) a temporary folder is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    current = context.getCheckpointDir()
    if current is None:
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="keelson-"))
        current = context.getCheckpointDir()
    return named or current


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: stable rows that outlive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt evenly over tasks of at most about ``rows`` rows, however its files or shuffles lie."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df.coalesce(1)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table, sink or stream."""
    return f"{shared_dir(spark).rstrip('/')}/keelson-{label}-{uuid.uuid4().hex}"

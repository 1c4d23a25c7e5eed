"""Session defaults and lineage cutting that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str = "local[8]", app: str = "quillon", **extra: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of a session, once; they need not find it on their own path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quillon-package-")) / "quillon.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # The driver serves the file to the executors; it is read there only.
    spark.sparkContext.addPyFile(str(path))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local.

    Raises ``RuntimeError`` on a cluster that names no folder: a folder of one machine
    would not be seen by the others.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from the files.

    Use it where a result is read more than once and is costly to make again.
    The files outlive executors, which a local copy would not. A checkpointed frame
    keeps the optimizer's guess of its size, in which an array counts as one element, so
    that a join could broadcast it however large it is; what is returned here has no
    guess: joins shuffle, and only sizes measured at run time can turn them.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)

"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

BATCH_BYTES = 8 << 20


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the one that driver and executors share: spark.checkpoint.dir of the session. Only where the
    session names none (a local test) a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers of this application, once; they need it for functions that run there.

    Batches for Python are held to BATCH_BYTES, so that a worker's memory does not depend on how long rows are.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark

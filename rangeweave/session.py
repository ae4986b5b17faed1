"""Session set-up: the package on the executors, and the data sources by name."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers, unless PYTHONPATH names its folder for them already."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if sc.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="rangeweave-")
    with zipfile.ZipFile(f"{folder}/rangeweave.zip", "w") as z:
        for p in sorted((root / "rangeweave").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f"{folder}/rangeweave.zip")  # served to executors by the driver
    _shipped.add(sc.applicationId)


def register_all(spark: SparkSession) -> None:
    """Makes every format readable by spark.read.format("rw_<name>")."""
    from .sources.registry import FORMATS, source_class

    ship(spark)
    for fmt in FORMATS.values():
        spark.dataSource.register(source_class(fmt))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.  Where that is unset, a temporary folder serves a local master; on a cluster, where each machine would write to a disk of its own, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/rangeweave-shared"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for raw files in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path

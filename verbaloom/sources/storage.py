"""The folder that driver and executors share, and what a run leaves in it for its own lifetime."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder of our own in local mode alone.

    On a cluster a local folder would be written where other executors cannot read it, so there it is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="verbaloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder; that part is deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = f"{shared_dir(spark)}/verbaloom-{app}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[app] = folder
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"

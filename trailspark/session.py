"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "trailspark", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the session comes from the submitter; every function here works with
    whatever session it is given and sets nothing on it.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs a third of the time it takes to build a report.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh path under ``base``, or else under the shared folder named by ``spark.checkpoint.dir``.

    Where neither is given, only a single-machine session may use a temporary folder: on a
    cluster a machine-local path is lost with its executor. The session is not changed.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share, or name a scratch folder")
        base = _local_scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="trailspark-"))
    return f"{base.rstrip('/')}/trailspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, base: str | None = None) -> None:
    """Deletes what this application has written to scratch paths."""
    base = base or spark.conf.get("spark.checkpoint.dir", None) or _local_scratch.get(spark.sparkContext.applicationId)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/trailspark/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Spark session and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; for a cluster, pass its master and more partitions."""
    builder = (
        SparkSession.builder.master(master)
        .appName("rill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below `spark.checkpoint.dir`; only where that is unset and the master is local (tests), below a
    folder of our own, which is removed at the end. A cluster without the setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            folder = tempfile.mkdtemp(prefix="rill-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _OWN[app] = "file://" + folder
        root = _OWN[app]
    return f"{root.rstrip('/')}/rill-{uuid.uuid4().hex}"

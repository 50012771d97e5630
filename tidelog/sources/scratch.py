"""Where driver and executors keep what they share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that setting is absent on one machine (tests) a temporary folder is made; on a cluster, which
    doesn't share those, its absence is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("tidelog.own.checkpoint.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("tidelog.own.checkpoint.dir", own)
    return own


#: What this process has named so far.
_NAMED: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else has."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _NAMED.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes what new_path has named: for when results that read it are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _NAMED:
        path = _NAMED.pop()
        for suffix in ("", "-landing", "-content"):
            target = jvm.org.apache.hadoop.fs.Path(path + suffix)
            target.getFileSystem(conf).delete(target, True)

"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where that is unset, a session whose driver runs all tasks (master local) has a folder of its own; any other is
    refused, for its executors wouldn't see the driver's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        app = spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="stratalog-shared-")
        where = _own[app]
    return where.rstrip("/")

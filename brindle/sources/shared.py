"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from ..errors import StorageError


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only where a session has none and runs in one process, as in local tests, a temporary folder is set for it:
    executors elsewhere would not share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise StorageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")

"""A fresh folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder that `spark.checkpoint.dir` names.

    Executors of a cluster do not see each other's disks, so without that setting the job stops here;
    only a session whose executors are threads of this process gets a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siltscreen-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Where checks may write files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names.

    Where that is unset, one is set for the session: a temporary one where driver and tasks share
    a machine, as in tests, and on a cluster one in the warehouse, which all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        one_machine = master.startswith("local") and not master.startswith("local-cluster")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}" if one_machine else f"{warehouse}/shared"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"

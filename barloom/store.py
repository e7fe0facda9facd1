"""Shared-storage tables that cut lineage.

Derived base tables (bars) are written once per application under the folder named by ``spark.checkpoint.dir`` and read back as
Parquet, so a lost executor never loses them and no query scans the ticks twice.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_lock = threading.RLock()  # a stage may build on other stored stages
_written: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="spark-barloom-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per application under ``key`` and return a scan of it."""
    app = spark.sparkContext.applicationId
    slot = f"{app}|{key}"
    with _lock:
        path = _written.get(slot)
        if path is None:
            digest = hashlib.sha256(key.encode()).hexdigest()[:24]
            path = f"{checkpoint_root(spark).rstrip('/')}/barloom/{app}/{digest}"
            build().write.mode("overwrite").parquet(path)
            _written[slot] = path
    return spark.read.parquet(path)


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to a new folder of the shared storage and return a scan of it; for a table that the next step reads more than once."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/barloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)

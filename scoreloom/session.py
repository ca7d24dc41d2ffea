"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def build_session(app_name: str = "scoreloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for; every one can be overridden by ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """One folder per process for local runs without the setting, removed when the process ends."""
    base = tempfile.mkdtemp(prefix="scoreloom-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a machine-local folder would be
    unreadable to the other executors, so an unset folder is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")

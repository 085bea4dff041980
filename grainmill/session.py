"""Session settings, and making the package importable in Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "grainmill", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package where it is not installed."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep) and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, path]) if path else ROOT


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; in a local session without one, in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # a local-cluster has executors with folders of their own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="grainmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/grainmill-{uuid.uuid4().hex}"

"""Sessions, and what executors need of this package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def create_session(app: str = "leakloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that this library's results rely on: UTC and adaptive plans."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="leakloom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # code only; executors fetch it from the driver
    target = os.path.join(folder, "leakloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may leave it unset, as tests do; it gets one under the warehouse.
    Anywhere else that would be a disk which other machines do not see, hence an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "")
    given = context._jsc.sc().getCheckpointDir()  # set by a program instead
    if not named and given.isDefined():
        return given.get()
    if not named and not re.match(r"local($|\[)", context.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its scan has fewer splits than those, as one small file has.

    A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

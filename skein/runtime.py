"""Session, shared folder and staging helpers."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application; they need no installation of it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, files in os.walk(here):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.join("skein", os.path.relpath(full, here)))
    path = f"{fresh_dir(spark, 'package')}/skein.zip"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(hpath)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(files.makeQualified(hpath).toString())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a local session, whose one machine is all there is, gets a temporary one where it names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scopes: list[list[str]] = []


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder among those of this application, which ``clean_up`` deletes."""
    path = f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"
    if _scopes and purpose != "package":
        _scopes[-1].append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged within the block at its end; what is computed there must be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application staged. Tables and results that read from there are gone after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors. ``by`` gives each of its values a folder."""
    path = fresh_dir(df.sparkSession, purpose)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a table written by ``stage`` once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split("://")[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, from the file system's summary."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hpath).getLength()

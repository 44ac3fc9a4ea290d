"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Completion calls cost money: never run the same task twice on purpose.
    "spark.speculation": "false",
    # As in Python, the last of repeated keys in a JSON object counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_made: list[tuple[int, str]] = []
_shipped: set[str] = set()


def build_session(app_name: str = "inkwell", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle width and split size stay with the cluster: AQE coalesces from
    whatever ``spark.sql.shuffle.partitions`` it is given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run; once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='inkwell-')}/inkwell.zip"
    with ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, f"{package.name}/{path.relative_to(package)}")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def work_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Where it is unset and the driver runs all tasks itself, as in tests, it is set
    to a new folder; a cluster has no folder to fall back on.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/") + "/inkwell"


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder name not used before. Nothing is deleted until ``clean_work``."""
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((threading.get_ident(), path))
    return path


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system that holds ``path``, and the path as it takes it."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what this thread wrote inside; nothing may be read from it later."""
    before = set(_made)
    yield
    for entry in [e for e in _made if e not in before and e[0] == threading.get_ident()]:
        _made.remove(entry)
        delete_path(spark, entry[1])


def clean_work(spark: SparkSession) -> None:
    """Delete the intermediate tables this process wrote; results read from them must be saved first."""
    while _made:
        delete_path(spark, _made.pop()[1])


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out to as many tasks as ``inkwell.spread`` says; without that setting the scan's splits stay.

    For inputs that cannot be split, such as one file with one row group.
    """
    tasks = df.sparkSession.conf.get("inkwell.spread", None)
    return df.repartition(int(tasks), *keys) if tasks else df

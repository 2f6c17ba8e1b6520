"""Where tables are kept that a session writes for itself, and a look into folders of tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. One of our own only where the session names
    none and runs in a single process; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The part of it that is this session's."""
    return f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}"


def _opened(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _opened(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _opened(spark, path)
    fs.delete(where, True)


def catalogue(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables `folder/<name>.parquet`."""
    where, fs = _opened(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def version(spark: SparkSession, paths: list[str]) -> str:
    """Changes when one of these files or folders does."""
    out = []
    for path in paths:
        where, fs = _opened(spark, path)
        s = fs.getFileStatus(where)
        out.append(f"{s.getModificationTime()}-{s.getLen()}")
    return "-".join(out)

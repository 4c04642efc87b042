"""Session helpers: shipping the package to Python workers and shared scratch storage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in every Python worker of the application (once per application)."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId not in _shipped:
            sc.addPyFile(_packed())
            _shipped.add(sc.applicationId)
    return spark


def _packed() -> str:
    """This package as a zip file."""
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{name}_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, files in os.walk(here):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, here)))
    return path


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where none is set (local tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = sc._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="scratch")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the application has ended: the folder's owner cleans up
        pass


def at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder in scratch storage when the application ends."""
    atexit.register(_remove, spark, path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back: cuts lineage and recomputation.

    The files outlive lost executors. They are removed when the application ends, or by :func:`drop`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Remove what :func:`cut` wrote, once all that is made of it has been written itself; and let Spark's
    cleaner know, which removes the shuffle files of plans that nobody holds any more."""
    for df in cuts:
        _remove(df.sparkSession, df._scratch)
    gc.collect()
    SparkSession.active()._jvm.System.gc()

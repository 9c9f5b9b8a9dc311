"""Tables that an operator steps over: written to the shared folder, so that no round is computed again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of this machine, if all of Spark runs on it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="coppice-")
            atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables, in the shared one; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df``, written and read back; the files stay until the driver's Python ends, or ``forget``."""
    path = folder(df.sparkSession, "step")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._settled_to = path
    return back


def forget(*tables: DataFrame) -> None:
    """Removes the files of tables made by ``settled`` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._settled_to)

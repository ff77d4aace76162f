"""Tables that cut lineage, below the shared folder that the session names.

``spark.checkpoint.dir`` is read from the session.  Where it is unset a cluster uses its warehouse,
which executors share, and a local session (tests, notebooks) a temporary folder.  A written table
survives lost executors; localCheckpoint would not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    global _own_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone already; the folder is scratch space
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path that is deleted when Python exits."""
    path = f"{scratch_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and read it back: a lost executor costs a re-read, plans stay short.

    Spark drops the shuffle files of the write when it ends; what was written needs them no more.
    """
    spark = df.sparkSession
    path, was = new_folder(spark, name), spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN, was) if was is not None else spark.conf.unset(CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``saved`` returned; nothing may read them any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    _delete(spark, path)

"""Reading of tables, spreading of narrow inputs and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Operators that bring an exchange, by their names in a logical plan.
_EXCHANGES = re.compile(r"(?m)^[\s:+|-]*(?:Aggregate|Join|Sort|Window|Repartition\w*|RebalancePartitions|Distinct|Deduplicate|GlobalLimit|Except|Intersect)\b")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition only where a scan yields fewer tasks than the cluster has cores.

    A large input already has many splits and is left as it is, so this costs a shuffle only
    for inputs that are small or were written as one file. What comes out of an exchange is
    left to adaptive execution; asking for its partitions would run the stages before it.
    """
    execution = df._jdf.queryExecution()
    if _EXCHANGES.search(execution.optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if execution.toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, which all executors share.

    It is that of ``spark.checkpoint.dir``; one is set here only where the session names none
    and runs on one machine, as in tests.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.master.startswith("local["):
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The checkpoint's files go when nothing refers to it any more, if the session was begun with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Folders that were made for intermediate results and not released yet, by application.
_FOLDERS: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one for an intermediate result.

    It must outlive the call, as the result is read later. ``release`` deletes those of a
    session; so does the end of its process.
    """
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        atexit.register(_release_at_exit, spark)
    _FOLDERS.setdefault(application, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of a session and say how many there were: for use once results are written."""
    sc = spark.sparkContext
    if sc._jsc is None:  # stopped; its folder is the cluster's to clear
        return 0
    known = _FOLDERS.get(sc.applicationId, [])
    conf, make = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    for folder in known:
        path = make(folder)
        files = path.getFileSystem(conf)
        for status in files.globStatus(make(f"{folder}*")) or []:
            files.delete(status.getPath(), True)
    done = len(known)
    known.clear()
    return done


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001 - the JVM may have gone before; the folder is then the cluster's to clear
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    For intermediate results that are used more than once: they are computed once and survive
    the loss of an executor, and column encodings keep them smaller than a checkpoint.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

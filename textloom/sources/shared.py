"""Intermediate tables in the folder that all machines see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Only a local session may leave the setting out; it gets a temporary folder. A cluster
    without the setting is an error, since a machine's own folder would lose or split data.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        root = _LOCAL.get(context.applicationId) or tempfile.mkdtemp(prefix="textloom-")
        _LOCAL[context.applicationId] = root
    return f"{root.rstrip('/')}/textloom-{context.applicationId}"


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as there are cores, for costly work in its rows.

    A file of one row group is read by one task. Large tables have more splits than cores
    and stay as they are. Only for plain scans: counting the parts of a shuffled table runs it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cut lineage that survives lost executors.

    Catalyst knows the size of a written table, so it broadcasts one only if it is small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._textloom_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_textloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Call it when its results are written."""
    _delete(spark, shared_folder(spark))

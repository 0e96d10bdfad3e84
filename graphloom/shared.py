"""What needs the shared store: lineage cuts and new folders where spark.checkpoint.dir says, small files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets a temporary folder, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """A path and its store, as Hadoop's objects."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Writes a small file; without `replace`, False if it is there already."""
    made, store = file_system(spark, path)
    try:
        out = store.create(made, replace)
    except Exception as failed:
        if not replace and store.exists(made):
            return False
        raise failed
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True

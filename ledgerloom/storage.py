"""Reliable materialization for data that is read many times."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in
    ``spark.checkpoint.dir``. Only a session that runs in one process and names
    none gets a temporary one; with executors of their own that is an error, as
    they would not see each other's files."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def delete_checkpoint(df: DataFrame) -> None:
    """Remove the files of a checkpointed frame that will not be read again."""
    for rdd in _checkpoints(df):
        where = rdd.getCheckpointFile()
        if where.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _checkpoints(df: DataFrame):
    leaves = df._jdf.queryExecution().logical().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            yield leaf.rdd()


@contextmanager
def held(df: DataFrame, spread: bool = False) -> Iterator[DataFrame]:
    """``df`` materialized for repeated passes: checkpointed, so a lost executor
    costs a re-read and not a recomputation, and cached on top for speed. The
    files go when the passes are over.

    ``spread`` is for passes that are heavy on computation: data in fewer
    partitions than cores is dealt out to all of them. That changes where rows
    lie, hence the order of float sums, and nothing else.
    """
    saved = cut_lineage(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    kept = saved
    if spread and saved.rdd.getNumPartitions() < cores:
        kept = saved.repartition(cores)
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
        delete_checkpoint(saved)

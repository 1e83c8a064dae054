"""Cutting lineage in the folder that a cluster's executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only a local master without that setting gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared folder; use it for what several later branches read."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that Spark wrote, wherever its file system is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to any more.

    It does so when the driver's garbage is collected, which a few long stages may not bring about by themselves.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage of `df` by compressed files in the shared folder: for texts, of which a checkpoint takes several times as much."""
    spark, folder = df.sparkSession, folder or f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


class Stages:
    """What a run keeps as compressed files, deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.known = spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        folder = f"{self.folder}/{uuid.uuid4().hex}"
        self.known.append((kept(df, folder), folder))
        return self.known[-1][0]

    def only(self, *needed: DataFrame) -> None:
        """Delete all that was kept but these, and the shuffle files that led to it."""
        for df, folder in self.known:
            if not any(df is x for x in needed):
                delete_folder(self.spark, folder)
        self.known = [x for x in self.known if any(x[0] is y for y in needed)]
        release(self.spark)

    def turn(self, df: DataFrame, *needed: DataFrame) -> DataFrame:
        """Keep `df`, and of all before it only what is needed still."""
        out = self.keep(df)
        del df
        self.only(out, *needed)
        return out

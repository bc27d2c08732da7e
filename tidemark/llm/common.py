"""Shared pieces of the training-data operators: tables, scratch tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is set, a local session (tests) gets a temporary one; a cluster must name one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        root = context.getCheckpointDir()
    return root.rstrip("/") + "/tidemark"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs don't recompute it and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete a table written by materialize(), once nothing reads it any more."""
    drop_path(df.sparkSession, df._tidemark_path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_ACTIVE: list = []


def sole_cache(cache):
    """The cache of the stage that a Python worker works for; the one before it is emptied, as workers outlive stages."""
    if _ACTIVE and _ACTIVE[0] is not cache:
        _ACTIVE.pop().clear()
    if not _ACTIVE:
        _ACTIVE.append(cache)
    return cache


def held_out(doc_id) -> F.Column:
    """True for rows that models never learn from: crc32 of the id as text leaves 2 when divided by 4; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in edges (a, b): comp is the smallest id reachable.

    Minimum labels travel along the edges and jump over the label of the label, so the
    number of rounds is about the logarithm of the longest path. Each round is written to
    the shared folder. Hot nodes only meet partial min() aggregations and splittable joins.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "cc-labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        near = labels.join(heard, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        far = labels.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        stepped = materialize(near.join(far, "comp").select("id", "old", F.least("comp", "root").alias("comp")), "cc-labels")
        drop_scratch(labels)
        labels = stepped.select("id", "comp")
        labels._tidemark_path = stepped._tidemark_path
        if stepped.where("comp <> old").isEmpty():
            drop_scratch(both)
            return labels

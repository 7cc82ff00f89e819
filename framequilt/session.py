"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``. Where none is set, one is chosen in local mode only: on a cluster a machine's own folder would be lost with the machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="framequilt-checkpoint-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all machines share, for files that a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so that later stages neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Removes the files of a frame from ``cut`` that nothing reads any more: rounds of a loop would otherwise pile up. Other frames are left alone."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    kept = plan.rdd().getCheckpointFile()
    if kept.isDefined():
        fs, path = _path(df.sparkSession, kept.get())
        fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the width that the cluster's owner chose."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever store the path names."""
    fs, p = _path(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder (not below it), in their order."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, as a report is, on whatever store the path names."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> bytes:
    """Content of one file, whole: for sheets and the like, which are small."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])

"""Tables written to the folder that all executors share, to cut lineage in iterative work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a local session (tests) gets a temporary one; a
    cluster, whose machines share no such folder, is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cinderlake-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def staged(df: DataFrame, name: str, observation: Observation | None = None, *observed) -> DataFrame:
    """Write df to the shared folder and read it again. An observation takes sums along the way."""
    path = f"{shared_folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    (df.observe(observation, *observed) if observation is not None else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df._staged_at
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

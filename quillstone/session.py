"""What every operator needs of a session: the folder for checkpoints and the tables of a directory."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder in ``spark.checkpoint.dir``. Where that is unset a local session gets a folder of its
    own; on a cluster it is an error, as executors could not read a folder of one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))


def is_local(master: str) -> bool:
    """One process is the whole cluster."""
    return master == "local" or master.startswith("local[")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")

"""Reading the Parquet tables and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_id(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per `key` with `columns`. Rows that repeat an id are the same record, so any one of them serves; rows whose id is null name no record and are left out."""
    return df.where(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names; a local one is made only where none is set and the master is local."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quireflow-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

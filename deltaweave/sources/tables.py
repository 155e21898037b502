"""Parquet tables as relations, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..relation import Relation


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Relation:
    """Those columns of a table, each row once; only they are read."""
    return Relation.of(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage of a loop and survives the loss of an executor."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # one machine, as in tests
        folder = tempfile.mkdtemp(prefix="deltaweave-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/deltaweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

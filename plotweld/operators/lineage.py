"""Small results written to the shared checkpoint folder, so that plans that use them many times do not repeat them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir, or a temporary one in local mode only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="plotweld-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed now and kept in that folder."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> str:
    """Where in that folder the rows of `df` now are, as Parquet, for a row of another table to name."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path

"""Scratch tables in the shared checkpoint folder, table access, and column names that never clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(name: str, columns) -> str:
    """`name`, with underscores added until no column is called so (names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """The schema and one more field at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="plotweld-")
        spark.sparkContext.setCheckpointDir(_OWN_ROOT[app])
    return _OWN_ROOT[app]


class Scratch:
    """Tables written to the shared folder to cut lineage; dropped when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/plotweld/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

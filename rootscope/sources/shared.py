"""The folder that all machines share: tables that loops and later jobs read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_unset: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    conf = spark.sparkContext.getConf()
    if given := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir"):
        return given
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _unset.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame, label: str = "graph") -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, without lineage, and still there if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Frees a folder that cut wrote, once what was made of it has been written."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

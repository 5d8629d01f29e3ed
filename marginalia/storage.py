"""Tables in the folder that driver and executors share, where a lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only where the session runs on this machine alone."""
    named = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{FOLDER} must name a folder that all executors share")
    named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set(FOLDER, named)
    return named


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

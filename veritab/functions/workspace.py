"""A private folder under the shared checkpoint folder for tables written between stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veritab.functions.distributed import checkpoint_dir


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def discard(*tables: DataFrame) -> None:
    """Delete the folders of stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        base = checkpoint_dir(spark)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if at.toUri().getPath().startswith(fs.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)).toUri().getPath()):
                fs.delete(at, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as parquet and read it back: cuts lineage, keeps column pruning for later reads."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

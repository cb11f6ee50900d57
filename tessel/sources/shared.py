"""Intermediate tables in the folder that all executors share.

A table written here cuts lineage and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    Where the setting is absent a local session (tests) makes a temporary folder once
    and remembers it; on a cluster, whose machines do not share such a folder, this raises.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        folder = spark.conf.get("tessel.shared.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError(f"set {SETTING} to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tessel-")
            spark.conf.set("tessel.shared.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` made and nothing reads any more; files elsewhere stay."""
    spark = df.sparkSession
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    plain = lambda folder: jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    own = plain(f"{shared_dir(spark)}/tessel") + "/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain(folder).startswith(own):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)

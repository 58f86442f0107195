"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE is the size check behind every join here: no operator forces a broadcast, so a side is broadcast only when its
# measured size is below the threshold, and hot join keys are split at run time.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "larderflow", **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by the cluster in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: later passes read only the columns they need and survive lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` gave, once nothing reads it any more; only below the shared folder."""
    spark = table.sparkSession
    folders = {file.rpartition("/")[0] for file in table.inputFiles()}
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if system.makeQualified(path.getParent()).toString() != system.makeQualified(base).toString():
            raise ValueError(f"{folder} is not a table of the shared folder")
        system.delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whichever file system the path names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)

"""Tables written on the way, in the folder that driver and executors share; what cuts a lineage survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions, by application: a running session's spark.checkpoint.dir can't be set.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one stands in for it only where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="mnemolake-")
        path = _LOCAL[context.applicationId]
    return path.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes the files of materialised frames that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)

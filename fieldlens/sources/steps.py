"""Tables between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions without spark.checkpoint.dir, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and everything runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("iterations write their steps: set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="fieldlens-")
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: its lineage ends there, and it outlives the executor that made it."""
    path = f"{shared_folder(df.sparkSession)}/fieldlens-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fieldlens_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of written(), once what was made from them is itself written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._fieldlens_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

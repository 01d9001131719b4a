"""Shared Spark helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python: texts are long, so fewer than Spark's 10,000.
ARROW_ROWS = "512"
#: 64-bit words of the fixed-size bitmap that thins a table before a shuffle (2 MB).
BITMAP_WORDS = 1 << 18


#: Temporary folders of sessions without spark.checkpoint.dir, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="fieldlens-")
        _own[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the lineage ends in a table that
    outlives the executor that wrote it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldlens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once all that was made from them is itself written."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df._fieldlens_path)
        path.getFileSystem(conf).delete(path, True)


_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts can hold, and send this package to the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="fieldlens-")) / "fieldlens.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)


def _bitmap(keys: DataFrame, column: str) -> DataFrame:
    """One row with a bitmap of fixed size of ``keys[column]``."""
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(BITMAP_WORDS * 64))
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
        .toArrow()  # BITMAP_WORDS rows at most
    )
    dense = np.zeros(BITMAP_WORDS, np.int64)
    dense[np.asarray(words.column("w"))] = np.asarray(words.column("bits"))
    return keys.sparkSession.createDataFrame([(dense.tolist(),)], "__bits array<bigint>")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` may be in ``keys[column]``, and those whose key is not: a filter before a shuffle,
    never after.

    A bitmap of fixed size is broadcast, so its size doesn't follow the data; with very many keys it lets
    more rows through, and an exact join has to follow. Null keys are in neither part.
    """
    bitmap = F.broadcast(_bitmap(keys, column))
    probe = df.withColumn("__spot", F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 64))).where(key.isNotNull())
    hit = F.expr("shiftright(get(__bits, cast(shiftright(__spot, 6) as int)), cast(__spot % 64 as int)) & 1L = 1L")
    return probe.join(bitmap, hit, "left_semi").drop("__spot"), probe.join(bitmap, hit, "left_anti").drop("__spot")


def may_be_in(df: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """The first part of maybe_in()."""
    return maybe_in(df, key, keys, column)[0]


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0

"""Tables in one file a week: what files there are, checked before any row is read, and sinks that replace a week at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.sources.tables import read_csv

#: The number of a week in a file's name; the aggregate of all weeks has none.
_WEEK = r"w(?:eek)?[_-]?(\d{1,2})(?:\D[^/]*)?$"


def file_table(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``file, name, length, week`` of the files in a folder, from their metadata: no content is read. ``week`` is null where the name has none (SRC-2)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("path").alias("file"), "length")
    name = F.element_at(F.split("file", "/"), -1)
    return files.select("file", name.alias("name"), "length", F.nullif(F.regexp_extract(F.lower(name), _WEEK, 1), F.lit("")).cast("int").alias("week"))


def weekly_files(spark: SparkSession, folder: str, pattern: str = "*.csv", weeks: int | None = None) -> list[tuple[int, str]]:
    """(week, file) of the weekly files in order; files without a week, such as the aggregate, are left out (SRC-2). With ``weeks``, another number of weeks
    is an error, and so are two files of a week, before any row is read (SRC-4)."""
    rows = file_table(spark, folder, pattern).where("week is not null").orderBy("week", "file").collect()  # a row a file
    got = [r.week for r in rows]
    if twice := sorted({w for w in got if got.count(w) > 1}):
        raise ValueError(f"several files of week {', '.join(map(str, twice))}")
    if weeks is not None and len(got) != weeks:
        raise ValueError(f"expected {weeks} weekly files, found {len(got)}: {', '.join(map(str, got))}")
    if not got:
        raise ValueError(f"no weekly files like {pattern} in {folder}")
    return [(r.week, r.file) for r in rows]


def read_weekly(spark: SparkSession, folder: str, schema: T.StructType, required: list[str], pattern: str = "*.csv", weeks: int | None = None) -> DataFrame:
    """The rows of the weekly files with their ``week``. Only the columns of ``schema`` are read from the files, so that names and other identities that
    a study doesn't need never leave them (SRC-6)."""
    files = weekly_files(spark, folder, pattern, weeks)
    rows = read_csv(spark, [f for _, f in files], schema, required)
    name = F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.withColumn("week", F.regexp_extract(name, _WEEK, 1).cast("int"))


def write_bounded(df: DataFrame, path: str, partition: list[str], sort: list[str], rows_per_file: int, rows_per_task: int = 5_000_000, files_per_task: int = 200) -> None:
    """Parquet by ``partition`` columns, sorted within files of ``rows_per_file`` rows at most (SNK-1 to SNK-3).

    Partitions that ``df`` has are replaced, others stay. A partition with many rows is dealt over tasks, as many as its rows and files ask for; a small
    one is one task's. All tasks but a partition's last have whole files, so that it has no more files than its rows fill: rows are numbered within lanes of a
    partition, a lane beginning where those before it end.
    """
    span = rows_per_file * max(1, min(rows_per_task // rows_per_file, files_per_task))

    def on(columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns])

    sizes = df.groupBy(*partition).agg(F.ceil(F.count("*") / span).alias("__lanes"))
    lanes = df.alias("d").join(sizes.alias("s"), on(partition)).select("d.*", F.pmod(F.xxhash64(*[F.col(f"d.{c}") for c in sort]), "__lanes").alias("__lane"))
    ahead = Window.partitionBy(*partition).orderBy("__lane")
    starts = lanes.groupBy(*partition, "__lane").agg(F.count("*").alias("__n")).withColumn("__start", F.sum("__n").over(ahead) - F.col("__n")).drop("__n")
    placed = lanes.withColumn("__place", F.row_number().over(Window.partitionBy(*partition, "__lane").orderBy(*sort)))
    task = F.floor((F.col("__start") + F.col("__place") - 1) / span).alias("__task")
    dealt = placed.alias("d").join(starts.alias("s"), on([*partition, "__lane"])).select(*[F.col(f"d.{c}") for c in df.columns], task)
    clustered = dealt.repartition(*partition, "__task").sortWithinPartitions(*partition, *sort).drop("__task")
    clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(*partition).parquet(path)


def files_of(df: DataFrame, partition: list[str]) -> DataFrame:
    """``partition, files, rows, most`` (rows in a file) of a table that was read."""
    per = df.groupBy(*partition, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return per.groupBy(*partition).agg(F.count("*").alias("files"), F.sum("n").alias("rows"), F.max("n").alias("most"))


def written_once(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, which is written where there is none yet: what several outputs share, such as bootstrap draws."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


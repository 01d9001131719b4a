"""Reading and writing tables: format-agnostic lookup, weekly shards, schema checks, prepared datasets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header jobs at a time.
HEADER_JOBS = 8


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, required: list[str]) -> DataFrame:
    """CSV with a header under an explicit schema (SRC-1): columns are taken by name from the header of their own file,
    required ones must be in every file, optional ones that are missing become typed nulls. ``NA`` and empty are null;
    any other text that isn't of a column's type is an error when it is read. Files are grouped by header, so files whose columns
    are ordered otherwise mix; for that the first block of each file is opened, by some jobs at a time of one task each that stops
    after a line.
    """
    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        files = _files(spark, path)
        heads = list(pool.map(lambda f: spark.read.text(f).limit(1).collect(), files))
    groups: dict[str, list[str]] = {}
    for f, head in zip(files, heads):
        if head:
            groups.setdefault(head[0].value, []).append(f)
    parts = [_one_header(spark, own, schema, required) for _, own in sorted(groups.items())]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files under a path or paths, by name; their content isn't read."""
    return [r.path for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]


def _one_header(spark: SparkSession, files: list[str], schema: T.StructType, required: list[str]) -> DataFrame:
    head = spark.read.option("header", True).csv(files)
    if missing := [c for c in required if c not in head.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def column(f: T.StructField) -> Column:
        if f.name not in head.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return text.alias(f.name)
        value = text.try_cast(f.dataType)
        blank = text.isNull() | F.upper(F.trim(text)).isin("", "NA")
        wrong = F.raise_error(F.concat(F.lit(f"{f.name}: not of type {f.dataType.simpleString()}: "), text)).cast(f.dataType)
        return F.when(blank, F.lit(None).cast(f.dataType)).when(value.isNull(), wrong).otherwise(value).alias(f.name)

    return head.select(*[column(f) for f in schema.fields])


def read_any(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The one table ``name`` under ``root`` as Parquet, CSV or gzipped CSV; none or several are an error (SRC-3)."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [e for e in ("parquet", "csv", "csv.gz") if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.{e}"))]
    if len(found) != 1:
        raise ValueError(f"{name}: expected one table, found {len(found)}")
    path = f"{root}/{name}.{found[0]}"
    return spark.read.parquet(path) if found[0] == "parquet" else spark.read.option("header", True).csv(path)


def with_week(df: DataFrame) -> DataFrame:
    """Adds ``week`` from the name of the file a row came from: ``week3``, ``week_03``, ``w3`` (SRC-2, SRC-4)."""
    return df.withColumn("week", F.regexp_extract(F.input_file_name(), r"w(?:eek)?[_-]?(\d{1,2})[^/]*$", 1).try_cast("int"))


def week_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Weeks on one side only, as ``week, side`` (SRC-5, SET-4)."""
    a, b = left.select("week").distinct(), right.select("week").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def only_games(df: DataFrame, games: DataFrame, game: str) -> DataFrame:
    """Rows of the games listed (SRC-7, JN-19, PRJ-11): a semi-join that prunes partitions where the table is
    partitioned by game."""
    return df.join(games.select(game).distinct(), game, "left_semi")


def game_table(df: DataFrame, game: str, columns: list[str], augmented: str = "_aug") -> DataFrame:
    """One record per game with ``n_records``, which is over 1 where its columns disagree; then the least record
    stands (SRC-11, DES-1). Games whose id ends in ``augmented`` are no games of their own and go."""
    own = df.where(~F.coalesce(F.col(game).cast("string").endswith(augmented), F.lit(False)))
    one = own.groupBy(game).agg(F.min(F.struct(*columns)).alias("__r"), F.countDistinct(F.struct(*columns)).alias("n_records"))
    return one.select(game, *[F.col(f"__r.{c}").alias(c) for c in columns], "n_records")


def labelled_arrays(labels: DataFrame, plays: DataFrame, play: str, game: str, season: str, augmented: str = "_aug") -> DataFrame:
    """Labels with their play's game and season (SRC-9): augmented rows go, and ``problem`` names labels whose play is
    ``unmatched`` or ``ambiguous`` (several games or seasons), which are then null."""
    own = labels.where(~F.coalesce(F.col(play).cast("string").endswith(augmented), F.lit(False)))
    known = plays.groupBy(F.col(play).cast("string").alias("__k")).agg(F.min(F.struct(game, season)).alias("__r"), F.countDistinct(F.struct(game, season)).alias("__n"))
    both = own.join(known, F.col(play).cast("string") == F.col("__k"), "left")
    problem = F.when(F.col("__n").isNull(), "unmatched").when(F.col("__n") > 1, "ambiguous")
    fine = lambda c: F.when(problem.isNull(), F.col(f"__r.{c}")).alias(c)
    return both.select(*own.columns, fine(game), fine(season), problem.alias("problem"))


def first_examples(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order of a unique key (PRJ-11, SRT-1, SRT-2)."""
    return df.orderBy(*order).limit(n)


def write_prepared(df: DataFrame, path: str, partition: list[str]) -> None:
    """A prepared table as Parquet by partition columns; existing partitions of other values stay (SNK-1 to SNK-3)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_products(products: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """An analysis's tables, one folder each (SNK-4)."""
    for name, df in products.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{path}/{name}") if form == "csv" else w.format(form).save(f"{path}/{name}")


def fingerprint(df: DataFrame) -> Column:
    """Aggregate over all columns that doesn't depend on row order (SRC-10)."""
    return F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))

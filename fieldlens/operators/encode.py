"""Transforms that learn from a cell's training rows only and apply to all of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.sources.steps import written


def standardize(df: DataFrame, by: list[str], train: Column, columns: list[str]) -> DataFrame:
    """Median imputation, then (x - mean) / population deviation of the training rows as ``z_<column>`` (ENC-1, ENC-3);
    deviations of 1e-8 or less count as 1. Training mean and deviation are those after imputation."""
    t = df.where(train)
    med = (t.groupBy(*by) if by else t).agg(*[F.percentile(c, F.lit(0.5)).alias(f"__m_{c}") for c in columns])
    glue = lambda a, b: a.join(b, by) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  without cells one row of statistics
    filled = glue(df, med).select("*", *[F.coalesce(F.col(c), F.col(f"__m_{c}")).cast("double").alias(f"__f_{c}") for c in columns])
    ft = filled.where(train)
    stats = (ft.groupBy(*by) if by else ft).agg(*[x for c in columns for x in (F.avg(f"__f_{c}").alias(f"__a_{c}"), F.stddev_pop(f"__f_{c}").alias(f"__s_{c}"))])
    out = glue(filled, stats)
    scale = lambda c: F.when(F.col(f"__s_{c}") > 1e-8, F.col(f"__s_{c}")).otherwise(1.0)
    z = [((F.col(f"__f_{c}") - F.col(f"__a_{c}")) / scale(c)).alias(f"z_{c}") for c in columns]
    return out.select(*df.columns, *z)


def most_frequent(df: DataFrame, by: list[str], train: Column, column: str) -> DataFrame:
    """A cell's most frequent training value, ties to the smallest (ENC-2)."""
    n = df.where(train & F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    best = (n.groupBy(*by) if by else n).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias("fill"))


def one_hot(df: DataFrame, key: str, train: Column, column: str) -> DataFrame:
    """Sparse indicators ``key, level, 1``: nulls become the most frequent training value, values unseen in training
    have no indicator (ENC-2)."""
    fill = most_frequent(df, [], train, column)
    known = df.where(train & F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    filled = df.crossJoin(F.broadcast(fill)).select(key, F.coalesce(F.col(column), F.col("fill")).alias("level"))  # one value
    return filled.join(known, "level", "left_semi").select(key, "level", F.lit(1).alias("indicator"))


def hashed_context(df: DataFrame, key: str, columns: list[str], buckets: int = 8) -> DataFrame:
    """``key, column, bucket`` of each categorical value (ENC-3, FN-15)."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), fn.hashed_bucket(c, F.col(c), buckets).alias("bucket")) for c in columns])
    return df.select(key, F.explode(parts).alias("x")).select(key, "x.column", "x.bucket")


def masked_scaler(tokens: DataFrame, by: list[str], train: Column, columns: list[str]) -> DataFrame:
    """Mean and population deviation of valid training tokens by cell; one pass (ENC-4, ENC-5)."""
    t = tokens.where(train)
    return (t.groupBy(*by) if by else t).agg(F.count("*").alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"))])


def raster_scaler(raster: DataFrame, by: list[str], train: Column, channels: list[str], frames: Column, grid: tuple[int, int]) -> DataFrame:
    """Mean and population deviation of each channel over the occupied cells of the training rasters (ENC-5), ``n`` of them, and ``fill``: their share of all
    cells of the training frames, told by ``frames`` (an aggregate). Rasters are sparse: empty cells are no rows."""
    moments = masked_scaler(raster, by, train, channels)
    t = raster.where(train)
    share = (t.groupBy(*by) if by else t).agg((F.count("*") / (frames * F.lit(grid[0] * grid[1]))).alias("fill"))
    return moments.join(share, by) if by else moments.crossJoin(F.broadcast(share))  # one row


def scaled_raster(raster: DataFrame, scaler: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Occupied cells with scaled channels ``z_<channel>``; deviations of 1e-8 or less count as 1. Empty cells stay 0, which is no row (ENC-5).
    The scaler is written first, so that its size is known: few cells of ``by`` are sent to the raster, which isn't dealt out by them."""
    both = raster.join(written(scaler), by) if by else raster.crossJoin(F.broadcast(scaler))  # one row
    scale = lambda c: F.when(F.col(f"{c}_sd") > 1e-8, F.col(f"{c}_sd")).otherwise(1.0)
    return both.select(*raster.columns, *[((F.col(c) - F.col(f"{c}_mean")) / scale(c)).alias(f"z_{c}") for c in channels])


def threshold_rows(df: DataFrame, key: str, cdf: str, classes: int, carried: list[str] = ()) -> DataFrame:
    """Each row once for every threshold k < K - 1 with t = k / (K - 1), its root and square, and the baseline cdf there
    (ENC-8), and the ``carried`` columns."""
    k = df.select(key, cdf, *carried, F.explode(F.sequence(F.lit(0), F.lit(classes - 2))).alias("k"))
    t = F.col("k") / F.lit(float(classes - 1))
    return k.select(key, "k", t.alias("t"), F.sqrt(t).alias("root"), (t * t).alias("square"), F.get(cdf, F.col("k")).alias("base"), *carried)


def horizon_rows(df: DataFrame, key: str, length: str, most: int, carried: list[str] = ()) -> DataFrame:
    """Each row once for every observed horizon h <= length with h / most, its root and square (ENC-9), and the ``carried`` columns."""
    h = df.select(key, *carried, F.explode(F.sequence(F.lit(1), F.least(F.col(length), F.lit(most)).cast("int"))).alias("h"))
    t = F.col("h") / F.lit(float(most))
    return h.select(key, "h", t.alias("t"), F.sqrt(t).alias("root"), (t * t).alias("square"), *carried)


def ridge_moments(df: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    """X'X and X'y of each cell in one aggregation, intercept first: the whole data a ridge fit needs (ML-2)."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    p = range(len(terms))
    xtx = F.array(*[F.sum(terms[i] * terms[j]) for i in p for j in p])
    return (df.groupBy(*by) if by else df).agg(F.count("*").alias("n"), xtx.alias("xtx"), F.array(*[F.sum(t * F.col(y)) for t in terms]).alias("xty"))


def ridge_fit(moments: DataFrame, by: list[str], size: int, penalty: float) -> DataFrame:
    """Coefficients ``by, beta`` from the moments; the intercept isn't penalised. Cells are solved in parallel (ML-2)."""
    import numpy as np
    import pandas as pd

    def solve(batches):
        eye = np.eye(size)
        eye[0, 0] = 0
        for pdf in batches:
            beta = [np.linalg.solve(np.array(a).reshape(size, size) + penalty * eye, np.array(b)).tolist() for a, b in zip(pdf.xtx, pdf.xty, strict=True)]
            yield pd.concat([pdf[by], pd.Series(beta, name="beta", index=pdf.index)], axis=1)

    kinds = dict(moments.dtypes)
    return moments.mapInPandas(solve, ", ".join([*[f"{c} {kinds[c]}" for c in by], "beta array<double>"]))


def linear_score(df: DataFrame, beta: DataFrame, by: list[str], x: list[str]) -> DataFrame:
    """Adds ``prediction`` from a cell's coefficients (ML-9). The coefficients are written first, so that their size is known: they are sent to the
    rows, which aren't dealt out by cell."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    value = reduce(lambda a, b: a + b, [F.lit(0.0), *[t * F.get("beta", F.lit(i)) for i, t in enumerate(terms)]])
    return df.join(written(beta), by).withColumn("prediction", value).drop("beta")

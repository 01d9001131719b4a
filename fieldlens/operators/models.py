"""One logistic fit, choices by held-out losses, constant fallbacks. Fits over many cells are in fits.py and trees.py."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn


def assembled(df: DataFrame, x: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=x, outputCol="features", handleInvalid="keep").transform(df)


def logistic(train: DataFrame, x: list[str], y: str, penalty: float = 1e-3):
    """L2 logistic model (ML-1); with one label only, the constant (sum y + 0.5) / (n + 1) (ML-4)."""
    n, total, kinds = train.agg(F.count("*"), F.sum(y), F.countDistinct(y)).first()
    if kinds < 2:
        return ((total or 0) + 0.5) / (n + 1)
    return LogisticRegression(featuresCol="features", labelCol=y, regParam=penalty, elasticNetParam=0.0).fit(assembled(train, x))


def probability(model, df: DataFrame, x: list[str], name: str = "p") -> DataFrame:
    """Adds the probability of label 1 (ML-9); one transform over all rows."""
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model))
    return model.transform(assembled(df, x)).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def choose(losses: DataFrame, folds: int, by: list[str] | None = None) -> DataFrame:
    """From ``candidate, fold, loss``: mean and deviation over folds, and which candidate is least (of each cell), ties to the lowest
    index; candidates without all folds don't count (SRT-7, ML-6)."""
    by = by or []
    per = losses.groupBy(*by, "candidate").agg(F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("sd"), F.count("*").alias("n")).where(F.col("n") == folds)
    if by:
        least = per.groupBy(*by).agg(F.min(F.struct("mean", "candidate")).alias("b")).select(*by, F.col("b.candidate").alias("best"))
        return per.join(least, by).withColumn("chosen", F.col("candidate") == F.col("best")).drop("best", "n")
    best = per.agg(F.min(F.struct("mean", "candidate")).alias("b")).select(F.col("b.candidate").alias("best"))
    return per.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("candidate") == F.col("best")).drop("best", "n")  # one row


def choose_target(losses: DataFrame) -> DataFrame:
    """From ``target, family, candidate, loss``: the best candidate of every family within a target, the equal-weight mean
    over families, and the least target, exact ties to the first (ML-7)."""
    best = losses.groupBy("target", "family").agg(F.min(F.struct("loss", "candidate")).alias("b"))
    score = best.groupBy("target").agg(F.avg("b.loss").alias("score"))
    return score.agg(F.min(F.struct("score", "target")).alias("m")).select(F.col("m.target").alias("target"), F.col("m.score").alias("score"))


def frozen_first(scores: DataFrame, keys: list[str], frozen: Column) -> DataFrame:
    """The frozen candidate, unless another has a strictly lower loss; ties among others to the lowest index (ML-8)."""
    order = F.struct("loss", F.when(frozen, 0).otherwise(1).alias("late"), "candidate")
    return scores.groupBy(*keys).agg(F.min(order).alias("b")).select(*keys, F.col("b.candidate").alias("candidate"), F.col("b.loss").alias("loss"))


def residual_pmf(residual: Column, baseline: Column) -> Column:
    """Baseline cdf plus residual, clipped to [0, 1], made monotone (adjacent violators pooled), as probabilities that sum
    to one (ML-5, CAL-11)."""
    raw = F.zip_with(baseline, residual, lambda b, r: F.least(F.greatest(b + r, F.lit(0.0)), F.lit(1.0)))
    n = F.size(raw)
    fit = fn.pooled(F.transform(raw, lambda v: F.struct(F.lit(1.0).alias("w"), v.alias("wy"))))
    ended = F.transform(fit, lambda c, i: F.when(i == n - 1, F.lit(1.0)).otherwise(c))
    return fn.let(ended, lambda e: F.zip_with(e, F.concat(F.array(F.lit(0.0)), F.slice(e, 1, F.size(e) - 1)), lambda c, before: c - before))

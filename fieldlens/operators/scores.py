"""Proper scores and diagnostics of predictions: contributions by row, then means by row or by game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn


def brier(p: Column, y: Column) -> Column:
    """(p - y)^2 (MET-1)."""
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column) -> Column:
    """Binary log loss with probabilities clipped at 1e-12 (MET-2)."""
    q = fn.clipped(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def crps(pmf: Column, y: Column) -> Column:
    """Mean over the K classes of (cdf - 1{k >= y})^2, y an index (MET-3)."""
    return crps_sum(pmf, y) / F.size(pmf)


def crps_sum(pmf: Column, y: Column) -> Column:
    """The sum of the squares; the older scale divides it by 199 (MET-4)."""
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0).alias("k"), F.lit(0.0).alias("loss"))

    def step(a: Column, p: Column) -> Column:
        gap = a["cdf"] + p - (a["k"] >= y).cast("double")
        return F.struct((a["cdf"] + p).alias("cdf"), (a["k"] + 1).alias("k"), (a["loss"] + gap * gap).alias("loss"))

    return F.when(y.isNotNull(), F.aggregate(pmf, start, step, lambda a: a["loss"]))


def game_equal(df: DataFrame, by: list[str], game: str, values: dict[str, Column]) -> DataFrame:
    """Mean of per-game means (AGG-9); a null value leaves its row out of that mean (AGG-10)."""
    per = df.groupBy(*by, game).agg(*[F.avg(c).alias(n) for n, c in values.items()])
    return (per.groupBy(*by) if by else per).agg(*[F.avg(n).alias(n) for n in values])


def game_equal_quantile(df: DataFrame, by: list[str], game: str, value: Column, q: float) -> DataFrame:
    """Mean of per-game linear quantiles (AGG-11)."""
    per = df.groupBy(*by, game).agg(F.percentile(value, F.lit(q)).alias("q"))
    return (per.groupBy(*by) if by else per).agg(F.avg("q").alias("quantile"))


def path_errors(pairs: DataFrame, example: str, dx: Column, dy: Column) -> DataFrame:
    """Per path: squared coordinate errors, points, and their mean per coordinate (MET-5)."""
    a = pairs.groupBy(example).agg(F.sum(dx * dx + dy * dy).alias("sse"), F.count("*").alias("n_points"))
    return a.withColumn("mse", F.col("sse") / (2 * F.col("n_points")))


def pooled_rmse(errors: DataFrame, by: list[str]) -> DataFrame:
    """Root of pooled squared coordinate errors by group: all paths, a game or a horizon (MET-6)."""
    return (errors.groupBy(*by) if by else errors).agg(F.sqrt(F.sum("sse") / (2 * F.sum("n_points"))).alias("rmse"))


def reliability(calibration: DataFrame, test: DataFrame, by: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """RMS reliability: bins between the distinct interior quantiles of calibration probabilities, searched from the
    right; the root of the n-weighted mean squared gap between mean outcome and mean probability (MET-8)."""
    qs = [i / bins for i in range(1, bins)]
    cuts = (calibration.groupBy(*by) if by else calibration).agg(F.array_distinct(F.percentile(p, F.array(*[F.lit(q) for q in qs]))).alias("cuts"))
    both = test.join(cuts, by) if by else test.crossJoin(F.broadcast(cuts))  # one row of nine numbers
    binned = both.withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col(p))))
    per = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), (F.avg(y) - F.avg(p)).alias("gap"))
    return (per.groupBy(*by) if by else per).agg(F.sqrt(F.sum(F.col("n") * F.col("gap") * F.col("gap")) / F.sum("n")).alias("reliability"), F.count("*").alias("n_bins"))


def binary_row(df: DataFrame, by: list[str], game: str, p: str, y: str, null_p: str) -> DataFrame:
    """Play- and game-equal binary metrics of each cell (MET-7, MET-9 to MET-11)."""
    pc, yc, nc = F.col(p), F.col(y), F.col(null_p)
    values = {"brier": brier(pc, yc), "log_loss": log_loss(pc, yc), "null_brier": brier(nc, yc), "bias": yc - pc, "entropy": fn.bernoulli_entropy(pc)}
    play = (df.groupBy(*by) if by else df).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"play_{n}") for n, c in values.items()])
    game_ = game_equal(df, by, game, {f"game_{n}": c for n, c in values.items()})
    out = play.join(game_, by) if by else play.crossJoin(F.broadcast(game_))  # one row each
    return out.withColumn("play_skill", fn.skill(F.col("play_brier"), F.col("play_null_brier"))).withColumn("game_skill", fn.skill(F.col("game_brier"), F.col("game_null_brier")))


def empirical_null(train: DataFrame, by: list[str], y: str, classes: int, smoothing: float = 0.0) -> DataFrame:
    """Training labels' class shares over the whole support: ``k, p, cdf`` (ENC-6)."""
    from pyspark.sql import Window

    counts = train.groupBy(*by, F.col(y).alias("k")).agg(F.count("*").alias("n"))
    support = (train.select(*by).distinct() if by else train.limit(1).select()).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    full = support.join(counts, [*by, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + smoothing)
    whole, run = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("k")
    return full.select(*by, "k", (F.col("n") / F.sum("n").over(whole)).alias("p"), (F.sum("n").over(run) / F.sum("n").over(whole)).alias("cdf"))


def prevalence(train: DataFrame, by: list[str], y: str) -> DataFrame:
    """(sum y + 0.5) / (n + 1) by cell (ENC-7, ML-4)."""
    return (train.groupBy(*by) if by else train).agg(((F.sum(y) + 0.5) / (F.count("*") + 1)).alias("prevalence"))

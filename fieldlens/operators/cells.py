"""Evaluation of cells: the complete metric row of every group of predictions, all cells in one job.

Predictions are one fact table; ``by`` names the columns of a cell, ``part`` holds train, calibration or test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import conformal, scores
from fieldlens.sources.steps import released, written

#: Probabilities are kept this far from 0 and 1 before they are calibrated.
EDGE = 1e-6


def weighted_both(rows: DataFrame, by: list[str], game: str, values: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """Means of columns over rows and over games (mean of the games' means, AGG-9, AGG-10): ``values`` maps a key to
    (name by row, name by game, column), an empty name leaving that mean out. Null values leave their row out."""
    per = rows.groupBy(*by, game).agg(*[x for k, (_, _, c) in values.items() for x in (F.avg(c).alias(f"m_{k}"), F.sum(c).alias(f"s_{k}"), F.count(c).alias(f"n_{k}"))])
    out = []
    for k, (row_name, game_name, _) in values.items():
        out += [(F.sum(f"s_{k}") / F.sum(f"n_{k}")).alias(row_name)] if row_name else []
        out += [F.avg(f"m_{k}").alias(game_name)] if game_name else []
    return per.groupBy(*by).agg(*out)


def set_rates(size: str, in0: str, in1: str, y: str) -> dict[str, tuple[str, str, Column]]:
    """Coverage of each label and the shares of set sizes, as weighted_both() takes them (MET-10)."""
    share = lambda n: (F.col(size) == n).cast("double")
    cover = lambda label, c: F.when(F.col(y) == label, F.col(c).cast("double"))
    out = {"c0": ("label0_set_coverage", cover(0, in0)), "c1": ("label1_set_coverage", cover(1, in1))}
    out |= {f"z{n}": (f"set_{name}_rate", share(n)) for n, name in ((0, "empty"), (1, "singleton"), (2, "doubleton"))}
    return {k: (name, f"game_equal_{name}", c) for k, (name, c) in out.items()}


def reliability(calibration: DataFrame, test: DataFrame, by: list[str], game: str, p: str, y: str, bins: int = 10) -> DataFrame:
    """RMS reliability over bins that the calibration probabilities' distinct interior quantiles bound, over all rows and as
    the mean of the games' own: ``rms_reliability, game_equal_rms_reliability`` (MET-8)."""
    cuts = calibration.groupBy(*by).agg(F.array_distinct(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).alias("__cuts"))
    binned = test.join(cuts, by).withColumn("__bin", F.size(F.filter("__cuts", lambda c: c <= F.col(p))))
    gaps = binned.groupBy(*by, game, "__bin").agg(F.count("*").alias("n"), F.sum(F.col(y) - F.col(p)).alias("d"))
    rms = lambda n, d: F.sqrt(F.sum(F.col(d) * F.col(d) / F.col(n)) / F.sum(n))
    whole = gaps.groupBy(*by, "__bin").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).groupBy(*by).agg(rms("n", "d").alias("rms_reliability"))
    games = gaps.groupBy(*by, game).agg(rms("n", "d").alias("r")).groupBy(*by).agg(F.avg("r").alias("game_equal_rms_reliability"))
    return whole.join(games, by)


def binary_metrics(
    predictions: DataFrame, by: list[str], game: str, row: str, part: str, p: str, y: str, seed: int, alpha: float = 0.1, precision: int | None = None, bins: int = 10
) -> DataFrame:
    """The complete row of binary metrics of every cell (MET-7 to MET-11): Brier and log loss raw and calibrated by
    Venn-Abers, their null, bias, reliability, entropy, imprecision, coverage and sizes of label-conditional sets, each over rows
    and over games. Sets come from raw probabilities, bins from calibrated ones of calibration rows. A cell without
    training, calibration or test rows gives no row. Every metric reads the predictions and their fits, so both are written first, and
    deleted when the rows of metrics are."""
    pred = written(predictions.withColumn(p, F.least(F.greatest(F.col(p), F.lit(EDGE)), F.lit(1 - EDGE))))
    at = lambda name: pred.where(F.col(part) == name)
    fitted = written(conformal.venn_abers(at("calibration"), at("calibration").unionByName(at("test")), by, p, y, precision))
    is_test = F.col(part) == "test"
    sets = conformal.label_sets(at("calibration"), fitted.where(is_test), by, game, row, p, y, alpha, seed)
    test = sets.join(scores.prevalence(at("train"), by, y).withColumnRenamed("prevalence", "null_probability"), by)
    raw, fit, label = F.col(p), F.col("point"), F.col(y)
    values = {
        "raw": ("raw_brier", "game_equal_brier", scores.brier(raw, label)),
        "null": ("null_loss", "", scores.brier(F.col("null_probability"), label)),
        "fit": ("calibrated_brier", "game_equal_calibrated_brier", scores.brier(fit, label)),
        "rawlog": ("raw_log_loss", "game_equal_raw_log_loss", scores.log_loss(raw, label)),
        "fitlog": ("calibrated_log_loss", "game_equal_calibrated_log_loss", scores.log_loss(fit, label)),
        "bias": ("calibration_bias", "game_equal_calibration_bias", label - fit),
        "ent": ("mean_entropy", "game_equal_mean_entropy", fn.bernoulli_entropy(fit)),
        "imp": ("mean_va_imprecision", "game_equal_mean_va_imprecision", F.col("imprecision")),
        **set_rates("set_size", "in0", "in1", y),
    }
    out = weighted_both(test, by, game, values)
    p90 = test.groupBy(*by).agg(F.percentile("imprecision", F.lit(0.9)).alias("p90_va_imprecision"), F.max("null_probability").alias("null_probability"))
    game90 = scores.game_equal_quantile(test, by, game, F.col("imprecision"), 0.9).withColumnRenamed("quantile", "game_equal_p90_va_imprecision")
    bins_ = reliability(fitted.where(~is_test), test, by, game, "point", y, bins)
    out = out.join(p90, by).join(game90, by).join(bins_, by)
    out = written(out.withColumns({"primary_loss": F.col("raw_brier"), "game_equal_loss": F.col("game_equal_brier"), "skill": fn.skill(F.col("raw_brier"), F.col("null_loss"))}))
    released(pred, fitted)
    return out


def distribution_metrics(predictions: DataFrame, by: list[str], game: str, row: str, part: str, pmf: str, y: str, classes: int, seed: int, alpha: float = 0.1) -> DataFrame:
    """The complete row of metrics of predicted distributions (MET-12): CRPS and that of the training labels' empirical
    distribution, coverage and width of game-clustered intervals, over rows and over games. ``y`` is a class index."""
    lo, hi = conformal.central_interval(F.col(pmf), alpha)
    at = lambda name: predictions.where(F.col(part) == name)
    shares = scores.empirical_null(at("train"), by, y, classes).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("__null"))
    banded = lambda name: at(name).withColumn("__lo", lo).withColumn("__hi", hi)
    test = conformal.clustered_intervals(banded("calibration"), banded("test"), by, game, row, "__lo", "__hi", y, classes, alpha, seed).join(shares, by)
    values = {
        "crps": ("crps", "game_equal_crps", scores.crps(F.col(pmf), F.col(y))),
        "null": ("null_loss", "", scores.crps(F.col("__null"), F.col(y))),
        "hit": ("coverage_example_weighted", "coverage", F.col("hit").cast("double")),
        "width": ("interval_width_example_weighted", "interval_width", F.col("width").cast("double")),
        "count": ("inclusive_class_count", "", F.col("width") + 1.0),
    }
    spread = test.groupBy(*by).agg(F.coalesce(F.stddev_samp("width"), F.lit(0.0)).alias("interval_width_sd"))
    out = weighted_both(test, by, game, values).join(spread, by)
    return out.withColumns({"primary_loss": F.col("crps"), "game_equal_loss": F.col("game_equal_crps"), "skill": fn.skill(F.col("crps"), F.col("null_loss"))})


def absolute_paths(points: DataFrame, base: tuple[str, str] = ("base_x", "base_y"), residual: tuple[str, str] = ("res_x", "res_y")) -> DataFrame:
    """Adds ``pred_x, pred_y``: baseline plus predicted residual (MET-15)."""
    return points.withColumns({f"pred_{a}": F.col(b) + F.col(r) for a, b, r in zip("xy", base, residual, strict=True)})


def horizon_rmse(points: DataFrame, by: list[str], horizon: str) -> DataFrame:
    """Root mean squared coordinate error by horizon (MET-6)."""
    e = (F.col("pred_x") - F.col("x")) ** 2 + (F.col("pred_y") - F.col("y")) ** 2
    return points.groupBy(*by, horizon).agg(F.sqrt(F.sum(e) / (2 * F.count("*"))).alias("rmse"))


def trajectory_metrics(points: DataFrame, scale: DataFrame, by: list[str], example: str, game: str, horizon: str, part: str, seed: int, alpha: float = 0.1) -> DataFrame:
    """The complete row of metrics of predicted paths (MET-13): pooled, path- and game-equal RMSE, that of the baseline,
    and coverage and diameter of a whole-path tube. ``points``: x, y, base_x, base_y, pred_x, pred_y by example and horizon;
    ``scale``: (horizon, scale)."""
    squares = lambda a, b: (F.col(a) - F.col("x")) ** 2 + (F.col(b) - F.col("y")) ** 2
    errors = points.withColumns({"__e": squares("pred_x", "pred_y"), "__b": squares("base_x", "base_y")}).withColumn("__r", F.sqrt("__e"))
    test = errors.where(F.col(part) == "test")
    paths = test.groupBy(*by, game, example).agg(F.sum("__e").alias("e"), F.sum("__b").alias("b"), F.count("*").alias("n"))
    rmse = lambda s: F.sqrt(F.sum(s) / (2 * F.sum("n")))
    games = paths.groupBy(*by, game).agg(rmse("e").alias("g")).groupBy(*by).agg(F.avg("g").alias("game_equal_rmse"))
    whole = paths.groupBy(*by).agg(rmse("e").alias("rmse"), rmse("b").alias("null_loss"), F.avg(F.sqrt(F.col("e") / (2 * F.col("n")))).alias("path_equal_rmse"))
    tube = conformal.path_tube(errors.where(F.col(part) == "calibration"), test, scale, example, game, horizon, "__r", alpha, seed, by)
    tubes = weighted_both(tube, by, game, {
        "c": ("path_coverage", "game_equal_path_coverage", F.col("covered").cast("double")), "d": ("mean_tube_diameter", "game_equal_tube_diameter", F.col("diameter")),
    })
    out = whole.join(games, by).join(tubes, by)
    return out.withColumns({"primary_loss": F.col("rmse"), "game_equal_loss": F.col("game_equal_rmse"), "skill": fn.skill(F.col("rmse"), F.col("null_loss"))})


def local_interval_metrics(predictions: DataFrame, by: list[str], game: str, part: str, pmf: str, y: str, alpha: float, k: int, divisor: float = 199.0) -> DataFrame:
    """Metrics of distributions with locally padded intervals (MET-14): CRPS on the older scale, coverage, width with and without
    both ends, padding, over rows and over games. Probabilities are floored and renormalised first."""
    pred = predictions.withColumn(pmf, fn.renormalized(F.col(pmf), 1e-12))
    classes = F.size(pmf)
    lo, hi = conformal.central_interval(F.col(pmf), alpha)
    pred = pred.withColumns({"__lo": lo, "__hi": hi, "__m": fn.pmf_mean(F.col(pmf)), "__s": fn.pmf_sd(F.col(pmf)), "__h": fn.pmf_entropy(F.col(pmf))})
    pred = pred.withColumn("__score", conformal.interval_score(F.col("__lo"), F.col("__hi"), F.col(y)))
    at = lambda name: pred.where(F.col(part) == name)
    test = conformal.local_padding(at("calibration"), at("test"), by, ["__m", "__s", "__h"], "__score", alpha, k)
    low, high = F.greatest(F.lit(0.0), F.col("__lo") - F.col("padding")), F.least(classes - F.lit(1.0), F.col("__hi") + F.col("padding"))
    test = test.withColumns({"lower": low, "upper": high}).withColumn("width", F.col("upper") - F.col("lower"))
    values = {
        "crps": ("crps", "crps_game_equal", scores.crps_sum(F.col(pmf), F.col(y)) / divisor),
        "hit": ("coverage", "coverage_game_equal", F.col(y).between(F.col("lower"), F.col("upper")).cast("double")),
        "width": ("mean_width", "mean_width_game_equal", F.col("width")),
        "both": ("mean_width_inclusive", "mean_width_inclusive_game_equal", F.col("width") + 1),
        "q": ("mean_q", "", F.col("padding").cast("double")),
    }
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    spread = test.groupBy(*by).agg(sd("width").alias("std_width"), sd("padding").alias("std_q"), F.count("*").alias("n_test"), F.countDistinct(game).alias("n_test_games"))
    counts = at("calibration").groupBy(*by).agg(F.count("*").alias("n_calibration"))
    return weighted_both(test, by, game, values).join(spread, by).join(counts, by)


def replayed(recorded: DataFrame, again: DataFrame, by: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Recorded metrics beside recomputed ones (SET-7): ``by, metric, recorded, again, problem`` for cells that differ by over the
    tolerance or are on one side only."""
    from fieldlens.operators.panel import melt

    a = melt(recorded, by, metrics).withColumnRenamed("value", "recorded").withColumn("__a", F.lit(True))
    b = melt(again, by, metrics).withColumnRenamed("value", "again").withColumn("__b", F.lit(True))
    both = a.join(b, [*by, "metric"], "full_outer")
    away = ~F.col("recorded").eqNullSafe(F.col("again")) & F.coalesce(F.abs(F.col("recorded") - F.col("again")) > tolerance, F.lit(True))
    problem = F.when(F.col("__a").isNull(), "unrecorded").when(F.col("__b").isNull(), "not_recomputed").when(away, "deviates")
    return both.select(*by, "metric", "recorded", "again", problem.alias("problem")).where("problem is not null")


def registry_check(expected: DataFrame, got: DataFrame, by: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """Saved predictions against what a split asks for, by cell (SET-9): rows expected, present, missing, unasked, repeated, and rows
    whose ``values`` (part, target, stratum) differ."""
    on = [*by, *keys]
    one = got.groupBy(*on).agg(F.min(F.struct(*values)).alias("__g"), F.count("*").alias("__n"))
    both = expected.select(*on, F.struct(*values).alias("__e")).join(one, on, "full_outer")
    there = F.col("__e").isNotNull() & F.col("__g").isNotNull()
    return both.groupBy(*by).agg(
        F.count("__e").alias("expected"), F.count_if(there).alias("present"), F.count_if(F.col("__g").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("unasked"),
        F.count_if(F.col("__n") > 1).alias("repeated"), F.count_if(there & (F.col("__e") != F.col("__g"))).alias("misplaced"),
    )


def null_losses(rows: DataFrame, anchors: DataFrame, test: DataFrame, game: str, y: str) -> DataFrame:
    """Train-only null loss of every cell (JN-14, PIPE-16): the prevalence of the games within each anchor (``repeat, n_train, game``), scored
    over games on the repeat's test games (``repeat, game``)."""
    null = scores.prevalence(rows.join(anchors.select("repeat", "n_train", game), game), ["repeat", "n_train"], y)
    asked = rows.join(test.select("repeat", game), game).join(null, "repeat")
    return scores.game_equal(asked, ["repeat", "n_train"], game, {"null_loss": scores.brier(F.col("prevalence"), F.col(y))})


def evaluate_cells(predictions: DataFrame, splits: DataFrame, by: list[str], example: str, game: str, kind: str, **roles) -> DataFrame:
    """All cells in one job (PIPE-10): predictions (by, example, game, ...) meet their repeat's split (``repeat, game, role,
    train_order``); training rows are those within the cell's ``n_train``, and the metric row of ``kind`` (binary, distribution or
    local) follows. ``by`` holds repeat and n_train."""
    s = splits.where("role is not null").select("repeat", game, F.col("role").alias("part"), F.col("train_order").alias("__order"))
    rows = predictions.join(s, ["repeat", game]).where((F.col("part") != "train") | (F.col("__order") <= F.col("n_train"))).drop("__order")
    if kind == "binary":
        return binary_metrics(rows, by, game, example, "part", **roles)
    if kind == "distribution":
        return distribution_metrics(rows, by, game, example, "part", **roles)
    return local_interval_metrics(rows, by, game, "part", **roles)

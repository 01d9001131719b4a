"""Repeat-block bootstrap inference and gated decisions over a panel of reruns.

The draws are a hash-based registry that every estimand shares. Estimands are reduced first: one array of
n repeats each, some hundreds in all; draws (many) are distributed and meet that reduced table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn

EPS = math.sqrt(2.220446049250313e-16)
#: Estimands up to which their table is broadcast to the draws.
BROADCAST_ROWS = 20_000


def draws(spark: SparkSession, n: int, count: int, seed: int) -> DataFrame:
    """``draw, idx``: for every draw n positions (0-based) with replacement, from a hash of seed, draw and place (INF-1)."""
    base = spark.range(1, count + 1, numPartitions=max(1, min(64, count // 64))).select(F.col("id").cast("int").alias("draw"))
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return base.withColumn("idx", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (number(i) % n).cast("int")))


def estimands(long: DataFrame, ids: list[str], value: str, order: str = "repeat") -> DataFrame:
    """One array of values in repeat order for each estimand, with its size, mean and deviation."""
    arrays = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    e = long.groupBy(*ids).agg(arrays.alias("values"))
    return e.select(*ids, "values", F.size("values").alias("n"), _mean("values").alias("mean"), _sd("values").alias("sd"))


def _mean(v: str | Column) -> Column:
    return fn.moments(F.col(v) if isinstance(v, str) else v)["mean"]


def _sd(v: str | Column) -> Column:
    return _deviation(fn.moments(F.col(v) if isinstance(v, str) else v))


def _deviation(m: Column) -> Column:
    return F.sqrt(m["m2"] / (m["n"] - 1))


def floored_se(mean: Column, sd: Column, n: Column) -> Column:
    """Standard error, at least sqrt(eps) times the larger of |mean| and 1."""
    return F.greatest(sd / F.sqrt(n), EPS * F.greatest(F.abs(mean), F.lit(1.0)), F.lit(1e-15))


def _with_draws(e: DataFrame, registry: DataFrame) -> DataFrame:
    rows = e.count()
    return registry.crossJoin(F.broadcast(e)) if rows <= BROADCAST_ROWS else e.crossJoin(registry)  # reduced estimands, never raw rows


def critical(e: DataFrame, registry: DataFrame, ids: list[str], level: float, two_sided: bool, least: float) -> DataFrame:
    """One row ``critical``: the sorted[ceil(q (B - 1))] quantile of each draw's largest studentized deviation over
    all estimands, and never below ``least``."""
    b = _with_draws(e.select(*ids, "values", "mean"), registry)
    b = b.withColumn("s", drawn("values"))
    t = (F.col("s.mean") - F.col("mean")) / floored_se(F.col("s.mean"), _deviation(F.col("s")), F.col("s.n"))
    top = b.groupBy("draw").agg(F.max(F.abs(t) if two_sided else t).alias("t"))
    w = Window.orderBy("t")  # one number for each draw
    placed = top.select("t", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy()).alias("k"))
    at = F.ceil(F.lit(level) * (F.col("k") - 1) - 1e-9) + 1
    return placed.where(F.col("r") == at).select(F.greatest(F.col("t"), F.lit(least)).alias("critical"))


def max_t_intervals(differences: DataFrame, ids: list[str], repeats: int, draws_count: int, seed: int, level: float = 0.95, registry: DataFrame | None = None) -> DataFrame:
    """Two-sided simultaneous intervals of mean paired differences: ``mean, se, critical, lower, upper`` (INF-2, with
    INF-4 as ``t_lower, t_upper``). ``registry``: draws() that were written once for several families."""
    e = estimands(differences, ids, "difference")
    least = fn.t_critical(level, repeats - 1)
    crit = critical(e, draws(differences.sparkSession, repeats, draws_count, seed) if registry is None else registry, ids, level, True, least)
    out = e.withColumn("se", floored_se(F.col("mean"), F.col("sd"), F.col("n"))).crossJoin(F.broadcast(crit))  # one number
    return out.select(
        *ids, "mean", "se", "critical", (F.col("mean") - F.col("critical") * F.col("se")).alias("lower"), (F.col("mean") + F.col("critical") * F.col("se")).alias("upper"),
        (F.col("mean") - least * F.col("se")).alias("t_lower"), (F.col("mean") + least * F.col("se")).alias("t_upper"),
    )


def lower_bounds(panel: DataFrame, metric: str, ids: list[str], repeats: int, draws_count: int, seed: int, target: float, level: float = 0.95, registry: DataFrame | None = None) -> DataFrame:
    """One-sided simultaneous lower bounds of a metric's mean, at least 0, and whether they reach a target (INF-3)."""
    e = estimands(panel, ids, metric)
    least = fn.t_critical(level, repeats - 1, two_sided=False)
    crit = critical(e, draws(panel.sparkSession, repeats, draws_count, seed) if registry is None else registry, ids, level, False, least)
    out = e.withColumn("se", floored_se(F.col("mean"), F.col("sd"), F.col("n"))).crossJoin(F.broadcast(crit))  # one number
    lower = F.greatest(F.lit(0.0), F.col("mean") - F.col("critical") * F.col("se"))
    return out.select(*ids, "mean", "se", "critical", lower.alias("lower")).withColumn("reaches", F.col("lower") >= target)


def jackknife_sd(values: Column) -> Column:
    """Leave-one-out standard deviations from the mean and the sum of squares about it (INF-7)."""
    less = lambda m: F.transform(values, lambda x: F.sqrt(F.greatest(F.lit(0.0), m["m2"] - (x - m["mean"]) ** 2 * m["n"] / (m["n"] - 1)) / (m["n"] - 2)))
    return fn.let(fn.moments(values), less)


def _bca(boot: DataFrame, ids: list[str], draws_count: int, level: float) -> DataFrame:
    """``observed, lower, upper`` from ``observed``, ``boot`` (sorted) and ``jack`` arrays: strict-less share clipped to half a
    draw, zero acceleration where its denominator vanishes, linear quantiles, the pair in order."""
    share = F.size(F.filter("boot", lambda x: x < F.col("observed"))) / F.lit(float(draws_count))
    share = F.least(F.greatest(share, F.lit(0.5 / draws_count)), F.lit(1 - 0.5 / draws_count))
    boot = boot.withColumn("z0", fn.normal_quantiles(share))
    boot = boot.withColumn("jm", _mean("jack"))
    m = F.col("jm")
    d2, d3 = fn.total(F.transform("jack", lambda x: (m - x) * (m - x))), fn.total(F.transform("jack", lambda x: (m - x) * (m - x) * (m - x)))
    down = 6 * F.pow(d2, F.lit(1.5))
    boot = boot.withColumn("a", F.when(down > 2.220446049250313e-16, d3 / down).otherwise(0.0))
    for name, z in (("lo", fn.normal_quantile((1 - level) / 2)), ("hi", fn.normal_quantile(1 - (1 - level) / 2))):
        boot = boot.withColumn(f"p_{name}", fn.normal_cdf(F.col("z0") + (F.col("z0") + z) / (1 - F.col("a") * (F.col("z0") + z))))

    def linear(p: str) -> Column:
        at = F.col(p) * (F.size("boot") - 1)
        low = F.floor(at).cast("int")
        high = F.least(low + 1, F.size("boot") - 1)
        return F.get("boot", low) + (at - low) * (F.get("boot", high) - F.get("boot", low))

    out = boot.select(*ids, "observed", linear("p_lo").alias("x"), linear("p_hi").alias("y"))
    return out.select(*ids, "observed", F.least("x", "y").alias("lower"), F.greatest("x", "y").alias("upper"))


def drawn(values: str) -> Column:
    """Moments of the values that a draw takes, without an array of them."""
    return fn.moments(F.col("idx"), lambda i: F.get(values, i))


def bca_sd(panel: DataFrame, metric: str, ids: list[str], repeats: int, draws_count: int, seed: int, level: float = 0.95, registry: DataFrame | None = None) -> DataFrame:
    """BCa intervals of the standard deviation over repeats (INF-5): ``sd, lower, upper``."""
    e = estimands(panel, ids, metric)
    b = _with_draws(e.select(*ids, "values", "sd"), draws(panel.sparkSession, repeats, draws_count, seed) if registry is None else registry)
    boot = b.groupBy(*ids).agg(F.array_sort(F.collect_list(_deviation(drawn("values")))).alias("boot"), F.first("sd").alias("observed"), F.first("values").alias("values"))
    return _bca(boot.withColumn("jack", jackknife_sd(F.col("values"))), ids, draws_count, level).withColumnRenamed("observed", "sd")


def bca_log_ratio(panel: DataFrame, metric: str, by: list[str], repeats: int, draws_count: int, seed: int, level: float = 0.95, floor: float = 1e-12) -> DataFrame:
    """BCa intervals of the ratio of two models' deviations, on the log scale with floored deviations (INF-6):
    ``left, right, ratio, lower, upper, zero_draws`` (draws in which a deviation is at the floor), left < right. Both models use the same draws."""
    e = estimands(panel, [*by, "model"], metric).select(*by, "model", "values", "sd")
    left = e.select(*by, F.col("model").alias("left"), F.col("values").alias("lv"), F.col("sd").alias("ls"))
    right = e.select(*by, F.col("model").alias("right"), F.col("values").alias("rv"), F.col("sd").alias("rs"))
    both = left.join(right, by).where("left < right")
    log_ratio = lambda a, b: F.log(F.greatest(a, F.lit(floor)) / F.greatest(b, F.lit(floor)))
    ids = [*by, "left", "right"]
    b = _with_draws(both, draws(panel.sparkSession, repeats, draws_count, seed))
    boot = b.groupBy(*ids).agg(
        F.array_sort(F.collect_list(log_ratio(_deviation(drawn("lv")), _deviation(drawn("rv"))))).alias("boot"), F.first(log_ratio(F.col("ls"), F.col("rs"))).alias("observed"),
        F.first("lv").alias("lv"), F.first("rv").alias("rv"),
    )
    boot = boot.withColumn("jack", F.zip_with(jackknife_sd(F.col("lv")), jackknife_sd(F.col("rv")), log_ratio))
    zero = F.count_if((F.col("dl") <= floor) | (F.col("dr") <= floor)).alias("zero_draws")
    zeros = b.select(*ids, _deviation(drawn("lv")).alias("dl"), _deviation(drawn("rv")).alias("dr")).groupBy(*ids).agg(zero)
    out = _bca(boot, ids, draws_count, level).join(zeros, ids)
    return out.select(*ids, F.exp("observed").alias("ratio"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"), "zero_draws")


# -- decisions -----------------------------------------------------------------------------------------------


def oriented(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Both directions of each contrast: ``model, other, lower, upper`` of model minus other."""
    a = intervals.select(*by, F.col("left").alias("model"), F.col("right").alias("other"), "lower", "upper")
    b = intervals.select(*by, F.col("right").alias("model"), F.col("left").alias("other"), (-F.col("upper")).alias("lower"), (-F.col("lower")).alias("upper"))
    return a.unionByName(b)


def supported_best(intervals: DataFrame, by: list[str]) -> DataFrame:
    """For each group the model whose loss is below every other's at the simultaneous level, if there is one (DEC-1)."""
    counted = oriented(intervals, by).groupBy(*by, "model").agg(F.count_if(F.col("upper") < 0).alias("beats"), F.count("*").alias("others"))
    best = F.max(F.when(F.col("beats") == F.col("others"), F.col("model")))
    return counted.groupBy(*by).agg(best.alias("supported_best"), F.count_if(F.col("beats") == F.col("others")).cast("long").alias("n_best"))


def controlled_sharpness(widths: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """A width contrast concludes only where both models' coverage bounds reach the target (DEC-2, JN-17)."""
    b = bounds.select(*by, "model", "reaches")
    left = b.withColumnsRenamed({"model": "left", "reaches": "left_ok"})
    right = b.withColumnsRenamed({"model": "right", "reaches": "right_ok"})
    both = widths.join(left, [*by, "left"]).join(right, [*by, "right"])
    ok = F.col("left_ok") & F.col("right_ok")
    verdict = F.when(~ok, "not_qualified").when(F.col("upper") < 0, "left_sharper").when(F.col("lower") > 0, "right_sharper").otherwise("inconclusive")
    return both.select(*by, "left", "right", "lower", "upper", verdict.alias("verdict"))


def classify(intervals: DataFrame) -> DataFrame:
    """``conclusion``: supported where the interval lies below 0, opposite above, else inconclusive (DEC-3)."""
    return intervals.withColumn("conclusion", F.when(F.col("upper") < 0, "supported").when(F.col("lower") > 0, "opposite").otherwise("inconclusive"))


def conclusion_changes(fixed: DataFrame, tuned: DataFrame, ids: list[str]) -> DataFrame:
    """Conclusions of two families of intervals side by side (DEC-3): ``degraded`` where the first is clear and the second isn't the same, ``reversed`` where both are
    clear and differ. Contrasts of one side only don't count."""
    a = classify(fixed).select(*ids, F.col("conclusion").alias("before"))
    out = a.join(classify(tuned).select(*ids, F.col("conclusion").alias("after")), ids)
    clear = F.col("before") != "inconclusive"
    return out.withColumns({"degraded": clear & (F.col("before") != F.col("after")), "reversed": clear & (F.col("after") != "inconclusive") & (F.col("before") != F.col("after"))})


def level_comparison(first: DataFrame, second: DataFrame, ids: list[str]) -> DataFrame:
    """Two levels' conclusions side by side: newly clear, ratio of critical values, reduction of width (STAT-15)."""
    a = classify(first).select(*ids, F.col("conclusion").alias("c1"), F.col("critical").alias("k1"))
    b = classify(second).select(*ids, F.col("conclusion").alias("c2"), F.col("critical").alias("k2"))
    out = a.join(b, ids)
    newly = (F.col("c1") == "inconclusive") & (F.col("c2") != "inconclusive")
    return out.select(*ids, "c1", "c2", newly.alias("newly_clear"), (F.col("k2") / F.col("k1")).alias("critical_ratio"), (100 * (1 - F.col("k2") / F.col("k1"))).alias("width_reduction"))


def extension_trigger(changes: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One row: whether any reason holds for any row, and which (DEC-4)."""
    held = [F.when(F.bool_or(F.coalesce(rule, F.lit(False))), F.lit(name)) for name, rule in reasons.items()]
    found = changes.agg(F.array_compact(F.array(*held)).alias("reasons"))
    return found.withColumn("extend", F.size("reasons") > 0)


def qualification_changes(fixed: DataFrame, tuned: DataFrame, ids: list[str]) -> DataFrame:
    """Cells whose coverage qualification differs between two panels (DEC-5)."""
    a, b = fixed.select(*ids, F.col("reaches").alias("fixed")), tuned.select(*ids, F.col("reaches").alias("tuned"))
    return a.join(b, ids).withColumn("changed", F.col("fixed") != F.col("tuned"))


def best_set(differences: DataFrame, by: list[str], repeats: int, draws_count: int, seed: int, level: float = 0.95) -> DataFrame:
    """Models that can't be rejected as best of their group: ``model, statistic, p_value, in_best_set`` (INF-8).

    For each candidate the statistic is the largest of the k - 1 studentized means of its loss minus another's; its
    distribution comes from resampling complete repeats and centring on the observed means. The candidate is rejected where
    fewer than 1 - level of the draws reach the statistic. Each group is judged on its own."""
    both = differences.select(*by, "repeat", F.col("left").alias("model"), F.col("right").alias("other"), "difference")
    both = both.unionByName(differences.select(*by, "repeat", F.col("right").alias("model"), F.col("left").alias("other"), (-F.col("difference")).alias("difference")))
    ids = [*by, "model", "other"]
    e = estimands(both, ids, "difference")
    seen = e.groupBy(*by, "model").agg(F.max(F.col("mean") / floored_se(F.col("mean"), F.col("sd"), F.col("n"))).alias("statistic"))
    b = _with_draws(e.select(*ids, "values", "mean"), draws(differences.sparkSession, repeats, draws_count, seed)).withColumn("s", drawn("values"))
    t = (F.col("s.mean") - F.col("mean")) / floored_se(F.col("s.mean"), _deviation(F.col("s")), F.col("s.n"))
    top = b.groupBy(*by, "model", "draw").agg(F.max(t).alias("t")).join(seen, [*by, "model"])
    p = top.groupBy(*by, "model").agg(F.first("statistic").alias("statistic"), (F.count_if(F.col("t") >= F.col("statistic")) / F.count("*")).alias("p_value"))
    return p.withColumn("in_best_set", F.col("p_value") >= 1 - level - 1e-12)

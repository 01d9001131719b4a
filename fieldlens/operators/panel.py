"""Statistics of a metrics panel: one row per (repeat, model, n_train) and metric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators import contract

#: Quantiles of a summary by name.
QUANTILES = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}


def melt(panel: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Long form: ids, metric, value."""
    return panel.unpivot(ids, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def summary_columns(value: str) -> list[Column]:
    """Mean, standard deviation (n - 1), Monte Carlo error and quantiles over repeats (AGG-12)."""
    v = F.col(value)
    quantiles = [F.percentile(v, F.lit(q)).alias(name) for name, q in QUANTILES.items()]
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("mcse"), *quantiles]


def summarize(panel: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Between-repeat summary of every metric (STAT-1, AGG-20, AGG-21)."""
    long = melt(panel, by + ["repeat"], metrics)
    return long.groupBy(*by, "metric").agg(*summary_columns("value")).withColumn("iqr", F.col("q75") - F.col("q25"))


def summarize_wide(summary: DataFrame, by: list[str], metrics: list[str], statistics: list[str]) -> DataFrame:
    """Summary with a column for each metric and statistic (AGG-13)."""
    cells = [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in statistics]
    return summary.groupBy(*by).agg(*cells)


def ribbons(panel: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean with the 10 and 90 % quantiles by metric, model and n_train (STAT-2)."""
    v = F.col("value")
    return melt(panel, ["model", "n_train", "repeat"], metrics).groupBy("metric", "model", "n_train").agg(
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.1)).alias("q10"), F.percentile(v, F.lit(0.9)).alias("q90")
    )


def grid_check(panel: DataFrame, dims: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Cells that are missing, repeated or not asked for: ``dims, n, problem`` (SET-3, SET-2). ``expected`` holds the
    cells that should be there; without it they are all combinations of the values that the panel itself holds, and then
    a value that is absent everywhere can't be missed."""
    if expected is None:
        expected = panel.select(dims[0]).distinct()
        for d in dims[1:]:
            expected = expected.crossJoin(panel.select(d).distinct())  # values of each dimension, never rows
    there = panel.groupBy(*dims).agg(F.count("*").alias("n"))
    out = expected.select(*dims).distinct().withColumn("__asked", F.lit(True)).join(there, dims, "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    problem = F.when(F.col("__asked").isNull(), "extra").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "duplicate")
    return out.select(*dims, "n", problem.alias("problem")).where("problem is not null")


def domain_check(panel: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, null counting as broken (SET-6)."""
    return panel.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def paired_models(panel: DataFrame, metric: str, pair_on: tuple[str, ...] = ("repeat", "n_train")) -> DataFrame:
    """Differences of every two models within a repeat: ``left, right, difference`` with left < right (STAT-3, JN-15)."""
    on = list(pair_on)
    left = panel.select(*on, F.col("model").alias("left"), F.col(metric).alias("__l"))
    right = panel.select(*on, F.col("model").alias("right"), F.col(metric).alias("__r"))
    return left.join(right, on).where("left < right").select(*on, "left", "right", (F.col("__l") - F.col("__r")).alias("difference"))


def difference_stability(panel: DataFrame, metric: str) -> DataFrame:
    """Mean, deviation, error and quantiles of paired differences (STAT-4)."""
    return paired_models(panel, metric).groupBy("left", "right", "n_train").agg(*summary_columns("difference"))


def size_contrasts(panel: DataFrame, metric: str, kind: str = "adjacent") -> DataFrame:
    """Differences between training sizes of one model within a repeat: ``all`` pairs, ``adjacent`` or ``ends`` (STAT-5)."""
    sizes = panel.select("n_train").distinct()
    order = Window.orderBy("n_train")
    ranked = sizes.select("n_train", F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy()).alias("k"))
    a = ranked.select(F.col("n_train").alias("small"), F.col("r").alias("ra"), "k")
    b = ranked.select(F.col("n_train").alias("large"), F.col("r").alias("rb"))
    keep = {"all": F.col("ra") < F.col("rb"), "adjacent": F.col("rb") == F.col("ra") + 1, "ends": (F.col("ra") == 1) & (F.col("rb") == F.col("k")) & (F.col("k") > 1)}[kind]
    pairs = a.join(b, keep).select("small", "large")
    lo = panel.select("repeat", "model", F.col("n_train").alias("small"), F.col(metric).alias("__lo"))
    hi = panel.select("repeat", "model", F.col("n_train").alias("large"), F.col(metric).alias("__hi"))
    both = lo.join(F.broadcast(pairs), "small").join(hi, ["repeat", "model", "large"])  # pairs of a handful of training sizes
    return both.select("repeat", "model", "small", "large", (F.col("__hi") - F.col("__lo")).alias("difference"))


def size_changes(panel: DataFrame, metric: str, start: int, end: int) -> DataFrame:
    """Change from one training size to another by repeat and model (STAT-6)."""
    at = lambda n: F.max(F.when(F.col("n_train") == n, F.col(metric)))
    return panel.groupBy("repeat", "model").agg((at(end) - at(start)).alias("change"))


def difference_in_changes(panel: DataFrame, metric: str, start: int, end: int) -> DataFrame:
    """How much more one model changes than another (STAT-7)."""
    changes = size_changes(panel, metric, start, end)
    return paired_models(changes, "change", ("repeat",)).groupBy("left", "right").agg(*summary_columns("difference"))


def secondary_violations(primary: DataFrame, secondary: DataFrame, identity: str) -> DataFrame:
    """``identity, rule, key`` of the cells that an intervention and the primary panel don't have exactly once each (JN-16)."""
    on = ["repeat", "model", "n_train"]
    every = secondary.select(identity).distinct()
    full = primary.select(*on).crossJoin(F.broadcast(every))  # a few interventions
    wrong = contract.not_one_to_one(full, secondary, [identity, *on])
    return wrong.select(F.element_at(F.split("key", ":"), 1).alias(identity), F.regexp_replace("rule", "right", "secondary").alias("rule"), "key")


def secondary_effects(primary: DataFrame, secondary: DataFrame, metric: str, identity: str, strict: bool = False) -> DataFrame:
    """Secondary minus primary within (repeat, model, n_train), summarised by intervention (STAT-8, JN-16). ``strict``: cells that aren't
    paired one to one are an error; else they are left out, and secondary_violations() names them."""
    on = ["repeat", "model", "n_train"]
    if strict:
        contract.enforce(secondary_violations(primary, secondary, identity))
    both = secondary.select(*on, identity, F.col(metric).alias("__s")).join(primary.select(*on, F.col(metric).alias("__p")), on)
    both = both.withColumn("difference", F.col("__s") - F.col("__p"))
    return both.groupBy(identity, "model", "n_train").agg(*summary_columns("difference"))


def leaders(summary: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """The model with the least mean in each group, ties to the first name (SRT-5, SRT-7)."""
    best = summary.groupBy(*by).agg(F.min(F.struct(F.col(value).alias("v"), F.col("model").alias("m"))).alias("b"))
    return best.select(*by, F.col("b.m").alias("leader"), F.col("b.v").alias("leader_mean"))


def rankings(summary: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """Models from least to largest mean as ``a > b > c`` (SRT-6)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("model").alias("m"))))
    return summary.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["m"]), " > ").alias("ranking"))


def best_share(panel: DataFrame, metric: str) -> DataFrame:
    """Share of repeats in which a model ranks first, ties sharing the place (AGG-17)."""
    place = F.rank().over(Window.partitionBy("repeat", "n_train").orderBy(metric))
    ranked = panel.select("model", "n_train", place.alias("place"))
    return ranked.groupBy("model", "n_train").agg(F.avg((F.col("place") == 1).cast("double")).alias("best_share"))


def winner_counts(panel: DataFrame, metric: str) -> DataFrame:
    """Cells that each model leads, zero included (AGG-18)."""
    won = panel.groupBy("repeat", "n_train").agg(F.min(F.struct(F.col(metric).alias("v"), F.col("model").alias("m"))).alias("b"))
    won = won.groupBy(F.col("b.m").alias("model")).agg(F.count("*").alias("wins"))
    return panel.select("model").distinct().join(won, "model", "left").select("model", F.coalesce("wins", F.lit(0)).alias("wins"))


def ranking_changes(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Groups with both rankings and whether they differ (STAT-11)."""
    a, b = rankings(first, by).withColumnRenamed("ranking", "before"), rankings(second, by).withColumnRenamed("ranking", "after")
    return a.join(b, by).withColumn("changed", F.col("before") != F.col("after"))


def secondary_pairwise(secondary: DataFrame, metric: str, identity: str) -> DataFrame:
    """Differences of every two models within one intervention, summarised (STAT-9)."""
    d = paired_models(secondary, metric, ("repeat", "n_train", identity))
    return d.groupBy(identity, "left", "right", "n_train").agg(*summary_columns("difference"))


def configuration_frequency(panel: DataFrame, metric: str, repeats: int) -> DataFrame:
    """How often each configuration has the least loss of its repeat, and in what share of repeats (AGG-15)."""
    won = leaders(panel.withColumn("__v", F.col(metric)), ["repeat", "n_train"], "__v")
    return won.groupBy("n_train", F.col("leader").alias("configuration")).agg(F.count("*").alias("n"), (F.count("*") / float(repeats)).alias("fraction"))


def metric_ranges(panel: DataFrame, metrics: list[str]) -> DataFrame:
    """Median, least and largest mean of a metric over its cells (AGG-19)."""
    cells = melt(panel, ["model", "n_train", "repeat"], metrics).groupBy("metric", "n_train", "model").agg(F.avg("value").alias("m"))
    return cells.groupBy("metric").agg(F.percentile("m", F.lit(0.5)).alias("median"), F.min("m").alias("low"), F.max("m").alias("high"), F.count("*").alias("n"))


def leader_matrix(summary: DataFrame, supported: DataFrame, by: list[str]) -> DataFrame:
    """The leader of each group and whether it is also the supported best (STAT-14)."""
    lead = leaders(summary, by).select(*by, "leader")
    return lead.join(supported, by, "left").select(*by, "leader", F.coalesce(F.col("leader") == F.col("supported_best"), F.lit(False)).alias("supported"))


def task_equal(panels: DataFrame, metric: str, need: int) -> DataFrame:
    """Tasks weigh the same: mean by task, then over tasks, for cells that at least ``need`` tasks have (STAT-12, AGG-16)."""
    per = panels.groupBy("task", "model", "n_train").agg(F.avg(metric).alias("v"))
    out = per.groupBy("model", "n_train").agg(
        F.count("*").alias("n_tasks"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"),
    )
    return out.where(F.col("n_tasks") >= need)


def membership_violations(panels: DataFrame, expected: DataFrame) -> DataFrame:
    """``model, n_train, missing, beside`` of the cells that not exactly the ``expected`` tasks (task, model, n_train) have (STAT-12): which lack, and which
    aren't asked for, both as sorted lists."""
    on = ["task", "model", "n_train"]
    there = panels.select(*on).distinct().withColumn("__there", F.lit(True))
    both = expected.select(*on).distinct().withColumn("__asked", F.lit(True)).join(there, on, "full_outer")
    listed = lambda rule: F.array_join(F.array_sort(F.collect_list(F.when(rule, F.col("task")))), ",")  # noqa: E731  a row a task
    out = both.groupBy("model", "n_train").agg(listed(F.col("__there").isNull()).alias("missing"), listed(F.col("__asked").isNull()).alias("beside"))
    return out.where((F.col("missing") != "") | (F.col("beside") != ""))


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: rows of either side, keys on one side only, and values that differ (SRC-10, JN-10, SET-4)."""
    l_ = left.select(*[F.col(k).alias(f"l_{k}") for k in keys + values], F.lit(True).alias("in_left"))
    r_ = right.select(*[F.col(k).alias(f"r_{k}") for k in keys + values], F.lit(True).alias("in_right"))
    on = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]
    both = l_.join(r_, on, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}"))
    there = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    return both.agg(
        F.count("in_left").alias("n_left"), F.count("in_right").alias("n_right"), F.count_if(F.col("in_right").isNull()).alias("left_only"),
        F.count_if(F.col("in_left").isNull()).alias("right_only"), F.count_if(there & ~same).alias("different"),
    )

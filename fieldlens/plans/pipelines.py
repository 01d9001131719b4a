"""End-user jobs composed of operators: cohorts, framewise scoring, full analyses of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import automaton, cohort, contract, encode, frames, inference, panel, tokens
from fieldlens.sources.steps import written


def marker_cohort(
    plays: DataFrame, rows: DataFrame, play: str, frame: str, marker: str, eligible: Column, label: Column, names: list[str], k: int,
    unique: bool = False, valid: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """A prediction cohort cut at a marker (PIPE-2 to PIPE-4, PIPE-6): ``examples`` (one per kept play with its label,
    cutoff and history), ``tokens`` (the rows of the last ``k`` frames with time_index) and ``audit`` (plays by status).

    Only rows at or before the cutoff reach the tokens. Exclusions are counted, never silent.
    """
    asked = plays.withColumn("__eligible", F.coalesce(eligible, F.lit(False)))
    cut = frames.discover_cutoffs(rows, asked.where("__eligible"), play, frame, marker, names, unique, valid)
    windows = frames.history_windows(rows, cut.where("status = 'kept'"), play, frame, k)
    history = frames.history_length(windows, play, k)
    examples = plays.withColumn("label", label).join(cut.where("status = 'kept'").select(play, "cutoff", "events"), play).join(history, play)
    status = asked.select(play, "__eligible").join(cut.select(play, "status"), play, "left")
    audit = status.groupBy(F.when(F.col("__eligible"), F.col("status")).otherwise("not_eligible").alias("status")).agg(F.count("*").alias("plays"))
    return {"examples": examples, "tokens": frames.rows_at(rows, windows, play, frame), "audit": audit}


def handoff_cohort(
    rows: DataFrame, play: str, obj: str, rusher: str, side: str, sides: list[str], target: str, low: int, high: int, yard_line: str, own_half: Column, scores: dict[str, str], clock: str,
    train: Column, rules: dict, size: int = 22, **geometry_roles,
) -> dict[str, DataFrame]:
    """The distribution cohort of handoff snapshots (PIPE-1): ``examples`` (label, context and the distribution's baseline), ``tokens`` (every object in
    standard geometry and slot), ``thresholds`` (one row for each threshold of an example's distribution) and ``audit``.

    The snapshot contract feeds the cohort: a play that breaks one of its rules leaves, and counts in the audit under the first of its rules by name; no play is
    lost silently. ``rules``: constant, finite, finite_if_there, whole and domains of contract.snapshot_contract(). ``scores``: column of each side's score.
    ``train``: condition on a play's columns that says which examples make the baseline, the share of labels up to each class. Keys hold no colon.
    """
    wrong = contract.snapshot_contract(rows, [play], obj, rusher, side, sides, rules["constant"], rules["finite"], rules["finite_if_there"], rules["whole"], rules["domains"], size)
    reasons = wrong.groupBy(F.substring_index("key", ":", 1).alias("__play")).agg(F.min("rule").alias("reason"))
    every = rows.select(play).distinct().withColumn("__play", F.col(play).cast("string")).join(reasons, "__play", "left").drop("__play")
    audit = every.groupBy(F.coalesce("reason", F.lit("kept")).alias("status")).agg(F.count("*").alias("plays"))
    kept = rows.join(every.where("reason is null").select(play), play)
    is_rusher = F.col(obj) == F.col(rusher)
    first = kept.where(is_rusher).withColumn("__side", F.col(side))  # one row a play, as the contract says
    offense = F.col(side) == F.col("__side")
    kept = kept.join(first.select(play, "__side"), play)
    ahead, behind, lead = fn.score_columns(F.col("__side") == sides[0], F.col(scores[sides[0]]), F.col(scores[sides[1]]))
    examples = first.select(
        play, cohort.support_index(F.col(target).cast("int"), low, high).alias("label"), fn.yards_from_own_goal(F.col(yard_line), own_half).alias("yards_from_own_goal"), ahead.alias("offense_score"),
        behind.alias("defense_score"), lead.alias("lead"), fn.clock_seconds(F.col(clock)).alias("clock_seconds"), train.alias("train"),
    )
    classes = high - low + 1
    counts = examples.where("train").groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"), F.sum("n").alias("t"))  # classes entries
    upto = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)))
    running = F.transform(upto, lambda _, i: F.aggregate(F.slice(upto, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x) / F.col("t"))
    examples = examples.crossJoin(F.broadcast(counts.select(running.alias("baseline"))))  # one row
    std = tokens.against_rusher(tokens.handoff_geometry(kept, offense, unit=True, **geometry_roles), play, is_rusher)
    slots = tokens.side_slots(kept, [play], obj, offense)
    grid = encode.threshold_rows(examples, play, "baseline", classes, ["label"])
    grid = grid.withColumn("residual", (F.col("label") <= F.col("k")).cast("double") - F.col("base")).drop("label")
    return {"examples": examples, "tokens": std.join(slots, [play, obj]), "thresholds": grid, "audit": audit}


def framewise_scoring(rows: DataFrame, train: Column, keys: list[str], frame: str, x: list[str], y: str, penalty: float, threshold: float, run: int) -> DataFrame:
    """Score every frame of every key with a ridge model of the training rows and run the automaton over the scores
    (PIPE-8): opportunities and misses by key. The fit and the scores read the same features, which are made once and written."""
    all_rows = written(rows.select(*dict.fromkeys([*keys, frame, *x, y]), train.alias("__train"), F.lit(1).alias("__cell")))
    beta = encode.ridge_fit(encode.ridge_moments(all_rows.where("__train"), ["__cell"], x, y), ["__cell"], len(x) + 1, penalty)
    scored = encode.linear_score(all_rows, beta, ["__cell"], x)
    return automaton.opportunities(scored, keys, frame, "prediction", threshold, run)


def task_analysis(table: DataFrame, loss: str, width: str, coverage: str, repeats: int, draws: int, seed: int, target: float) -> dict[str, DataFrame]:
    """The tables of one task's analysis (PIPE-11, PIPE-15): summary, ribbons, differences, size changes, simultaneous
    intervals, coverage bounds, stability, supported best and controlled sharpness. The draws and the intervals that several tables need are written
    once; tables are lazy."""
    metrics = [loss, width, coverage]
    by = ["n_train", "left", "right"]
    registry = written(inference.draws(table.sparkSession, repeats, draws, seed))
    intervals = lambda metric: inference.max_t_intervals(panel.paired_models(table, metric), by, repeats, draws, seed, registry=registry)
    contrasts = written(intervals(loss))
    bounds = written(inference.lower_bounds(table, coverage, ["model", "n_train"], repeats, draws, seed, target, registry=registry))
    return {
        "summary": panel.summarize(table, ["model", "n_train"], metrics),
        "ribbons": panel.ribbons(table, metrics),
        "difference_stability": panel.difference_stability(table, loss),
        "adjacent_sizes": panel.size_contrasts(table, loss, "adjacent"),
        "contrasts": contrasts,
        "coverage_bounds": bounds,
        "stability": inference.bca_sd(table, loss, ["model", "n_train"], repeats, draws, seed, registry=registry),
        "supported_best": inference.supported_best(contrasts, ["n_train"]),
        "controlled_sharpness": inference.controlled_sharpness(intervals(width), bounds, ["n_train"]),
    }


def provisional(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of a pilot, each marked as exploratory (STAT-13)."""
    return {name: df.withColumn("status", F.lit("exploratory_provisional")) for name, df in tables.items()}


def tuning_study(fixed: DataFrame, tuned: DataFrame, metric: str, repeats: int, draws: int, seed: int) -> DataFrame:
    """Tuned minus fixed by model and size: simultaneous intervals and conclusions, the change in percent of the fixed mean (null where that is 0), and whether the
    mean shifts beyond the interval's half width from no change (STAT-10, PIPE-12)."""
    on = ["repeat", "model", "n_train"]
    d = tuned.select(*on, F.col(metric).alias("__t")).join(fixed.select(*on, F.col(metric).alias("__f")), on)
    before = d.groupBy("model", "n_train").agg(F.avg("__f").alias("__mean"))
    d = d.select(*on, (F.col("__t") - F.col("__f")).alias("difference"))
    out = inference.classify(inference.max_t_intervals(d, ["model", "n_train"], repeats, draws, seed)).join(before, ["model", "n_train"])
    relative = F.when(F.col("__mean") != 0, 100 * F.col("mean") / F.abs("__mean"))
    return out.withColumns({"relative_change": relative, "shifted": (F.col("lower") > 0) | (F.col("upper") < 0)}).drop("__mean")


def suite(panels: dict[str, DataFrame], metric: str, need: int) -> DataFrame:
    """The task-equal synthesis of several tasks' panels (PIPE-13)."""
    out = None
    for name, table in panels.items():
        t = table.withColumn("task", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return panel.task_equal(out, metric, need)


def recomputation_check(recorded: DataFrame, again: DataFrame, expected: DataFrame, metrics: list[str], tolerance: float = 1e-9) -> dict[str, DataFrame]:
    """Whether a panel's aggregate can be had again (PIPE-14): cells against the expected grid, and metrics that deviate."""
    from fieldlens.operators import cells

    by = ["repeat", "model", "n_train"]
    return {"grid": panel.grid_check(recorded, by, expected), "metrics": cells.replayed(recorded, again, by, metrics, tolerance)}


__all__ = ["framewise_scoring", "handoff_cohort", "marker_cohort", "provisional", "recomputation_check", "suite", "task_analysis", "tokens", "tuning_study"]

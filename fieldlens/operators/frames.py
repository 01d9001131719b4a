"""Ordered-sequence operators over frames of plays: cutoffs, history windows, slots, event frames.

A *play* is the unit that one prediction asks about; its rows carry a *frame* number, an *object* and perhaps a
*marker*. Columns are passed by role; every operator partitions by play, so one shuffle on the play serves a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators import contract


def first_occurrence(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``; null keys compare equal (WIN-3)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def discover_cutoffs(
    rows: DataFrame, eligible: DataFrame, play: str, frame: str, marker: str, names: list[str], unique: bool = False, valid: DataFrame | None = None
) -> DataFrame:
    """Each eligible play's earliest marker frame: ``play, n_frames, cutoff, events, status`` (WIN-4, AGG-1..3, JN-6).

    Marker names compare in lower case. status: ``no_marker``; ``ambiguous`` where ``unique`` asks for exactly one
    distinct frame; ``invalid_frame`` where ``valid`` (play, frame) lacks the cutoff frame (a later marker is not
    tried); else ``kept``.
    """
    hits = rows.where(F.lower(F.col(marker)).isin(*names)).select(play, F.col(frame).alias("__f"), F.lower(F.col(marker)).alias("__e"))
    hits = hits.join(eligible.select(play), play, "left_semi").distinct()
    found = hits.groupBy(play).agg(F.countDistinct("__f").alias("n_frames"), F.min("__f").alias("cutoff"), F.collect_set(F.struct("__f", "__e")).alias("__all"))
    at_cutoff = F.filter("__all", lambda x: x["__f"] == F.col("cutoff"))
    found = found.withColumn("events", F.array_join(F.array_sort(F.array_distinct(F.transform(at_cutoff, lambda x: x["__e"]))), "+")).drop("__all")
    out = eligible.select(play).distinct().join(found, play, "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))
    status = F.when(F.col("n_frames") == 0, "no_marker")
    if unique:
        status = status.when(F.col("n_frames") > 1, "ambiguous")
    if valid is not None:
        good = valid.select(F.col(play).alias("__p"), F.col(frame).alias("__vf")).distinct()
        out = out.join(good, (F.col(play) == F.col("__p")) & (F.col("cutoff") == F.col("__vf")), "left")
        status = status.when(F.col("__p").isNull(), "invalid_frame")
        return out.withColumn("status", status.otherwise("kept")).drop("__p", "__vf")
    return out.withColumn("status", status.otherwise("kept"))


def marker_counts(cutoffs: DataFrame) -> DataFrame:
    """How many plays have how many marker frames (AGG-6), from discover_cutoffs()."""
    return cutoffs.groupBy("n_frames").agg(F.count("*").alias("plays"))


def history_windows(rows: DataFrame, cutoffs: DataFrame, play: str, frame: str, k: int) -> DataFrame:
    """The last ``k`` observed distinct frames through the cutoff: ``play, frame, time_index`` with time_index up to
    k - 1 at the cutoff; gaps take no slot (WIN-1, SRT-3, JN-3)."""
    seen = rows.select(play, frame).distinct().join(cutoffs.select(play, "cutoff"), play).where(F.col(frame) <= F.col("cutoff"))
    back = F.row_number().over(Window.partitionBy(play).orderBy(F.desc(frame)))
    return seen.withColumn("__b", back).where(F.col("__b") <= k).select(play, frame, (F.lit(k) - F.col("__b")).alias("time_index"))


def rows_at(rows: DataFrame, windows: DataFrame, play: str, frame: str) -> DataFrame:
    """The rows of selected frames (WIN-2, JN-2)."""
    return rows.join(windows, [play, frame])


def history_length(windows: DataFrame, play: str, k: int) -> DataFrame:
    """Frames of history and left padding by play (AGG-5)."""
    return windows.groupBy(play).agg(F.count("*").alias("history")).withColumn("padding", F.lit(k) - F.col("history"))


def active_window(rows: DataFrame, play: str, frame: str, marker: str, start: list[str], stop: list[str], delay: int) -> DataFrame:
    """``play, start_frame, end_frame, n_start``: from the start marker plus ``delay`` to the earliest stop marker,
    defaulting to the play's first and last frame (WIN-5). marker_violations() names plays with n_start over 1."""
    name = F.lower(F.col(marker))
    agg = rows.groupBy(play).agg(
        F.min(frame).alias("__lo"), F.max(frame).alias("__hi"), F.min(F.when(name.isin(*start), F.col(frame))).alias("__s"),
        F.min(F.when(name.isin(*stop), F.col(frame))).alias("__e"), F.countDistinct(F.when(name.isin(*start), F.col(frame))).alias("n_start"),
    )
    return agg.select(play, F.coalesce(F.col("__s") + delay, F.col("__lo")).alias("start_frame"), F.coalesce("__e", "__hi").alias("end_frame"), "n_start")


def marker_violations(rows: DataFrame, play: str, frame: str, marker: str, groups: dict[str, list[str]]) -> DataFrame:
    """``rule, key`` of plays that have a kind of marker at several frames (WIN-5), one rule for each of ``groups``."""
    name = F.lower(F.col(marker))
    return contract.broken_groups(rows, [play], {rule: F.countDistinct(F.when(name.isin(*names), F.col(frame))) > 1 for rule, names in groups.items()})


def nearest_frame(rows: DataFrame, play: str, frame: str, left: Column, right: Column, x: str, y: str) -> DataFrame:
    """The first frame at which two objects of a play are nearest: ``play, event_frame, d2`` (WIN-6, JN-8).
    ``left`` and ``right`` select the rows of either object."""
    a = rows.where(left).select(play, frame, F.col(x).alias("__ax"), F.col(y).alias("__ay"))
    b = rows.where(right).select(play, frame, F.col(x).alias("__bx"), F.col(y).alias("__by"))
    d2 = (F.col("__ax") - F.col("__bx")) ** 2 + (F.col("__ay") - F.col("__by")) ** 2
    both = a.join(b, [play, frame]).withColumn("d2", d2)
    best = both.groupBy(play).agg(F.min(F.struct("d2", frame)).alias("m"))
    return best.select(play, F.col(f"m.{frame}").alias("event_frame"), F.col("m.d2").alias("d2"))


def stable_slots(rows: DataFrame, play: str, obj: str, rank: list[Column], most: int) -> DataFrame:
    """One slot per object and play: objects ordered by the least of their rank values, then id; ``overflow`` marks
    plays with over ``most`` objects (WIN-8 to WIN-12)."""
    keyed = rows.groupBy(play, obj).agg(F.min(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])).alias("__rank"))
    by = Window.partitionBy(play)
    slot = F.row_number().over(by.orderBy("__rank", obj)) - 1
    return keyed.withColumn("slot", slot).withColumn("overflow", F.count("*").over(by) > most).drop("__rank")


def seconds_to_last(rows: DataFrame, play: str, position: str, hz: float) -> DataFrame:
    """Adds ``to_last``: (position - last observed position) / hz (WIN-13, WIN-14)."""
    return rows.withColumn("to_last", (F.col(position) - F.max(position).over(Window.partitionBy(play))) / hz)


def final_state(rows: DataFrame, keys: list[str], frame: str, columns: list[str]) -> DataFrame:
    """The ``columns`` of each key's last frame (WIN-15)."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(frame, *columns), frame).alias("s"))
    return last.select(*keys, F.col(f"s.{frame}").alias("last_frame"), *[F.col(f"s.{c}").alias(c) for c in columns])


def completeness(rows: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Whether each key's frames are exactly 1..n: ``n_rows, first, last, n_distinct, complete`` (AGG-7)."""
    a = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(frame).alias("first"), F.max(frame).alias("last"), F.countDistinct(frame).alias("n_distinct"))
    return a.withColumn("complete", (F.col("first") == 1) & (F.col("last") == F.col("n_rows")) & (F.col("n_distinct") == F.col("n_rows")))


def extents(rows: DataFrame, play: str, frame: str, obj: str) -> DataFrame:
    """Most frames and most objects in a frame over all plays (AGG-4, AGG-8)."""
    per_frame = rows.groupBy(play, frame).agg(F.countDistinct(obj).alias("n"))
    per_play = per_frame.groupBy(play).agg(F.count("*").alias("frames"), F.max("n").alias("objects"))
    return per_play.agg(F.max("frames").alias("max_frames"), F.max("objects").alias("max_objects"), F.count("*").alias("plays"))


def cohort_audit(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """One row: the funnel counts after each step, the exclusions by first failed step, and whether the funnel
    never grows (PRJ-15). A step's null counts as failed."""
    passed: Column = F.lit(True)
    counts, reasons = [F.count("*").alias("n_all")], []
    for name, rule in steps:
        ok = F.coalesce(rule, F.lit(False))
        reasons.append(F.count_if(passed & ~ok).alias(f"excluded_{name}"))
        passed = passed & ok
        counts.append(F.count_if(passed).alias(f"n_{name}"))
    return rows.agg(*counts, *reasons)


def forbid(df: DataFrame, columns: set[str]) -> DataFrame:
    """``df``, or an error where a column is known only after the cutoff (PRJ-13)."""
    if found := sorted(columns & set(df.columns)):
        raise ValueError(f"columns known only after the cutoff: {', '.join(found)}")
    return df

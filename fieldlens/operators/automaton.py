"""Opportunities: a run of high scores opens one, a run of low scores after it is a miss.

Frames of a key are cut into runs of equal kind (high or low) without a gap. Only runs of at least ``run`` frames
decide anything: a high one opens an opportunity unless one is open, a low one ends an open one as missed, each at its
``run``-th frame; a gap between frames ends an open one without a miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(scores: DataFrame, frame: str, p: str) -> DataFrame:
    """Rows with a frame and a finite score; any other row leaves a gap."""
    value = F.col(p).cast("double")
    return scores.where(F.col(frame).isNotNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def opportunities(scores: DataFrame, keys: list[str], frame: str, p: str, threshold: float = 0.75, run: int = 5) -> DataFrame:
    """Per key: frames scored, first and last frame, opportunities and misses with their frames (WIN-16, WIN-17).

    Strictly above ``threshold`` is high. Null, NaN and infinite scores are no score, so they leave a gap; of several
    scores of one frame the largest counts. All steps are windows over one sort by key and frame.
    """
    rows = usable(scores, frame, p).select(*keys, F.col(frame).cast("long").alias("__f"), F.col(p).cast("double").alias("__p"))
    order = Window.partitionBy(*keys).orderBy("__f", F.desc("__p"))
    rows = rows.withColumn("__before", F.lag("__f").over(order)).where(F.col("__before").isNull() | (F.col("__before") < F.col("__f")))
    order = Window.partitionBy(*keys).orderBy("__f")
    high = F.col("__p") > threshold
    gap = F.coalesce(F.col("__f") - F.lag("__f").over(order) > 1, F.lit(True))
    turn = gap | F.coalesce(high != F.lag(high).over(order), F.lit(True))
    rows = rows.select(*keys, "__f", high.alias("__high"), gap.cast("int").alias("__gap"), turn.cast("int").alias("__turn"))
    rows = rows.withColumn("__part", F.sum("__gap").over(order)).withColumn("__run", F.sum("__turn").over(order))
    runs = rows.groupBy(*keys, "__run").agg(F.min("__f").alias("__from"), F.max("__f").alias("__to"), F.count("*").alias("__n"), F.first("__high").alias("__high"), F.first("__part").alias("__part"))
    long = F.col("__n") >= run
    earlier = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__last", F.last(F.when(long, F.struct("__part", "__high")), ignorenulls=True).over(earlier))
    opened = F.coalesce((F.col("__last.__part") == F.col("__part")) & F.col("__last.__high"), F.lit(False))
    at = (F.col("__from") + run - 1).alias("at")
    listed = lambda rule: F.array_sort(F.collect_list(F.when(long & rule, at)))
    out = runs.groupBy(*keys).agg(
        F.sum("__n").cast("int").alias("n_frames"), F.min("__from").alias("first_frame"), F.max("__to").alias("last_frame"),
        listed(F.col("__high") & ~opened).alias("__o"), listed(~F.col("__high") & opened).alias("__m"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select(
        *keys, "n_frames", "first_frame", "last_frame", F.size("__o").alias("opportunities"), F.size("__m").alias("misses"), text("__o").alias("open_frames"), text("__m").alias("miss_frames")
    )

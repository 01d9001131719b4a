"""Tackle questions: pairwise pursuit features of every defender in every frame, and the cohort of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import geometry

#: The features of a defender, in the order in which models take them.
FEATURES = ["carrier_speed", "rel_vx", "rel_vy", "distance", "attack_cosine", "cell_area", "team_influence", "blocker_influence", "is_run"]
#: The field that positions are clipped to for areas and influence.
BOX = (120.0, 53.0)


def defender_features(
    rows: DataFrame, keys: list[str], obj: str, carrier: Column, offense: Column, defense: Column, run: Column, offset: int = 10, hz: float = 10.0,
    x: str = "x", y: str = "y", speed: str = "s", heading: str = "dir",
) -> DataFrame:
    """``keys, obj`` and FEATURES for every defender of every frame that has exactly one carrier (FEAT-9, FEAT-10).

    ``heading`` is in degrees, from the x axis. Distance and attack angle take positions as they are; area and influence take
    them clipped to BOX. The attack angle aims at where the carrier is ``offset`` frames later. A frame's objects meet in one row
    (one shuffle by frame; a frame holds some twenty objects), what its defenders share is computed once, and defenders are
    exploded last. Rows without position, speed or heading take no part; other frames give no row.
    """
    cols = {"obj": F.col(obj), **{n: F.col(c).cast("double") for n, c in (("x", x), ("y", y), ("s", speed), ("d", heading))}}
    known = rows.where(cols["x"].isNotNull() & cols["y"].isNotNull() & cols["s"].isNotNull() & cols["d"].isNotNull())
    clip = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(top))
    turn = F.radians(cols["d"])
    one = F.struct(
        *[c.alias(n) for n, c in cols.items()], turn.alias("t"), clip(cols["x"], BOX[0]).alias("cx"), clip(cols["y"], BOX[1]).alias("cy"),
        (cols["s"] * F.cos(turn)).alias("vx"), (cols["s"] * F.sin(turn)).alias("vy"),
    )
    held = lambda rule: F.array_sort(F.collect_list(F.when(rule, one)))
    frame = known.groupBy(*keys).agg(
        held(carrier).alias("c"), held(offense & ~carrier).alias("o"), held(defense).alias("d"), held(~carrier).alias("all"), F.max(run.cast("double")).alias("is_run")
    )
    frame = frame.where(F.size("c") == 1).withColumn("c", F.get("c", F.lit(0)))

    def felt(players: Column, px: Column, py: Column) -> Column:
        return fn.total(F.transform(players, lambda p: geometry.influence(px - p["x"], py - p["y"], p["s"], p["t"])))

    sites = F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    c = F.col("c")
    frame = frame.withColumn("cell_area", geometry.carrier_area(c["x"], c["y"], sites, box=BOX))
    frame = frame.withColumn("team_influence", felt(F.col("o"), c["cx"], c["cy"]) - felt(F.col("d"), c["cx"], c["cy"]))
    each = frame.withColumn("p", F.explode("d"))
    p, ahead = F.col("p"), offset / hz
    aim = F.atan2(c["y"] + c["vy"] * ahead - p["y"], c["x"] + c["vx"] * ahead - p["x"])
    return each.select(
        *keys, p["obj"].alias(obj), c["s"].alias("carrier_speed"), (p["vx"] - c["vx"]).alias("rel_vx"), F.abs(p["vy"] - c["vy"]).alias("rel_vy"),
        F.sqrt((c["x"] - p["x"]) ** 2 + (c["y"] - p["y"]) ** 2).alias("distance"), F.cos(aim - p["t"]).alias("attack_cosine"), "cell_area", "team_influence",
        felt(F.col("o"), p["cx"], p["cy"]).alias("blocker_influence"), "is_run",
    )


def tackle_cohort(
    rows: DataFrame, candidates: DataFrame, play: str, frame: str, obj: str, marker: str, carrier: Column, start: list[str], stop: list[str], delay: int, back: int,
    closest: bool = False, x: str = "x", y: str = "y",
) -> dict[str, DataFrame]:
    """Candidate tackles with the frame that a prediction may see (PIPE-5): ``examples`` (play, obj, label, event_frame,
    state_frame, status) and ``audit`` (candidates by status).

    ``candidates``: (play, obj, label), label 1 where the tackle was made. A made tackle happens at the play's one stop marker
    inside the active window (start marker plus ``delay`` to the first stop marker); a missed one, or with ``closest`` any, at the
    first frame of least distance to the carrier. The state is ``back`` frames earlier. status: ``missing_tracking``
    (no active frame), ``missing_event`` (no stop frame, several, or never seen with the carrier), ``too_early`` (state at or before 0 or outside
    the active window), else ``kept``. Rows are read once and grouped by play, or by play and more, so one shuffle by play serves all of it.
    """
    asked = candidates.select(play, obj, "label").distinct()
    name, f = F.lower(F.col(marker)), F.col(frame)
    by = Window.partitionBy(play)
    held = F.collect_list(F.when(carrier, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).over(Window.partitionBy(play, frame))  # of a frame's carriers
    own = rows.select(play, frame, obj, name.alias("__name"), F.col(x).alias("__x"), F.col(y).alias("__y"), held.alias("__held"))
    first = F.coalesce(F.min(F.when(F.col("__name").isin(*start), f)).over(by) + delay, F.min(frame).over(by))
    last = F.coalesce(F.min(F.when(F.col("__name").isin(*stop), f)).over(by), F.max(frame).over(by))
    active = own.withColumns({"__from": first, "__to": last}).where(f.between(F.col("__from"), F.col("__to")))
    apart = lambda c: F.struct(((F.col("__x") - c["x"]) ** 2 + (F.col("__y") - c["y"]) ** 2).alias("d2"), f.alias("f"))
    each = active.groupBy(play, obj).agg(
        F.min(F.array_min(F.transform("__held", apart)))["f"].alias("f"), F.collect_set(frame).alias("frames"), F.collect_set(F.when(F.col("__name").isin(*stop), f)).alias("stops")
    )
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    seen = each.groupBy(play).agg(F.collect_list(F.struct(F.col(obj).alias("o"), "f")).alias("__each"), every("frames").alias("__frames"), every("stops").alias("__stops"))
    out = asked.join(seen, play, "left").withColumns({
        "__near": F.get(F.filter("__each", lambda e: e["o"] == F.col(obj)), F.lit(0))["f"], "__n": F.size("__stops"), "__stop": F.array_min("__stops"), "__first": F.array_min("__frames")
    })
    made = F.when(F.col("__n") == 1, F.col("__stop"))
    event = F.col("__near") if closest else F.when(F.col("label") == 1, made).otherwise(F.col("__near"))
    out = out.withColumn("event_frame", event).withColumn("state_frame", F.col("event_frame") - back)
    early = (F.col("state_frame") <= 0) | ~F.array_contains("__frames", F.col("state_frame"))
    status = F.when(F.col("__first").isNull(), "missing_tracking").when(F.col("event_frame").isNull(), "missing_event").when(early, "too_early").otherwise("kept")
    examples = out.select(play, obj, "label", "event_frame", "state_frame", status.alias("status"))
    return {"examples": examples, "audit": examples.groupBy("status").agg(F.count("*").alias("candidates"))}


def state_before(rows: DataFrame, events: DataFrame, play: str, frame: str, event: str, back: int) -> DataFrame:
    """The rows of the frame ``back`` frames before each play's event, where that frame is over 0 (WIN-7). Plays meet once, and
    frames are compared as a difference, which is no key to deal rows by again."""
    at = events.select(play, (F.col(event) - back).alias("__at")).where(F.col("__at") > 0)
    return rows.join(at, play).where(F.col(frame) - F.col("__at") == 0).drop("__at")

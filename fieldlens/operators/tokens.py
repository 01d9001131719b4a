"""Object tokens of prediction examples: enrichment, encoding, role masks, typed edges, handoff and trajectory forms.

Tokens are long: one row per (example, time, slot); an absent row is a masked one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import contract, frames, geometry

# Position groups by position, columns that name teams, and task names.
POSITIONS = {
    "QB": "qb", "RB": "rb", "FB": "rb", "HB": "rb", "WR": "wr", "TE": "te", "C": "ol", "G": "ol", "OG": "ol", "OT": "ol", "T": "ol", "OL": "ol",
    "DE": "dl", "DT": "dl", "NT": "dl", "DL": "dl", "LB": "lb", "ILB": "lb", "MLB": "lb", "OLB": "lb", "CB": "db", "DB": "db", "FS": "db", "SS": "db", "S": "db",
    "K": "special", "P": "special", "LS": "special",
}
GROUPS = ["qb", "rb", "wr", "te", "ol", "dl", "lb", "db", "special", "other"]
TEAM_COLUMNS = ["possessionTeam", "defensiveTeam", "kickingTeam", "returnTeam", "homeTeamAbbr", "visitorTeamAbbr", "club", "team"]


# -- enrichment ----------------------------------------------------------------------------------------------


def with_players(rows: DataFrame, players: DataFrame, player: str) -> DataFrame:
    """Rows of known players with the players' columns; rows without a player (the ball) go (JN-4). Of several records of a
    player the least counts."""
    cols = [c for c in players.columns if c != player]
    one = players.where(F.col(player).isNotNull()).groupBy(player).agg(F.min(F.struct(*cols)).alias("__p")).select(player, *[F.col(f"__p.{c}").alias(c) for c in cols])
    return rows.join(one, player)


def with_plays(rows: DataFrame, plays: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their play's columns; of a column that both have the row's own value counts, the play's where that is null (JN-5)."""
    shared = [c for c in plays.columns if c in rows.columns and c not in keys]
    named = plays.select(*[F.col(c).alias(f"__play_{c}") if c in shared else F.col(c) for c in plays.columns])
    out = rows.join(named, keys)
    return out.withColumns({c: F.coalesce(c, f"__play_{c}") for c in shared}).drop(*[f"__play_{c}" for c in shared]) if shared else out


def with_games(examples: DataFrame, games: DataFrame, game: str, play: str, single_season: bool) -> DataFrame:
    """Examples with season (from the game's number where the games don't tell), week (-1 where unknown), example id and stratum (JN-7)."""
    known = games.select(game, *[F.col(c).cast("int").alias(f"__{c}") for c in ("season", "week") if c in games.columns])
    one = known.groupBy(game).agg(*[F.min(c).alias(c) for c in known.columns if c != game])
    out = examples.join(one, game, "left")
    season = F.coalesce(*[F.col("__season")] * ("season" in games.columns), F.floor(F.col(game) / 1_000_000).cast("int"))
    week = F.coalesce(*[F.col("__week")] * ("week" in games.columns), F.lit(-1))
    out = out.withColumns({"season": season, "week": week}).drop("__season", "__week")
    stratum = F.concat(F.lit("week_"), F.lpad(F.col("week").cast("string"), 2, "0")) if single_season else F.concat(F.lit("season_"), F.col("season").cast("string"))
    return out.withColumns({"example_id": F.concat_ws(":", F.col(game).cast("string"), F.col(play).cast("string")), "stratum": stratum})


def without_teams(context: DataFrame, keep: bool = False) -> DataFrame:
    """Context columns without those that name a team, unless they are to be kept (PRJ-14)."""
    return context if keep else context.drop(*TEAM_COLUMNS)


# -- encoding ------------------------------------------------------------------------------------------------


def encoded(
    rows: DataFrame, keys: list[str], obj: str, team: Column, possession: Column, position: Column, focal: Column | None = None,
    x: str = "x", y: str = "y", speed: str = "s", accel: str = "a", heading: str = "dir", facing: str = "o", direction: str = "playDirection", focal_position: str | None = None,
) -> DataFrame:
    """The channels of every object of every frame (GEO-6): position relative to the ball, velocity, speed, acceleration, heading and
    facing as (sin, cos), sides, ball, focal and position group, plus ``group``. Plays that run left are turned by half a turn; null speed
    and acceleration are 0, a null angle is (0, 0). ``team`` is ``football`` for the ball. With ``focal_position`` the least id of
    that position among the offense is focal (GEO-7). A frame without a ball has null relative positions, and frame_violations() names it; rows without position go."""
    w = Window.partitionBy(*keys)
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = r.withColumns({"__ball": F.coalesce(F.lower(team) == "football", F.lit(False)), "__team": team, "__pos": F.upper(F.trim(position))})
    r = r.withColumn("__left", F.coalesce(F.max(F.lower(F.col(direction))).over(w) == "left", F.lit(False)))
    px, py = geometry.rotate_left(F.col(x).cast("double"), F.col(y).cast("double"), F.col("__left"))
    r = r.withColumns({"__x": px, "__y": py, "__off": ~F.col("__ball") & F.coalesce(F.col("__team") == possession, F.lit(False))})
    ball = F.min(F.when(F.col("__ball"), F.struct("__x", "__y"))).over(w)
    own = F.lit(False) if focal is None else F.coalesce(focal, F.lit(False))
    if focal_position is not None:
        least = F.min(F.when(F.col("__off") & (F.col("__pos") == focal_position), F.col(obj))).over(w)
        own = F.coalesce(F.col(obj) == least, F.lit(False))
    (ds, dc), (os_, oc) = fn.angle_components(F.col(heading), F.col("__left")), fn.angle_components(F.col(facing), F.col("__left"))
    s, a = F.coalesce(F.col(speed).cast("double"), F.lit(0.0)), F.coalesce(F.col(accel).cast("double"), F.lit(0.0))
    group = F.when(~F.col("__ball"), fn.lookup(F.col("__pos"), POSITIONS, "other"))
    number = lambda c: c.cast("double")
    out = r.withColumn("__b", ball).select(
        *rows.columns, (F.col("__x") - F.col("__b.__x")).alias("x_rel"), (F.col("__y") - F.col("__b.__y")).alias("y_rel"), (s * dc).alias("vx"), (s * ds).alias("vy"), s.alias("speed"), a.alias("acceleration"),
        ds.alias("dir_sin"), dc.alias("dir_cos"), os_.alias("orientation_sin"), oc.alias("orientation_cos"), number(F.col("__off")).alias("offense"),
        number(~F.col("__ball") & ~F.col("__off")).alias("defense"), number(F.col("__ball")).alias("football"), number(own).alias("focal"), F.coalesce(group, F.lit("ball")).alias("group"),
    )
    return out.withColumns({f"position_{g}": (F.col("group") == g).cast("double") for g in GROUPS})


def frame_violations(rows: DataFrame, keys: list[str], obj: str, team: Column, x: str = "x", y: str = "y") -> DataFrame:
    """``rule, key`` of frames that encoded() can't make complete (GEO-6): no ball with a position, several balls, an object twice."""
    is_ball = F.coalesce(F.lower(team) == "football", F.lit(False)) & F.col(x).isNotNull() & F.col(y).isNotNull()
    rules = {"no_ball": F.count_if(is_ball) == 0, "several_balls": F.count_if(is_ball) > 1, "object_repeated": F.count(obj) > F.countDistinct(obj)}
    return contract.broken_groups(rows, keys, rules)


def frame_slots(tokens: DataFrame, keys: list[str], obj: str) -> DataFrame:
    """Adds ``slot``: the order within a frame where no play-wide one is given: ball, focal, offense, then id (WIN-9)."""
    order = [F.desc("football"), F.desc("focal"), F.desc("offense"), F.col(obj).asc_nulls_first()]
    return tokens.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def side_slots(rows: DataFrame, play: list[str], obj: str, offense: Column) -> DataFrame:
    """(play, obj, slot): offense first, then id, over the whole play (WIN-10, WIN-11)."""
    one = rows.groupBy(*play, obj).agg(F.max(offense.cast("int")).alias("__o"))
    return one.withColumn("slot", F.row_number().over(Window.partitionBy(*play).orderBy(F.desc("__o"), obj)) - 1).drop("__o")


def set_slots(rows: DataFrame, play: str, rusher: Column, offense: Column, x: str, y: str, obj: str) -> DataFrame:
    """Adds ``slot``: rusher, offense, defense, then y, then x (WIN-12); the id settles what is left."""
    kind = F.when(rusher, 0).when(offense, 1).otherwise(2)
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(play).orderBy(kind, y, x, obj)) - 1)


def assembled(examples: DataFrame, tokens: DataFrame, windows: DataFrame, slots: DataFrame, example: str, play: str, frame: str, obj: str) -> DataFrame:
    """The token table of examples (GEO-11): tokens of the frames of each play's window, at their time_index and slot. ``examples``:
    (example, play); ``slots``: (play, obj, slot)."""
    at = tokens.join(windows.select(play, frame, "time_index"), [play, frame]).join(slots.select(play, obj, "slot"), [play, obj])
    return examples.select(example, play).join(at, play)


def nested(tokens: DataFrame, example: str, channels: list[str]) -> DataFrame:
    """One row an example: its tokens as a sorted array of structs (time_index, slot, channels), for export (GEO-11)."""
    return tokens.groupBy(example).agg(F.array_sort(F.collect_list(F.struct("time_index", "slot", *channels))).alias("tokens"))


def returner_oriented(plays: DataFrame, direction: str, possession: str, home: str, away: str) -> DataFrame:
    """Plays seen from the returning side (GEO-8): the other way round, in possession of the other team."""
    turned = F.when(F.lower(direction) == "left", "right").when(F.lower(direction) == "right", "left").otherwise(F.col(direction))
    return plays.withColumns({direction: turned, possession: fn.other_side(F.col(possession), F.col(home), F.col(away))})


# -- roles and edges -----------------------------------------------------------------------------------------


def roles(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a boolean column ``is_<role>`` for each role that tasks name, from the channels (carrier is optional)."""
    on = lambda c: F.coalesce(F.col(c).cast("double") > 0.5, F.lit(False))
    base = {r: on(r) for r in ("offense", "defense", "football", "focal")} | {"carrier": on("carrier") if "carrier" in tokens.columns else F.lit(False)}
    out = tokens.withColumns({f"is_{r}": c for r, c in base.items()})
    is_ = lambda r: F.col(f"is_{r}")
    group = lambda *g: F.col("group").isin(*g)
    attack = F.max(is_("focal") & is_("offense")).over(Window.partitionBy(*keys))
    more = {
        "eligible": group("wr", "te", "rb"), "protector": group("ol", "rb", "te"), "rusher": is_("defense") & group("dl", "lb"), "coverage": is_("defense") & ~group("dl", "lb"),
        "blocker": is_("offense") & ~is_("focal"), "free_blocker": is_("offense") & ~is_("carrier"), "help": is_("defense") & ~is_("focal"),
        "teammate": F.when(attack, is_("offense")).otherwise(is_("defense")) & ~is_("focal"), "opponent": F.when(attack, is_("defense")).otherwise(is_("offense")),
        "pursuit": is_("focal") | (is_("defense") & ~is_("focal")),
    }
    return out.withColumns({f"is_{r}": c for r, c in more.items()})


# The names and role pairs of each task.
#: By task: the roles that are nodes, and the edges (name, role, role or None for within one role); a later edge overrides.
TASKS: dict[str, tuple[list[str], list[tuple[str, str, str | None]]]] = {
    "completion": (
        ["focal", "eligible", "defense", "football"],
        [("receiver_receiver", "eligible", None), ("receiver_defender", "eligible", "defense"), ("quarterback_receiver", "focal", "eligible")],
    ),
    "rushing": (
        ["focal", "offense", "defense", "football"],
        [
            ("same_team_lane", "blocker", None), ("same_team_lane", "defense", None), ("returner_blocker", "focal", "blocker"), ("returner_coverer", "focal", "defense"),
            ("blocker_coverer", "blocker", "defense"),
        ],
    ),
    "sack": (
        ["focal", "protector", "eligible", "defense", "football"],
        [
            ("protector_rusher", "protector", "rusher"), ("quarterback_protector", "focal", "protector"), ("quarterback_rusher", "focal", "rusher"),
            ("receiver_coverage", "eligible", "coverage"),
        ],
    ),
    "tackle": (
        ["focal", "carrier", "offense", "defense", "football"],
        [
            ("same_team_influence", "free_blocker", None), ("same_team_influence", "pursuit", None), ("blocker_candidate", "focal", "free_blocker"),
            ("blocker_carrier", "free_blocker", "carrier"), ("help_carrier", "help", "carrier"), ("candidate_carrier", "focal", "carrier"),
        ],
    ),
    "man_zone": (
        ["focal", "eligible", "defense", "football"],
        [
            ("defender_defender", "defense", None), ("receiver_receiver", "eligible", None), ("receiver_defender", "eligible", "defense"),
            ("quarterback_receiver", "focal", "eligible"),
        ],
    ),
    "trajectory": (
        ["focal", "teammate", "opponent"],
        [
            ("same_side_social", "teammate", None), ("same_side_social", "opponent", None), ("opposing_side_social", "teammate", "opponent"),
            ("focal_teammate", "focal", "teammate"), ("focal_opponent", "focal", "opponent"),
        ],
    ),
}
TASKS["punt_return"] = TASKS["rushing"]


def active_tokens(tokens: DataFrame, keys: list[str], task: str, ablation: str | None = None) -> DataFrame:
    """The tokens that are nodes of a task's graph (FEAT-5). Ablations (FEAT-7): ``pair_only`` keeps focal and carrier,
    ``no_social`` the focal object, ``snapshot`` the last frame (keys end with the time). The tackle task needs a ``carrier`` column."""
    if task == "tackle" and "carrier" not in tokens.columns:
        raise ValueError("the tackle task needs a carrier column")
    out = roles(tokens, keys)
    rule = F.lit(False)
    for r in TASKS[task][0]:
        rule = rule | F.col(f"is_{r}")
    if task == "trajectory":
        rule = rule & ~F.col("is_football")
    if ablation == "pair_only":
        rule = rule & (F.col("is_focal") | F.col("is_carrier"))
    if ablation == "no_social":
        rule = rule & F.col("is_focal")
    out = out.where(rule)
    if ablation == "snapshot":
        out = out.withColumn("__t", F.max(keys[-1]).over(Window.partitionBy(*keys[:-1]))).where(F.col(keys[-1]) == F.col("__t")).drop("__t")
    return out


def typed_edges(tokens: DataFrame, keys: list[str], obj: str, task: str, ablation: str | None = None) -> DataFrame:
    """``keys, target, source, edge`` for every ordered pair of a frame's active tokens (FEAT-6); pairs that no rule names are
    ``none``. Ablations (FEAT-7): as active_tokens(), and ``drop_blocker_coverer`` takes these edges out, ``collapse`` names all
    ``generic_relation``. A frame's tokens meet in one row, so there is one shuffle and no self-join."""
    nodes, rules = TASKS[task]
    used = sorted({r for _, a, b in rules for r in (a, b) if r})
    active = active_tokens(tokens, keys, task, ablation if ablation in ("pair_only", "no_social", "snapshot") else None)
    frame = active.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(obj).alias("o"), *[F.col(f"is_{r}").alias(r) for r in used]))).alias("f"))
    pairs = frame.withColumn("t", F.explode("f")).withColumn("s", F.explode("f")).where(F.col("t.o") != F.col("s.o"))
    name = F.lit("none")
    for edge, a, b in rules:
        t, s = (lambda r: F.col(f"t.{r}")), (lambda r: F.col(f"s.{r}"))
        holds = t(a) & s(a) if b is None else (t(a) & s(b)) | (t(b) & s(a))
        name = F.when(holds, edge).otherwise(name)
    if ablation == "collapse":
        name = F.lit("generic_relation")
    out = pairs.select(*keys, F.col("t.o").alias("target"), F.col("s.o").alias("source"), name.alias("edge"))
    return out.where("edge <> 'blocker_coverer'") if ablation == "drop_blocker_coverer" else out


def side_distances(tokens: DataFrame, example: str, time: str) -> DataFrame:
    """Distances between the sides and from the focal object (FEAT-2): at the last frame min, mean and deviation across sides and
    min and mean from the focal object to either side; over frames the mean of the minima, their change and the mean of the means."""
    p = F.struct("x_rel", "y_rel", (F.col("focal") > 0.5).alias("f"))
    held = lambda side: F.collect_list(F.when(F.col(side) > 0.5, p))
    frame = tokens.groupBy(example, time).agg(held("offense").alias("o"), held("defense").alias("d"), F.collect_list(F.when(F.col("focal") > 0.5, p)).alias("f"))
    away = lambda a, b: F.sqrt((a["x_rel"] - b["x_rel"]) ** 2 + (a["y_rel"] - b["y_rel"]) ** 2)
    cross = F.flatten(F.transform("o", lambda a: F.transform("d", lambda b: away(a, b))))
    frame = frame.withColumn("m", fn.moments(cross)).withColumn("lo", F.array_min(cross))
    one = F.when(F.size("f") == 1, F.get("f", F.lit(0)))
    columns = {}
    for side in ("o", "d"):
        far = F.transform(F.filter(F.col(side), lambda b: ~b["f"]), lambda b: away(one, b))
        columns |= {f"f_{side}_min": F.array_min(far), f"f_{side}_mean": F.when(F.size(far) > 0, fn.total(far) / F.size(far))}
    frame = frame.withColumns(columns).withColumns({"mid": F.when(F.col("m.n") > 0, F.col("m.mean")), "sd": F.when(F.col("m.n") > 0, F.sqrt(F.col("m.m2") / F.col("m.n")))})
    last = lambda c: F.max_by(c, time)
    seen = F.when(F.col("lo").isNotNull(), F.col(time))
    return frame.groupBy(example).agg(
        last("lo").alias("cross_min"), last("mid").alias("cross_mean"), last("sd").alias("cross_sd"), last("f_o_min").alias("focal_offense_min"), last("f_o_mean").alias("focal_offense_mean"),
        last("f_d_min").alias("focal_defense_min"), last("f_d_mean").alias("focal_defense_mean"), F.avg("lo").alias("mean_of_min"),
        (F.max_by("lo", seen) - F.min_by("lo", seen)).alias("change_of_min"), F.avg("mid").alias("mean_of_mean"),
    )


def combined(context: DataFrame, summaries: list[DataFrame], example: str, keep_teams: bool = False) -> DataFrame:
    """One feature row an example: allowed context and summaries (FEAT-4); columns of the same name are an error."""
    out = without_teams(context, keep_teams)
    for s in summaries:
        if both := sorted((set(out.columns) & set(s.columns)) - {example}):
            raise ValueError(f"columns collide: {', '.join(both)}")
        out = out.join(s, example, "left")
    return out


# -- handoff snapshots ---------------------------------------------------------------------------------------


def handoff_geometry(rows: DataFrame, offense: Column, early: Column, x: str, y: str, speed: str, step: str, heading: str, left: Column, unit: bool = False, facing: str | None = None) -> DataFrame:
    """Adds ``x_std, y_std, speed_std, dir_std, sx, sy`` (GEO-4): left plays turned, the early season's speed from its steps (ten a
    second), direction in radians from the x axis; a missing one is 0 for the offense and pi for the defense. With ``unit`` also ``dir_cos,
    dir_sin``, and from ``facing`` ``face_cos, face_sin``, which are 0 where it is missing (GEO-5)."""
    px, py = geometry.rotate_left(F.col(x).cast("double"), F.col(y).cast("double"), left)
    turn = F.radians(F.pmod(90.0 - F.col(heading), F.lit(360.0)))
    turn = F.when(left, F.pmod(turn + math.pi, F.lit(2 * math.pi))).otherwise(turn)
    turn = F.coalesce(turn, F.when(offense, 0.0).otherwise(math.pi))
    v = F.when(early, 10 * F.col(step)).otherwise(F.col(speed)).cast("double")
    out = rows.withColumns({"x_std": px, "y_std": py, "speed_std": v, "dir_std": turn}).withColumns({"sx": F.col("speed_std") * F.cos("dir_std"), "sy": F.col("speed_std") * F.sin("dir_std")})
    if unit:
        out = out.withColumns({"dir_cos": F.cos("dir_std"), "dir_sin": F.sin("dir_std")})
    if facing:
        sine, cosine = fn.angle_components(F.col(facing), left)
        out = out.withColumns({"face_cos": cosine, "face_sin": sine})
    return out


def against_rusher(rows: DataFrame, play: str, rusher: Column) -> DataFrame:
    """Adds the rusher's position and velocity minus each player's: ``dx, dy, dsx, dsy`` (GEO-16)."""
    w = Window.partitionBy(play)
    own = lambda c: F.max(F.when(rusher, F.col(c))).over(w) - F.col(c)
    return rows.withColumns({"dx": own("x_std"), "dy": own("y_std"), "dsx": own("sx"), "dsy": own("sy")})


def pair_grid(rows: DataFrame, play: str, obj: str, rusher: Column, offense: Column) -> DataFrame:
    """The ten channels of every defender and blocker of a play (GEO-15): blocker minus defender in velocity and position, rusher minus
    defender in both, the defender's velocity. A play's players meet in one row."""
    p = F.struct(F.col(obj).alias("o"), "x_std", "y_std", "sx", "sy", "dx", "dy", "dsx", "dsy")
    held = rows.groupBy(play).agg(F.collect_list(F.when(~offense, p)).alias("d"), F.collect_list(F.when(offense & ~rusher, p)).alias("b"))
    each = held.withColumn("d", F.explode("d")).withColumn("b", F.explode("b"))
    return each.select(
        play, F.col("d.o").alias("defender"), F.col("b.o").alias("blocker"), *[(F.col(f"b.{c}") - F.col(f"d.{c}")).alias(f"c{i}") for i, c in enumerate(("sx", "sy", "x_std", "y_std"))],
        *[F.col(f"d.{c}").alias(f"c{i}") for i, c in enumerate(("dsx", "dsy", "dx", "dy", "sx", "sy"), 4)],
    )


def rushing_arrays(rows: DataFrame, play: str, obj: str, rusher: Column, offense: Column, **geometry_roles) -> dict[str, DataFrame]:
    """The long forms of a handoff's arrays (PIPE-9): ``grid`` of pairs, ``summary`` (40 columns a play, AGG-14) and ``tokens`` in set order."""
    std = against_rusher(handoff_geometry(rows, offense, **geometry_roles), play, rusher)
    grid = pair_grid(std, play, obj, rusher, offense)
    return {"grid": grid, "summary": geometry.pair_grid_summary(grid, play, [f"c{i}" for i in range(10)]), "tokens": set_slots(std, play, rusher, offense, "x_std", "y_std", obj)}


# -- trajectories --------------------------------------------------------------------------------------------


def multi_focal(tokens: DataFrame, focals: DataFrame, play: str, frame: str, obj: str, x: str, y: str) -> DataFrame:
    """Each play's tokens for each of its requested players (JN-13), with positions relative to that player in the same frame and
    ``focal`` (GEO-9): ``focals`` is (play, obj). Frames without the focal player have no rows."""
    own = tokens.select(play, frame, F.col(obj).alias("focal_obj"), F.col(x).alias("__fx"), F.col(y).alias("__fy"))
    own = own.join(focals.select(play, F.col(obj).alias("focal_obj")).distinct(), [play, "focal_obj"], "left_semi")
    out = tokens.join(own, [play, frame])
    return out.withColumns({"x_rel": F.col(x) - F.col("__fx"), "y_rel": F.col(y) - F.col("__fy"), "focal": (F.col(obj) == F.col("focal_obj")).cast("double")}).drop("__fx", "__fy")


def aligned_targets(examples: DataFrame, outputs: DataFrame, keys: list[str], frame: str, horizon: str) -> DataFrame:
    """Target points of examples by zero-based horizon index, with ``complete``: whether the example's frames are exactly 1 to its
    ``horizon`` (GEO-12, AGG-7)."""
    w = Window.partitionBy(*keys)
    at = outputs.join(examples.select(*keys, horizon), keys)
    once = F.size(F.collect_set(frame).over(w))
    full = (F.count("*").over(w) == F.col(horizon)) & (F.min(frame).over(w) == 1) & (F.max(frame).over(w) == F.col(horizon)) & (once == F.col(horizon))
    return at.withColumns({"index": F.col(frame) - 1, "complete": full}).drop(horizon)


def trajectory_context(final: DataFrame, left: Column, x: str, y: str, land_x: str, land_y: str, height: str, heading: str, facing: str, length: float = 120.0) -> DataFrame:
    """The tabular features of a focal player's last frame (GEO-13): where the ball will land relative to the player, height in inches,
    heading and facing (degrees from the x axis) as sine and cosine."""
    there = F.when(left, length - F.col(land_x)).otherwise(F.col(land_x))
    return final.withColumns({
        "ball_land_x_rel": there - F.col(x), "ball_land_y_rel": F.col(land_y) - F.col(y), "height_inches": fn.feet_inches(F.col(height)),
        "dir_sin": F.sin(F.radians(heading)), "dir_cos": F.cos(F.radians(heading)), "orientation_sin": F.sin(F.radians(facing)), "orientation_cos": F.cos(F.radians(facing)),
    })


def trajectory_cohort(inputs: DataFrame, outputs: DataFrame, play: str, frame: str, obj: str, requested: Column, offense: Column, left: Column, hz: float = 10.0) -> dict[str, DataFrame]:
    """Paths to predict from paired input and output tables (PIPE-7): ``examples`` (play, obj, horizon, last frame, state), ``tokens``
    (relative to each requested player, at play-wide slots), ``targets`` by horizon with ``complete``, ``baseline`` at constant velocity, and
    ``mismatches`` (keys that only one table asks for). Inputs hold x, y, s, dir and num_frames_output."""
    g = geometry.reflect_left(F.col("x").cast("double"), F.col("dir"), F.col("s").cast("double"), left)
    std = inputs.withColumns({"__x": g["x"], "__vx": g["vx"], "__vy": g["vy"], "__d": g["dir"]}).withColumns({"x": F.col("__x"), "vx": F.col("__vx"), "vy": F.col("__vy"), "dir": F.col("__d")})
    std = std.drop("__x", "__vx", "__vy", "__d")
    asked = std.where(requested)
    keys = [play, obj]
    final = frames.final_state(asked, keys, frame, ["x", "y", "vx", "vy", "num_frames_output"])
    examples = final.withColumnRenamed("num_frames_output", "horizon")
    steps = examples.withColumn("t", F.explode(F.sequence(F.lit(1), F.col("horizon").cast("int"))))
    baseline = steps.select(*keys, "t", (F.col("x") + F.col("t") / hz * F.col("vx")).alias("px"), (F.col("y") + F.col("t") / hz * F.col("vy")).alias("py"))
    slots = side_slots(std, [play], obj, offense)
    tokens = multi_focal(std.join(slots, keys), examples.select(*keys), play, frame, obj, "x", "y")
    got, want = outputs.select(*keys).distinct(), examples.select(*keys)
    mismatches = want.join(got, keys, "left_anti").withColumn("side", F.lit("input")).unionByName(got.join(want, keys, "left_anti").withColumn("side", F.lit("output")))
    return {"examples": examples, "tokens": tokens, "targets": aligned_targets(examples, outputs, keys, frame, "horizon"), "baseline": baseline, "mismatches": mismatches}

"""Registered queries of cohorts, validation samples and raster scalers."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import design, encode, frames, geometry, tokens
from fieldlens.plans import bindings as b
from fieldlens.plans import pipelines
from fieldlens.plans.queries import _ORDER, _SPLITS, _splits, query, r, rounded

# -- handoff cohort ------------------------------------------------------------------------------------------

_SIZE = 4


def _handoffs(spark, sf):
    """Snapshots from first lines: play = eight orders; home are the first four; the ball carrier is the least order."""
    from pyspark.sql import Window

    s = b.scrum(spark, sf).where("frame = 1")
    w = Window.partitionBy("play")
    rows = s.select(
        "play", "obj", F.min("obj").over(w).alias("rusher"), F.when(F.col("obj") % 8 < 4, "home").otherwise("away").alias("side"), "x", "y", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("a", F.lit(0.0)).alias("dis"),
        F.when(F.col("obj") % 11 > 0, F.col("dir")).alias("dir"), "o", "playDirection", (F.col("play") % 4 + 2016).alias("season"), (F.col("play") % 61 - 30).alias("yards"),
        (F.col("play") % 50 + 1).alias("yardLine"), (F.col("play") % 3 == 0).alias("own"), (F.col("play") % 30).alias("homeScore"), (F.col("play") % 17).alias("visitorScore"),
        F.concat(F.lpad((F.col("play") % 15).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("play") % 60).cast("string"), 2, "0")).alias("clock"),
    )
    rules = {"constant": ["season", "playDirection"], "finite": ["x", "y"], "finite_if_there": ["dir", "o"], "whole": ["yards"], "domains": {"season": [2017, 2018, 2019]}}
    return pipelines.handoff_cohort(
        rows, "play", "obj", "rusher", "side", ["home", "away"], "yards", -20, 20, "yardLine", F.col("own"), {"home": "homeScore", "away": "visitorScore"}, "clock", F.col("play") % 3 > 0, rules, _SIZE,
        early=F.col("season") == 2017, x="x", y="y", speed="s", step="dis", heading="dir", left=F.col("playDirection") == "left", facing="o",
    )


_SNAPSHOT = f"""{b.SCRUM}, rw AS (SELECT play, obj, min(obj) OVER (PARTITION BY play) AS rusher, CASE WHEN obj % 8 < 4 THEN 'home' ELSE 'away' END AS side, x, y, coalesce(s, 0) AS s, coalesce(a, 0) AS dis,
    CASE WHEN obj % 11 > 0 THEN dir END AS dir, o, "playDirection" = 'left' AS lft, play % 4 + 2016 AS season, play % 61 - 30 AS yards FROM scrum WHERE frame = 1),
  ld AS (SELECT *, CASE WHEN obj = rusher THEN side END AS lead_side FROM rw),
  st AS (SELECT play, count(*) AS n, count(DISTINCT obj) AS objects, max(lead_side) AS on_side, count_if(side = 'home') AS home, count_if(side = 'away') AS away, any_value(season) AS season FROM ld GROUP BY play),
  why AS (SELECT play, least(CASE WHEN n <> {_SIZE} THEN 'rows' END, CASE WHEN objects <> {_SIZE} THEN 'objects' END, CASE WHEN (CASE on_side WHEN 'home' THEN home ELSE away END) * 2 <> {_SIZE} THEN 'sides' END,
    CASE WHEN season = 2016 THEN 'season_domain' END) AS reason FROM st),
  kp AS (SELECT play FROM why WHERE reason IS NULL),
  ex AS (SELECT play, greatest(least(play % 61 - 30, 20), -20) + 20 AS label, play % 3 > 0 AS train, CASE WHEN play % 50 + 1 = 50 THEN 50 WHEN play % 3 = 0 THEN play % 50 + 1 ELSE 100 - (play % 50 + 1) END AS yards_from_own_goal,
    CASE WHEN on_side = 'home' THEN play % 30 ELSE play % 17 END AS offense_score, CASE WHEN on_side = 'home' THEN play % 17 ELSE play % 30 END AS defense_score, (play % 15) * 60 + play % 60 AS clock_seconds FROM kp JOIN st USING (play)),
  bs AS (SELECT k, count_if(label <= k) / count(*) AS base FROM ex, range(41) AS g(k) WHERE train GROUP BY k)"""


@query(f"WITH {_SNAPSHOT} SELECT coalesce(reason, 'kept') AS status, count(*) AS plays FROM why GROUP BY ALL")
def pipe1_audit(spark, sf):
    return _handoffs(spark, sf)["audit"]


@query(f"""WITH {_SNAPSHOT} SELECT play, cast(label AS INTEGER) AS label, yards_from_own_goal, offense_score, defense_score, offense_score - defense_score AS lead, cast(clock_seconds AS DOUBLE) AS clock_seconds, train,
  (SELECT {r('sum(base)', 'x')[:-5]} FROM bs) AS baseline_sum FROM ex""")
def pipe1_examples(spark, sf):
    e = _handoffs(spark, sf)["examples"]
    return rounded(e.withColumn("baseline_sum", fn.total(F.col("baseline"))).drop("baseline").withColumn("clock_seconds", F.col("clock_seconds").cast("double")))


@query(f"""WITH {_SNAPSHOT}, tk AS (SELECT w.*, side = on_side AS offense, CASE WHEN lft THEN 120 - x ELSE x END AS x_std, CASE WHEN lft THEN 160.0::DOUBLE / 3 - y ELSE y END AS y_std,
    CASE WHEN season = 2017 THEN 10 * dis ELSE s END AS speed_std, CASE WHEN lft THEN -1 ELSE 1 END AS sg FROM rw w JOIN kp USING (play) JOIN (SELECT play, on_side FROM st) USING (play))
  SELECT play, obj, row_number() OVER (PARTITION BY play ORDER BY NOT offense, obj) - 1 AS slot, {r('x_std', 'x_std', 7)}, {r('y_std', 'y_std', 7)}, {r('speed_std', 'speed_std', 7)},
    {r('CASE WHEN dir IS NULL THEN CASE WHEN offense THEN 1 ELSE -1 END ELSE sg * cos(radians(((90 - dir) % 360 + 360) % 360)) END', 'dir_cos', 7)}, {r('CASE WHEN dir IS NULL THEN 0 ELSE sg * sin(radians(((90 - dir) % 360 + 360) % 360)) END', 'dir_sin', 7)},
    {r('coalesce(sg * cos(radians(((90 - o) % 360 + 360) % 360)), 0)', 'face_cos', 7)}, {r('coalesce(sg * sin(radians(((90 - o) % 360 + 360) % 360)), 0)', 'face_sin', 7)} FROM tk""")
def pipe1_tokens(spark, sf):
    t = _handoffs(spark, sf)["tokens"]
    return rounded(t.select("play", "obj", F.col("slot").cast("long").alias("slot"), "x_std", "y_std", "speed_std", "dir_cos", "dir_sin", "face_cos", "face_sin"), 7)


@query(f"""WITH {_SNAPSHOT} SELECT play, cast(k AS INTEGER) AS k, {r('k / 40.0::DOUBLE', 't')}, {r('sqrt(k / 40.0::DOUBLE)', 'root')}, {r('(k / 40.0::DOUBLE) ** 2', 'square')}, {r('base', 'base')}, {r('(label <= k)::INTEGER - base', 'residual')}
  FROM ex, bs WHERE k < 40""")
def pipe1_thresholds(spark, sf):
    return rounded(_handoffs(spark, sf)["thresholds"])


# -- marker cohorts ------------------------------------------------------------------------------------------


def _cohort_sql(name: str, unique: bool, k: int) -> str:
    status = "CASE WHEN n IS NULL THEN 'no_marker' " + ("WHEN n > 1 THEN 'ambiguous' " if unique else "") + "ELSE 'kept' END"
    rows = "(SELECT * FROM marks WHERE value > 120)" if unique else "marks"
    return f"""{b.MARKS}, el AS (SELECT DISTINCT play, play % 5 <> 0 AS ok FROM marks), hit AS (SELECT play, count(DISTINCT frame) AS n, min(frame) AS cutoff FROM {rows} JOIN el USING (play) WHERE marker = '{name}' AND ok GROUP BY play),
  stt AS (SELECT play, CASE WHEN ok THEN {status} ELSE 'not_eligible' END AS status, cutoff FROM el LEFT JOIN hit USING (play)), kept AS (SELECT play, cutoff FROM stt WHERE status = 'kept')"""


def _marked(spark, sf, name: str, label, k: int, unique: bool = False):
    m = b.marks(spark, sf).withColumn("marker", F.when(F.col("value") > (120 if unique else -1), F.col("marker")))  # only dear events are marked
    return pipelines.marker_cohort(m.select("play").distinct(), m, "play", "frame", "marker", F.col("play") % 5 != 0, label, [name], k, unique)


def _examples(c):
    return c["examples"].select("play", "label", "cutoff", "history", "padding")


@query(f"WITH {_cohort_sql('purchase', True, 40)} SELECT status, count(*) AS plays FROM stt GROUP BY ALL")
def pipe3_unique_marker_audit(spark, sf):
    """A cohort cut at the only marker of its kind, forty frames: plays by status."""
    return _marked(spark, sf, "purchase", (F.col("play") % 2).cast("int"), 40, True)["audit"]


@query(f"WITH {_cohort_sql('purchase', True, 40)} SELECT play, cast(play % 2 AS INTEGER) AS label, cutoff, least(cutoff, 40)::BIGINT AS history, (40 - least(cutoff, 40))::BIGINT AS padding FROM kept")
def pipe3_unique_marker_examples(spark, sf):
    return _examples(_marked(spark, sf, "purchase", (F.col("play") % 2).cast("int"), 40, True))


@query(f"""WITH {_cohort_sql('purchase', True, 40)}, d AS (SELECT play, CASE WHEN play % 3 = 0 THEN 'left' WHEN play % 3 = 1 THEN 'RIGHT' ELSE 'up' END AS way, CASE WHEN play % 2 = 0 THEN 'A' ELSE 'B' END AS ball FROM kept)
  SELECT play, CASE lower(way) WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' ELSE way END AS way, CASE ball WHEN 'A' THEN 'B' ELSE 'A' END AS ball FROM d""")
def geo8_returner_oriented(spark, sf):
    e = _marked(spark, sf, "purchase", (F.col("play") % 2).cast("int"), 40, True)["examples"]
    way = F.when(F.col("play") % 3 == 0, "left").when(F.col("play") % 3 == 1, "RIGHT").otherwise("up")
    e = e.select("play", way.alias("way"), F.when(F.col("play") % 2 == 0, "A").otherwise("B").alias("ball"), F.lit("A").alias("home"), F.lit("B").alias("away"))
    return tokens.returner_oriented(e, "way", "ball", "home", "away").select("play", "way", "ball")


@query(f"WITH {_cohort_sql('signup', False, 1)} SELECT m.play, m.frame, 0 AS time_index, cast(play % 4 = 1 AS INTEGER) AS label FROM kept JOIN marks m USING (play) WHERE m.frame = cutoff")
def pipe4_snap_tokens(spark, sf):
    """The one frame of a snap with its label; columns known only after it are refused."""
    c = _marked(spark, sf, "signup", (F.col("play") % 4 == 1).cast("int"), 1)
    t = frames.forbid(c["tokens"].select("play", "frame", "time_index"), {"value_after"})
    return t.join(c["examples"].select("play", "label"), "play").withColumn("time_index", F.col("time_index").cast("int")).select("play", "frame", "time_index", "label")


@query(f"WITH {_cohort_sql('error', False, 10)} SELECT play, play % 3 = 1 AS label, cutoff, least(cutoff, 10)::BIGINT AS history, (10 - least(cutoff, 10))::BIGINT AS padding FROM kept")
def pipe6_loose_label_examples(spark, sf):
    """A label that is told as loose text."""
    text = F.when(F.col("play") % 3 == 1, "TRUE").otherwise("0")
    return _examples(_marked(spark, sf, "error", fn.loose_boolean(text), 10))


@query(f"""WITH {b.SCRUM}, fr AS (SELECT play, frame, count_if(team = 'football' AND x IS NOT NULL) AS balls, count(obj) - count(DISTINCT obj) AS again FROM scrum GROUP BY ALL)
  SELECT 'no_ball' AS rule, concat_ws(':', play, frame) AS key FROM fr WHERE balls = 0 UNION ALL SELECT 'several_balls', concat_ws(':', play, frame) FROM fr WHERE balls > 1
  UNION ALL SELECT 'object_repeated', concat_ws(':', play, frame) FROM fr WHERE again > 0""")
def geo6_frame_violations(spark, sf):
    return tokens.frame_violations(b.scrum(spark, sf), ["play", "frame"], "obj", F.col("team"))


# -- samples and scalers -------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_SPLITS}, {_ORDER}, o2 AS (SELECT o.repeat, n_train, game, o.stratum FROM ord o JOIN games USING (game), (SELECT unnest([20, 40, 80]) AS n_train) WHERE train_order <= n_train),
  cp AS (SELECT repeat, n_train, stratum, count(*) AS c, sum(count(*)) OVER (PARTITION BY repeat, n_train) AS g FROM o2 GROUP BY repeat, n_train, stratum),
  wt AS (SELECT *, least(greatest(ceil(g * 0.2::DOUBLE - 1e-9), 1), g - 1)::BIGINT AS w FROM cp),
  fl AS (SELECT *, w * c // g::BIGINT AS base, w * c % g::BIGINT AS rest FROM wt),
  al AS (SELECT *, base + (row_number() OVER (PARTITION BY repeat, n_train ORDER BY rest DESC, stratum) <= w - sum(base) OVER (PARTITION BY repeat, n_train))::INTEGER AS a FROM fl),
  rk AS (SELECT o2.*, row_number() OVER (PARTITION BY repeat, n_train, stratum ORDER BY sha256(concat_ws('|', game, 'validation', 5)), game) AS place FROM o2)
  SELECT cast(repeat AS INTEGER) AS repeat, n_train, game, stratum, place <= a AS validation FROM rk JOIN al USING (repeat, n_train, stratum)""")
def des12_validation_games(spark, sf):
    """A fifth of the games of every training prefix, by stratum."""
    t = design.nested_anchors(design.balanced_order(_splits(spark, sf).where("role = 'train'"), ["repeat"], "game", "stratum", "place"), [20, 40, 80])
    return design.validation_sample(t, ["repeat", "n_train"], "game", "stratum", 0.2, 5).select("repeat", "n_train", "game", "stratum", "validation")


def _raster(spark, sf):
    t = b.tracking(spark, sf)
    cells = geometry.raster(t, ["play", "frame"], "x", "y", {"off": F.col("offense")}, ["s", "x"], (30, 14), 4.0)
    return cells.withColumn("half", F.col("play") % 2)


_CELLS = f"""{b.TRACKING}, cl AS (SELECT play, frame, play % 2 AS half, cast(least(greatest(floor(x / 4), 0), 29) AS INTEGER) AS xbin, cast(least(greatest(floor(y / 4), 0), 13) AS INTEGER) AS ybin, avg(s) AS ms, avg(x) AS mx FROM tracking GROUP BY ALL),
  sc AS (SELECT half, count(*) AS n, avg(ms) AS ms_mean, stddev_pop(ms) AS ms_sd, avg(mx) AS mx_mean, stddev_pop(mx) AS mx_sd, count(*) / (count(DISTINCT (play, frame)) * 420) AS fill FROM cl WHERE play % 5 > 0 GROUP BY half)"""


@query(f"WITH {_CELLS} SELECT half, n, {r('ms_mean', 'mean_s_mean')}, {r('ms_sd', 'mean_s_sd')}, {r('mx_mean', 'mean_x_mean')}, {r('mx_sd', 'mean_x_sd')}, {r('fill', 'fill')} FROM sc")
def enc5_raster_scaler(spark, sf):
    return rounded(encode.raster_scaler(_raster(spark, sf), ["half"], F.col("play") % 5 > 0, ["mean_s", "mean_x"], F.countDistinct("play", "frame"), (30, 14)))


@query(f"WITH {_CELLS} SELECT play, frame, xbin, ybin, {r('(ms - ms_mean) / CASE WHEN ms_sd > 1e-8 THEN ms_sd ELSE 1 END', 'z_mean_s', 7)}, {r('(mx - mx_mean) / CASE WHEN mx_sd > 1e-8 THEN mx_sd ELSE 1 END', 'z_mean_x', 7)} FROM cl JOIN sc USING (half)")
def enc5_scaled_raster(spark, sf):
    cells = _raster(spark, sf)
    s = encode.raster_scaler(cells, ["half"], F.col("play") % 5 > 0, ["mean_s", "mean_x"], F.countDistinct("play", "frame"), (30, 14))
    return rounded(encode.scaled_raster(cells, s, ["half"], ["mean_s", "mean_x"]).select("play", "frame", "xbin", "ybin", "z_mean_s", "z_mean_x"), 7)

"""Registered queries of tackle features, cell evaluation, tokens, handoffs and trajectories, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import cells, cohort, conformal, design, encode, frames, inference, models, panel, scores, tackle, tokens
from fieldlens.plans import bindings as b
from fieldlens.plans import pipelines
from fieldlens.plans import queries as q
from fieldlens.plans.queries import query, r, rounded

# -- tackle features -----------------------------------------------------------------------------------------

_STATE = """st AS (SELECT *, radians(dir) AS t, s * cos(radians(dir)) AS vx, s * sin(radians(dir)) AS vy, least(greatest(x, 0), 120) AS cx, least(greatest(y, 0), 53) AS cy FROM scrum),
  car AS (SELECT play, frame, min(obj) AS obj, min(x) AS x, min(y) AS y, min(s) AS s, min(vx) AS vx, min(vy) AS vy, min(cx) AS cx, min(cy) AS cy FROM st WHERE carrier GROUP BY play, frame HAVING count(*) = 1)"""


def _felt(p: str, x: str, y: str) -> str:
    """Influence of player ``p`` at (x, y): a Gaussian along its heading."""
    u = f"(({x} - {p}.x - 0.5 * {p}.vx) * cos({p}.t) + ({y} - {p}.y - 0.5 * {p}.vy) * sin({p}.t))"
    v = f"(({y} - {p}.y - 0.5 * {p}.vy) * cos({p}.t) - ({x} - {p}.x - 0.5 * {p}.vx) * sin({p}.t))"
    al, ac = f"((3 + 3 * {p}.s / 18) / 2)", f"((3 - 3 * {p}.s / 18) / 2)"
    return f"exp(-0.5 * (({u} / {al}) ** 2 + ({v} / {ac}) ** 2)) / (2 * pi() * {al} * {ac})"


_FEATURES = f"""{b.SCRUM}, {_STATE},
  ti AS (SELECT c.play, c.frame, coalesce(sum({_felt('p', 'c.cx', 'c.cy')}) FILTER (p.team = 'red' AND NOT p.carrier), 0) - coalesce(sum({_felt('p', 'c.cx', 'c.cy')}) FILTER (p.team = 'blue'), 0) AS team_influence,
    max(p.run::INTEGER)::DOUBLE AS is_run FROM car c JOIN st p ON p.play = c.play AND p.frame = c.frame GROUP BY ALL),
  site AS (SELECT c.play, c.frame, p.cx AS x, p.cy AS y FROM car c JOIN st p ON p.play = c.play AND p.frame = c.frame AND NOT p.carrier
    UNION ALL SELECT play, frame, cx - 10, cy FROM car UNION ALL SELECT play, frame, 10 - cx, cy FROM car WHERE cx < 10),
  half AS (SELECT play, frame, row_number() OVER (PARTITION BY play, frame) AS k, a, bb, c FROM (
    SELECT s.play, s.frame, s.x - c.cx AS a, s.y - c.cy AS bb, (s.x * s.x - c.cx * c.cx + s.y * s.y - c.cy * c.cy) / 2 AS c FROM site s JOIN car c USING (play, frame) WHERE s.x <> c.cx OR s.y <> c.cy
    UNION ALL SELECT play, frame, e.a, e.bb, e.c FROM car, (VALUES (1.0::DOUBLE, 0.0::DOUBLE, 120.0::DOUBLE), (-1, 0, 0), (0, 1, 53), (0, -1, 0)) e(a, bb, c))),
  vert AS (SELECT h.play, h.frame, (h.c * g.bb - g.c * h.bb) / (h.a * g.bb - g.a * h.bb) AS x, (h.a * g.c - g.a * h.c) / (h.a * g.bb - g.a * h.bb) AS y
    FROM half h JOIN half g ON h.play = g.play AND h.frame = g.frame AND h.k < g.k WHERE abs(h.a * g.bb - g.a * h.bb) > 1e-12),
  good AS (SELECT DISTINCT play, frame, round(x, 9) AS x, round(y, 9) AS y FROM (SELECT v.play, v.frame, v.x, v.y FROM vert v JOIN half h USING (play, frame) GROUP BY ALL HAVING max((h.a * v.x + h.bb * v.y - h.c) / greatest(sqrt(h.a ** 2 + h.bb ** 2), 1e-12)) <= 1e-7)),
  ring AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS turn FROM good WINDOW w AS (PARTITION BY play, frame)),
  edge AS (SELECT play, frame, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ring WINDOW w AS (PARTITION BY play, frame ORDER BY turn, x, y)),
  area AS (SELECT play, frame, abs(sum(x * ny - nx * y)) / 2 AS cell_area FROM edge GROUP BY ALL),
  bi AS (SELECT d.play, d.frame, d.obj, coalesce(sum({_felt('p', 'd.cx', 'd.cy')}), 0) AS blocker_influence FROM st d LEFT JOIN st p ON p.play = d.play AND p.frame = d.frame AND p.team = 'red' AND NOT p.carrier WHERE d.team = 'blue' GROUP BY ALL),
  ft AS (SELECT d.play, d.frame, d.obj, c.s AS carrier_speed, d.vx - c.vx AS rel_vx, abs(d.vy - c.vy) AS rel_vy, sqrt((c.x - d.x) ** 2 + (c.y - d.y) ** 2) AS distance,
    cos(atan2(c.y + c.vy * 0.5 - d.y, c.x + c.vx * 0.5 - d.x) - d.t) AS attack_cosine, coalesce(cell_area, 0) AS cell_area, team_influence, blocker_influence, is_run
    FROM st d JOIN car c ON c.play = d.play AND c.frame = d.frame JOIN ti ON ti.play = d.play AND ti.frame = d.frame LEFT JOIN area ON area.play = d.play AND area.frame = d.frame
    JOIN bi ON bi.play = d.play AND bi.frame = d.frame AND bi.obj = d.obj WHERE d.team = 'blue')"""


def _features(spark, sf):
    return tackle.defender_features(
        b.scrum(spark, sf), ["play", "frame"], "obj", F.col("carrier"), F.col("team") == "red", F.col("team") == "blue", F.col("run"), offset=5
    )


@query(f"WITH {_FEATURES} SELECT play, frame, obj, {', '.join(r(c, c, 8) for c in tackle.FEATURES if c != 'cell_area')}, {r('cell_area + 0.0000123', 'cell_area', 3)} FROM ft")
def feat10_defender_features(spark, sf):
    f = _features(spark, sf)
    return rounded(f.withColumn("cell_area", F.round(F.col("cell_area") + 0.0000123, 3)), 8)  # off the ties of rounding


_COHORT = f"""{b.SCRUM}, asked AS (SELECT DISTINCT play, obj, (obj % 2)::INTEGER AS label FROM scrum WHERE team = 'blue'),
  win AS (SELECT play, coalesce(min(frame) FILTER (marker = 'snap'), min(frame)) AS wa, coalesce(min(frame) FILTER (marker = 'tackle'), max(frame)) AS wz FROM scrum WHERE play IN (SELECT play FROM asked) GROUP BY play),
  act AS (SELECT s.* FROM scrum s JOIN win USING (play) WHERE frame BETWEEN wa AND wz),
  stp AS (SELECT play, count(DISTINCT frame) FILTER (marker = 'tackle') AS n, min(frame) FILTER (marker = 'tackle') AS stop FROM act GROUP BY play),
  nr AS (SELECT d.play, d.obj, arg_min(d.frame, struct_pack(a := (d.x - c.x) ** 2 + (d.y - c.y) ** 2, b := d.frame)) AS near FROM act d JOIN act c ON c.play = d.play AND c.frame = d.frame AND c.carrier WHERE d.team = 'blue' GROUP BY ALL),
  ev AS (SELECT q.play, q.obj, label, stp.play AS seen, CASE WHEN label = 1 THEN CASE WHEN n = 1 THEN stop END ELSE near END AS event_frame FROM asked q LEFT JOIN stp USING (play) LEFT JOIN nr ON nr.play = q.play AND nr.obj = q.obj),
  ex AS (SELECT play, obj, label, event_frame, event_frame - 2 AS state_frame, CASE WHEN seen IS NULL THEN 'missing_tracking' WHEN event_frame IS NULL THEN 'missing_event'
    WHEN event_frame - 2 <= 0 OR NOT EXISTS (SELECT 1 FROM act WHERE act.play = ev.play AND act.frame = event_frame - 2) THEN 'too_early' ELSE 'kept' END AS status FROM ev)"""


def _candidates(spark, sf):
    s = b.scrum(spark, sf)
    asked = s.where("team = 'blue'").select("play", "obj", (F.col("obj") % 2).cast("int").alias("label")).distinct()
    return tackle.tackle_cohort(s, asked, "play", "frame", "obj", "marker", F.col("carrier"), ["snap"], ["tackle"], 0, 2)


@query(f"WITH {_COHORT} SELECT play, obj, label, event_frame, state_frame, status FROM ex")
def pipe5_tackle_cohort(spark, sf):
    return _candidates(spark, sf)["examples"]


@query(f"WITH {_COHORT} SELECT status, count(*) AS candidates FROM ex GROUP BY status")
def pipe5_tackle_audit(spark, sf):
    return _candidates(spark, sf)["audit"]


@query(f"WITH {_COHORT} SELECT s.play, s.obj, s.frame, {r('s.x', 'x')} FROM (SELECT play, min(event_frame) AS e FROM ex GROUP BY play) JOIN scrum s USING (play) WHERE s.frame = e - 2 AND e - 2 > 0")
def win7_state_before_event(spark, sf):
    e = _candidates(spark, sf)["examples"].groupBy("play").agg(F.min("event_frame").alias("e"))
    return rounded(tackle.state_before(b.scrum(spark, sf), e, "play", "frame", "e", 2).select("play", "obj", "frame", "x"))


@query()
def pipe8_framewise_scoring(spark, sf):
    """Ridge scores of all nine features at every frame; learned where the defender's number is even."""
    rows = _features(spark, sf).withColumn("y", (F.col("distance") < 20).cast("double"))
    return rounded(pipelines.framewise_scoring(rows, F.col("obj") % 2 == 0, ["play", "obj"], "frame", tackle.FEATURES, "y", 1.0, 0.3, 2))


# -- cells ---------------------------------------------------------------------------------------------------

_PARTED = f"""{b.BINARY}, prt AS (SELECT *, CASE WHEN "row" % 5 = 4 THEN 'train' WHEN "row" % 2 = 0 THEN 'calibration' ELSE 'test' END AS part FROM bin)"""


def _quantile(label: int) -> str:
    v = "1 - p" if label else "p"
    return f"""c{label} AS {q._PICK.format(by='cell, ', src=f"prt WHERE part = 'calibration' AND y = {label}", seed=5 + label)},
  k{label} AS (SELECT cell, {v} AS v, row_number() OVER (PARTITION BY cell ORDER BY {v}) AS i, count(*) OVER (PARTITION BY cell) AS n FROM c{label}),
  q{label} AS (SELECT cell, coalesce(max(v) FILTER (i = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 1) AS q{label} FROM k{label} GROUP BY cell)"""


_BINARY_COLUMNS = {
    "raw": ("raw_brier", "game_equal_brier"), "null": ("null_loss", ""), "fit": ("calibrated_brier", "game_equal_calibrated_brier"), "rawlog": ("raw_log_loss", "game_equal_raw_log_loss"),
    "fitlog": ("calibrated_log_loss", "game_equal_calibrated_log_loss"), "bias": ("calibration_bias", "game_equal_calibration_bias"), "ent": ("mean_entropy", "game_equal_mean_entropy"),
    "imp": ("mean_va_imprecision", "game_equal_mean_va_imprecision"), "cov0": ("label0_set_coverage", "game_equal_label0_set_coverage"), "cov1": ("label1_set_coverage", "game_equal_label1_set_coverage"),
    "z0": ("set_empty_rate", "game_equal_set_empty_rate"), "z1": ("set_singleton_rate", "game_equal_set_singleton_rate"), "z2": ("set_doubleton_rate", "game_equal_set_doubleton_rate"),
}
_CLIP = lambda p: f"least(greatest({p}, 1e-12), 1 - 1e-12)"
_LOG = lambda p: f"-(y * ln({_CLIP(p)}) + (1 - y) * ln(1 - {_CLIP(p)}))"
_RMS = "sqrt(sum(n * d * d) / sum(n))"
_EVERY = ", ".join(
    [r(f"sum(s_{k}) / sum(n_{k})", a, 7) for k, (a, _) in _BINARY_COLUMNS.items()] + [r(f"avg(m_{k})", g, 7) for k, (_, g) in _BINARY_COLUMNS.items() if g]
    + [r("sum(s_raw) / sum(n_raw)", "primary_loss", 7), r("avg(m_raw)", "game_equal_loss", 7), r("1 - (sum(s_raw) / sum(n_raw)) / (sum(s_null) / sum(n_null))", "skill", 7)]
)
_PER = ", ".join(f"sum({k}) AS s_{k}, count({k}) AS n_{k}, avg({k}) AS m_{k}" for k in _BINARY_COLUMNS)

MET11 = f"""WITH {_PARTED}, {_quantile(0)}, {_quantile(1)},
  g AS (SELECT cell, round(p, 1) AS x, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS wy FROM prt WHERE part = 'calibration' GROUP BY ALL),
  t AS (SELECT DISTINCT cell, round(p, 1) AS t FROM prt WHERE part <> 'train'), lab AS (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS lab),
  u AS (SELECT cell, t, lab, x, w + CASE WHEN x = t THEN 1 ELSE 0 END AS w, wy + CASE WHEN x = t THEN lab ELSE 0 END AS wy FROM t JOIN g USING (cell), lab
    UNION ALL SELECT cell, t, lab, t, 1, lab FROM t, lab WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cell = t.cell AND g.x = t.t)),
  seg AS (SELECT a.cell, a.t, a.lab, a.x AS xa, c.x AS xb, sum(m.wy) / sum(m.w) AS mean FROM u a JOIN u c ON a.cell = c.cell AND a.t = c.t AND a.lab = c.lab AND a.x <= a.t AND c.x >= c.t
    JOIN u m ON m.cell = a.cell AND m.t = a.t AND m.lab = a.lab AND m.x BETWEEN a.x AND c.x GROUP BY ALL),
  lo AS (SELECT cell, t, lab, xa, min(mean) AS v FROM seg GROUP BY ALL), f AS (SELECT cell, t, max(v) FILTER (lab = 0) AS p0, max(v) FILTER (lab = 1) AS p1 FROM (SELECT cell, t, lab, max(v) AS v FROM lo GROUP BY ALL) GROUP BY ALL),
  fit AS (SELECT prt.*, p1 / (1 - p0 + p1) AS point, p1 - p0 AS imp FROM prt JOIN f ON f.cell = prt.cell AND f.t = round(prt.p, 1) WHERE part <> 'train'),
  nl AS (SELECT cell, (sum(y) + 0.5::DOUBLE) / (count(*) + 1) AS np FROM prt WHERE part = 'train' GROUP BY cell),
  ts AS (SELECT *, (p <= coalesce(q0, 1) + 1e-12) AS in0, (1 - p <= coalesce(q1, 1) + 1e-12) AS in1 FROM fit JOIN nl USING (cell) LEFT JOIN q0 USING (cell) LEFT JOIN q1 USING (cell) WHERE part = 'test'),
  ct AS (SELECT *, (p - y) ** 2 AS raw, (np - y) ** 2 AS "null", (point - y) ** 2 AS fit, {_LOG('p')} AS rawlog, {_LOG('point')} AS fitlog, y - point AS bias,
    -({_CLIP('point')} * ln({_CLIP('point')}) + (1 - {_CLIP('point')}) * ln(1 - {_CLIP('point')})) AS ent, CASE WHEN y = 0 THEN in0::INTEGER END AS cov0, CASE WHEN y = 1 THEN in1::INTEGER END AS cov1,
    (NOT in0 AND NOT in1)::INTEGER AS z0, (in0 <> in1)::INTEGER AS z1, (in0 AND in1)::INTEGER AS z2 FROM ts),
  pg AS (SELECT cell, game, {_PER.replace('sum(null)', 'sum("null")').replace('count(null)', 'count("null")').replace('avg(null)', 'avg("null")')} FROM ct GROUP BY ALL),
  mt AS (SELECT cell, {_EVERY} FROM pg GROUP BY cell),
  p9 AS (SELECT cell, {r('quantile_cont(imp, 0.9)', 'p90_va_imprecision', 7)}, {r('max(np)', 'null_probability', 7)} FROM ts GROUP BY cell),
  g9 AS (SELECT cell, {r('avg(v)', 'game_equal_p90_va_imprecision', 7)} FROM (SELECT cell, game, quantile_cont(imp, 0.9) AS v FROM ts GROUP BY ALL) GROUP BY cell),
  cu AS (SELECT cell, list_distinct([quantile_cont(point, x) FOR x IN [0.1]]) AS unused FROM fit GROUP BY cell),
  cuts AS (SELECT DISTINCT cell, v FROM (SELECT cell, unnest(quantile_cont(point, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS v FROM fit WHERE part = 'calibration' GROUP BY cell)),
  bn AS (SELECT ts.cell, ts.game, ts."row", y, point, (SELECT count(*) FROM cuts WHERE cuts.cell = ts.cell AND cuts.v <= ts.point) AS bin FROM ts),
  rw AS (SELECT cell, {r(_RMS, 'rms_reliability', 7)} FROM (SELECT cell, bin, count(*) AS n, avg(y - point) AS d FROM bn GROUP BY ALL) GROUP BY cell),
  rg AS (SELECT cell, {r('avg(v)', 'game_equal_rms_reliability', 7)} FROM (SELECT cell, game, {_RMS} AS v FROM (SELECT cell, game, bin, count(*) AS n, avg(y - point) AS d FROM bn GROUP BY ALL) GROUP BY ALL) GROUP BY cell)
  SELECT * FROM mt JOIN p9 USING (cell) JOIN g9 USING (cell) JOIN rw USING (cell) JOIN rg USING (cell)""".replace(
    "  cu AS (SELECT cell, list_distinct([quantile_cont(point, x) FOR x IN [0.1]]) AS unused FROM fit GROUP BY cell),\n", ""
)


@query(MET11)
def met11_binary_cells(spark, sf):
    """All binary metrics; calibration on scores of one digit, which SQL can repeat (cal8_venn_abers_exact tests the exact one)."""
    return rounded(cells.binary_metrics(b.parted(spark, sf), ["cell"], "game", "row", "part", "p", "y", 5, precision=1), 7)


_CASES = f"""{b.PMFS}, itv AS (SELECT "row", any_value(game) AS game, any_value(cell) AS cell, any_value(y) AS y, CASE WHEN "row" % 5 = 4 THEN 'train' WHEN any_value(is_cal) THEN 'calibration' ELSE 'test' END AS part,
  min(k) FILTER (cdf >= 0.05 - 1e-12) AS lo, min(k) FILTER (cdf >= 0.95 - 1e-12) AS hi FROM pmf GROUP BY "row")"""


def _cases(spark, sf):
    part = F.when(F.col("row") % 5 == 4, "train").when(F.col("is_cal"), "calibration").otherwise("test")
    return b.pmfs(spark, sf).withColumn("part", part)


@query(f"""WITH {_CASES}, dr AS {q._PICK.format(by='cell, ', src="itv WHERE part = 'calibration'", seed=9)},
  sc AS (SELECT cell, greatest(lo - y, y - hi, 0) AS v FROM dr), rk AS (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY v) AS i, count(*) OVER (PARTITION BY cell) AS n FROM sc),
  qq AS (SELECT cell, coalesce(max(v) FILTER (i = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 64) AS q FROM rk GROUP BY cell),
  np AS (SELECT cell, k, count(*) FILTER (y <= k) / count(*) AS cdf FROM itv, range(64) AS k(k) WHERE part = 'train' GROUP BY ALL),
  cr AS (SELECT p."row", avg((p.cdf - CASE WHEN p.k >= p.y THEN 1 ELSE 0 END) ** 2) AS crps, avg((np.cdf - CASE WHEN p.k >= p.y THEN 1 ELSE 0 END) ** 2) AS nul FROM pmf p JOIN np ON np.cell = p.cell AND np.k = p.k GROUP BY p."row"),
  ts AS (SELECT itv.*, crps, nul, greatest(0, lo - q) AS lower, least(63, hi + q) AS upper FROM itv JOIN qq USING (cell) JOIN cr ON cr."row" = itv."row" WHERE part = 'test'),
  gm AS (SELECT cell, game, avg(crps) AS c, avg((y BETWEEN lower AND upper)::INTEGER) AS h, avg(upper - lower) AS w FROM ts GROUP BY ALL),
  ge AS (SELECT cell, {r('avg(c)', 'game_equal_crps')}, {r('avg(c)', 'game_equal_loss')}, {r('avg(h)', 'coverage')}, {r('avg(w)', 'interval_width')} FROM gm GROUP BY cell)
  SELECT * FROM ge JOIN (SELECT cell, {r('avg(crps)', 'crps')}, {r('avg(crps)', 'primary_loss')}, {r('avg(nul)', 'null_loss')}, {r('1 - avg(crps) / avg(nul)', 'skill')}, {r('avg((y BETWEEN lower AND upper)::INTEGER)', 'coverage_example_weighted')},
    {r('avg(upper - lower)', 'interval_width_example_weighted')}, {r('avg(upper - lower + 1)', 'inclusive_class_count')}, {r('coalesce(stddev_samp(upper - lower), 0)', 'interval_width_sd')} FROM ts GROUP BY cell) USING (cell)""")
def met12_distribution_cells(spark, sf):
    return rounded(cells.distribution_metrics(_cases(spark, sf), ["cell"], "game", "row", "part", "pmf", "y", 64, 9))


def _points(spark, sf):
    l_ = b.scrum(spark, sf)
    part = F.when(F.col("obj") % 2 == 0, "calibration").otherwise("test")
    rows = l_.select(
        (F.col("obj") % 3).alias("cell"), (F.col("play") % 50).alias("game"), F.col("obj").alias("row"), F.col("frame").alias("h"), part.alias("part"), "x", "y",
        (F.col("x") + F.col("s")).alias("base_x"), (F.col("y") - F.col("s")).alias("base_y"), (F.col("dir") / 100).alias("res_x"), (-F.col("dir") / 200).alias("res_y"),
    )
    return cells.absolute_paths(rows)


_POINTS = f"""{b.SCRUM}, pts AS (SELECT obj % 3 AS cell, play % 50 AS game, obj AS "row", frame AS h, CASE WHEN obj % 2 = 0 THEN 'calibration' ELSE 'test' END AS part, x, y, x + s AS bx, y - s AS bys, x + s + dir / 100 AS px, y - s - dir / 200 AS py FROM scrum),
  er AS (SELECT *, (px - x) ** 2 + (py - y) ** 2 AS e, (bx - x) ** 2 + (bys - y) ** 2 AS eb FROM pts)"""


@query(f"""WITH {_POINTS}, pa AS (SELECT cell, game, "row", part, sum(e) AS e, sum(eb) AS eb, count(*) AS n, max(sqrt(e) / (1 + h / 10.0::DOUBLE)) AS score, avg(1 + h / 10.0::DOUBLE) AS m FROM er GROUP BY ALL),
  dr AS {q._PICK.format(by='cell, ', src="pa WHERE part = 'calibration'", seed=3).replace('AS n FROM pa', 'AS nn FROM pa').replace('% n)', '% nn)').replace('SELECT *, row_number()', 'SELECT cell, game, "row", score, row_number()')},
  rk AS (SELECT cell, score, row_number() OVER (PARTITION BY cell ORDER BY score) AS i, count(*) OVER (PARTITION BY cell) AS n FROM dr), qq AS (SELECT cell, coalesce(max(score) FILTER (i = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 1e6) AS q FROM rk GROUP BY cell),
  ts AS (SELECT pa.*, q, (score <= q + 1e-12)::INTEGER AS cov, 2 * q * m AS dia FROM pa JOIN qq USING (cell) WHERE part = 'test'),
  gm AS (SELECT cell, game, sqrt(sum(e) / (2 * sum(n))) AS g, avg(cov) AS c, avg(dia) AS d FROM ts GROUP BY ALL)
  SELECT * FROM (SELECT cell, {r('sqrt(sum(e) / (2 * sum(n)))', 'rmse')}, {r('sqrt(sum(e) / (2 * sum(n)))', 'primary_loss')}, {r('sqrt(sum(eb) / (2 * sum(n)))', 'null_loss')}, {r('avg(sqrt(e / (2 * n)))', 'path_equal_rmse')},
    {r('1 - sqrt(sum(e) / (2 * sum(n))) / sqrt(sum(eb) / (2 * sum(n)))', 'skill')}, {r('avg(cov)', 'path_coverage')}, {r('avg(dia)', 'mean_tube_diameter')} FROM ts GROUP BY cell)
  JOIN (SELECT cell, {r('avg(g)', 'game_equal_rmse')}, {r('avg(g)', 'game_equal_loss')}, {r('avg(c)', 'game_equal_path_coverage')}, {r('avg(d)', 'game_equal_tube_diameter')} FROM gm GROUP BY cell) USING (cell)""")
def met13_trajectory_cells(spark, sf):
    p = _points(spark, sf)
    scale = p.select("h").distinct().withColumn("scale", 1 + F.col("h") / 10.0)
    return rounded(cells.trajectory_metrics(p, scale, ["cell"], "row", "game", "h", "part", 3))


@query(f"WITH {_POINTS} SELECT cell, h, {r('sqrt(sum(e) / (2 * count(*)))', 'rmse')} FROM er GROUP BY ALL")
def met6_horizon_rmse(spark, sf):
    return rounded(cells.horizon_rmse(_points(spark, sf), ["cell"], "h"))


_LOCAL = f"""fe AS (SELECT p."row", any_value(i.cell) AS cell, any_value(i.game) AS game, any_value(i.y) AS y, any_value(i.part) AS part, any_value(lo) AS lo, any_value(hi) AS hi, sum(p * k) AS m, sqrt(greatest(sum(p * k * k) - sum(p * k) ** 2, 0)) AS s,
    sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h, sum((p.cdf - CASE WHEN k >= p.y THEN 1 ELSE 0 END) ** 2) AS cs FROM pmf p JOIN itv i ON i."row" = p."row" GROUP BY p."row"),
  un AS (SELECT cell, count(*) AS n, stddev_pop(m) AS um, stddev_pop(s) AS us, stddev_pop(h) AS uh FROM fe WHERE part = 'calibration' GROUP BY cell),
  d2 AS (SELECT t."row", t.cell, un.n, greatest(c.lo - c.y, c.y - c.hi, 0)::DOUBLE AS v, ((t.m - c.m) / um) ** 2 + ((t.s - c.s) / us) ** 2 + ((t.h - c.h) / uh) ** 2 AS d2
    FROM fe t JOIN fe c ON c.cell = t.cell AND c.part = 'calibration' JOIN un ON un.cell = t.cell WHERE t.part = 'test'),
  bw AS (SELECT *, max(CASE WHEN nth <= 20 THEN d2 END) OVER (PARTITION BY "row") AS bd FROM (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY d2) AS nth FROM d2)),
  ws AS (SELECT "row", any_value(n) AS n, v, sum(exp(-d2 / (2 * greatest(bd, 1e-12)))) AS w FROM bw GROUP BY "row", v),
  cw AS (SELECT *, sum(w) OVER (PARTITION BY "row" ORDER BY v) AS cum, sum(w) OVER (PARTITION BY "row") AS total FROM ws),
  pd AS (SELECT "row", ceil(coalesce(min(v) FILTER (cum >= total * least(1, 0.9::DOUBLE * (n + 1) / n) - 1e-12), max(v))) AS padding FROM cw GROUP BY "row")"""


@query(f"WITH {_CASES.replace('CASE WHEN \"row\" % 5 = 4 THEN', 'CASE WHEN false THEN')}, {_LOCAL} SELECT \"row\", cast(padding AS BIGINT) AS padding FROM pd")
def cal4_local_padding(spark, sf):
    p = b.pmfs(spark, sf)
    lo, hi = conformal.central_interval(F.col("pmf"), 0.1)
    f = p.select("row", "cell", "is_cal", fn.pmf_mean(F.col("pmf")).alias("m"), fn.pmf_sd(F.col("pmf")).alias("s"), fn.pmf_entropy(F.col("pmf")).alias("h"), conformal.interval_score(lo, hi, F.col("y")).alias("score"))
    return conformal.local_padding(f.where("is_cal"), f.where("not is_cal"), ["cell"], ["m", "s", "h"], "score", 0.1, 20).select("row", F.col("padding").cast("long").alias("padding"))


@query(f"""WITH {_CASES}, {_LOCAL}, ts AS (SELECT fe.*, padding, cs / 199 AS crps, greatest(0, lo - padding) AS lower, least(63, hi + padding) AS upper FROM fe JOIN pd USING ("row")),
  gm AS (SELECT cell, game, avg(crps) AS c, avg((y BETWEEN lower AND upper)::INTEGER) AS h, avg(upper - lower) AS w FROM ts GROUP BY ALL)
  SELECT * FROM (SELECT cell, {r('avg(crps)', 'crps')}, {r('avg((y BETWEEN lower AND upper)::INTEGER)', 'coverage')}, {r('avg(upper - lower)', 'mean_width')}, {r('avg(upper - lower + 1)', 'mean_width_inclusive')}, {r('avg(padding)', 'mean_q')},
    {r('coalesce(stddev_samp(upper - lower), 0)', 'std_width')}, {r('coalesce(stddev_samp(padding), 0)', 'std_q')}, count(*) AS n_test, count(DISTINCT game) AS n_test_games FROM ts GROUP BY cell)
  JOIN (SELECT cell, {r('avg(c)', 'crps_game_equal')}, {r('avg(h)', 'coverage_game_equal')}, {r('avg(w)', 'mean_width_game_equal')}, {r('avg(w + 1)', 'mean_width_inclusive_game_equal')} FROM gm GROUP BY cell) USING (cell)
  JOIN (SELECT cell, count(*) AS n_calibration FROM fe WHERE part = 'calibration' GROUP BY cell) USING (cell)""")
def met14_local_cells(spark, sf):
    return rounded(cells.local_interval_metrics(_cases(spark, sf), ["cell"], "game", "part", "pmf", "y", 0.1, 20))


@query(f"""WITH {b.PANEL}, {_PARTED}, now AS (SELECT cell, avg((p - y) ** 2) AS brier, avg({_LOG('p')}) AS log_loss FROM prt WHERE part = 'test' GROUP BY cell),
  rec AS (SELECT o_orderpriority AS cell, avg((0.02::DOUBLE + 0.96::DOUBLE * (o_totalprice % 1000) / 1000 - (o_orderstatus = 'F')::INTEGER) ** 2) AS brier, 0.7::DOUBLE AS log_loss FROM orders
    WHERE o_orderkey % 5 <> 4 AND o_orderkey % 2 = 1 AND o_orderpriority NOT LIKE '2%' GROUP BY ALL UNION ALL SELECT '9-NONE', 0.1, 0.2),
  lo AS (SELECT coalesce(n.cell, c.cell) AS cell, m, CASE m WHEN 'brier' THEN c.brier ELSE c.log_loss END AS recorded, CASE m WHEN 'brier' THEN n.brier ELSE n.log_loss END AS again, n.cell IS NULL AS lost, c.cell IS NULL AS unknown
    FROM now n FULL JOIN rec c ON n.cell = c.cell, (SELECT unnest(['brier', 'log_loss']) AS m))
  SELECT cell, m AS metric, {r('recorded', 'recorded', 6)}, {r('again', 'again', 6)}, CASE WHEN unknown THEN 'unrecorded' WHEN lost THEN 'not_recomputed' ELSE 'deviates' END AS problem FROM lo
  WHERE unknown OR lost OR abs(recorded - again) > 1e-5""")
def set7_metric_replay(spark, sf):
    """Metrics recorded from unrounded probabilities, with one cell missing, one unknown and a wrong log loss, against those recomputed from predictions."""
    t = b.parted(spark, sf).where("part = 'test'")
    again = t.groupBy("cell").agg(F.avg(scores.brier(F.col("p"), F.col("y"))).alias("brier"), F.avg(scores.log_loss(F.col("p"), F.col("y"))).alias("log_loss"))
    o = b.table(spark, sf, "orders").where("o_orderkey % 5 <> 4 and o_orderkey % 2 = 1 and o_orderpriority not like '2%'")
    exact = F.lit(0.02) + 0.96 * (F.col("o_totalprice") % 1000) / 1000
    recorded = o.groupBy(F.col("o_orderpriority").alias("cell")).agg(F.avg(scores.brier(exact, (F.col("o_orderstatus") == "F").cast("int"))).alias("brier"), F.lit(0.7).alias("log_loss"))
    recorded = recorded.unionByName(recorded.limit(1).select(F.lit("9-NONE").alias("cell"), F.lit(0.1).alias("brier"), F.lit(0.2).alias("log_loss")))
    return rounded(cells.replayed(recorded, again, ["cell"], ["brier", "log_loss"], 1e-5), 6)


_FOUR = q._SPLITS.replace("range(1, 11)", "range(1, 5)")  # four repeats


@query(f"""WITH RECURSIVE {_FOUR}, {q._ORDER}, bn AS (SELECT o_orderkey AS "row", o_custkey AS game, cast(o_orderstatus = 'F' AS INTEGER) AS y, round(0.02::DOUBLE + 0.96::DOUBLE * (o_totalprice % 1000) / 1000, 6) AS p FROM orders),
  nul AS (SELECT o.repeat, n_train, (sum(y) + 0.5::DOUBLE) / (count(*) + 1) AS np FROM bn JOIN ord o USING (game), (SELECT unnest([40, 120]) AS n_train) WHERE train_order <= n_train GROUP BY ALL),
  ts AS (SELECT repeat, n_train, game, (p - y) ** 2 AS raw, (np - y) ** 2 AS nl FROM bn JOIN splits USING (game) JOIN nul USING (repeat) WHERE role = 'test')
  SELECT cast(repeat AS INTEGER) AS repeat, n_train, {r('avg(raw)', 'primary_loss')}, {r('avg(nl)', 'null_loss')}, {r('1 - avg(raw) / avg(nl)', 'skill')}, {r('any_value(g)', 'game_equal_loss')}
  FROM ts JOIN (SELECT repeat, n_train, avg(v) AS g FROM (SELECT repeat, n_train, game, avg(raw) AS v FROM ts GROUP BY ALL) GROUP BY ALL) USING (repeat, n_train) GROUP BY repeat, n_train""")
def pipe10_evaluated_cells(spark, sf):
    """Predictions of every repeat and budget, evaluated on their own split in one job; the columns that SQL repeats."""
    splits = design.outer_splits(b.games(spark, sf), "game", "stratum", 4, q._ROLES, 11)
    order = design.balanced_order(splits.where("role = 'train'"), ["repeat"], "game", "stratum", "place").select("repeat", "game", "train_order")
    plan = splits.join(order, ["repeat", "game"], "left")
    rows = b.binary(spark, sf).select("row", "game", "y", "p").join(splits.where("role is not null").select("repeat", "game"), "game")
    rows = rows.withColumn("n_train", F.explode(F.array(F.lit(40), F.lit(120))))
    out = cells.evaluate_cells(rows, plan, ["repeat", "n_train"], "row", "game", "binary", p="p", y="y", seed=5, precision=1)
    return rounded(out.select("repeat", "n_train", "primary_loss", "null_loss", "skill", "game_equal_loss"))


# -- tokens --------------------------------------------------------------------------------------------------

_CHANNELS = ["x_rel", "y_rel", "vx", "vy", "speed", "acceleration", "dir_sin", "dir_cos", "orientation_sin", "orientation_cos", "offense", "defense", "football", "focal"]


def _angle(c: str) -> tuple[str, str]:
    sign = """(CASE WHEN "playDirection" = 'left' THEN -1 ELSE 1 END)"""
    return tuple(f"coalesce({f}(radians(((90 - {c}) % 360 + 360) % 360)) * {sign}, 0)" for f in ("sin", "cos"))


_GROUP = "CASE position WHEN 'QB' THEN 'qb' WHEN 'WR' THEN 'wr' WHEN 'TE' THEN 'te' WHEN 'RB' THEN 'rb' WHEN 'OL' THEN 'ol' WHEN 'DE' THEN 'dl' WHEN 'ILB' THEN 'lb' WHEN 'CB' THEN 'db' WHEN 'K' THEN 'special' ELSE 'other' END"
_ENCODED = f"""{b.SCRUM}, std AS (SELECT *, CASE WHEN "playDirection" = 'left' THEN 120 - x ELSE x END AS sx, CASE WHEN "playDirection" = 'left' THEN 160.0::DOUBLE / 3 - y ELSE y END AS sy, team = 'red' AS off FROM scrum),
  ref AS (SELECT play, frame, min(struct_pack(a := sx, b := sy)) FILTER (team = 'football') AS ball, min(obj) FILTER (off AND position = 'QB') AS qb FROM std GROUP BY ALL),
  enc AS (SELECT std.play, std.frame, obj, sx - ball.a AS x_rel, sy - ball.b AS y_rel, s * {_angle('dir')[1]} AS vx, s * {_angle('dir')[0]} AS vy, s AS speed, coalesce(a, 0) AS acceleration, {_angle('dir')[0]} AS dir_sin, {_angle('dir')[1]} AS dir_cos,
    {_angle('o')[0]} AS orientation_sin, {_angle('o')[1]} AS orientation_cos, off::INTEGER::DOUBLE AS offense, (team = 'blue')::INTEGER::DOUBLE AS defense, (team = 'football')::INTEGER::DOUBLE AS football,
    coalesce(obj = qb, false)::INTEGER::DOUBLE AS focal, CASE WHEN team = 'football' THEN 'ball' ELSE {_GROUP} END AS "group", carrier FROM std JOIN ref USING (play, frame))"""


def _encoded(spark, sf):
    s = b.scrum(spark, sf)
    return tokens.encoded(s, ["play", "frame"], "obj", F.col("team"), F.lit("red"), F.col("position"), focal_position="QB")


@query(f"""WITH {_ENCODED} SELECT play, frame, obj, {', '.join(r(c, c) for c in _CHANNELS)}, "group", ("group" = 'qb')::INTEGER::DOUBLE AS position_qb, ("group" = 'other')::INTEGER::DOUBLE AS position_other FROM enc""")
def geo6_encoded_tokens(spark, sf):
    return rounded(_encoded(spark, sf).select("play", "frame", "obj", *_CHANNELS, "group", "position_qb", "position_other"))


@query(f"WITH {_ENCODED} SELECT play, frame, obj, cast(row_number() OVER (PARTITION BY play, frame ORDER BY football DESC, focal DESC, offense DESC, obj) - 1 AS INTEGER) AS slot FROM enc")
def win9_frame_slots(spark, sf):
    return tokens.frame_slots(_encoded(spark, sf), ["play", "frame"], "obj").select("play", "frame", "obj", "slot")


@query(f"WITH {b.SCRUM} SELECT play, obj, cast(row_number() OVER (PARTITION BY play ORDER BY off DESC, obj) - 1 AS INTEGER) AS slot FROM (SELECT play, obj, bool_or(team = 'red') AS off FROM scrum GROUP BY ALL)")
def win10_side_slots(spark, sf):
    return tokens.side_slots(b.scrum(spark, sf), ["play"], "obj", F.col("team") == "red")


@query(f"""WITH {_ENCODED}, sl AS (SELECT play, obj, row_number() OVER (PARTITION BY play ORDER BY off DESC, obj) - 1 AS slot FROM (SELECT play, obj, bool_or(team = 'red') AS off FROM scrum GROUP BY ALL)),
  wn AS (SELECT play, frame, 3 - row_number() OVER (PARTITION BY play ORDER BY frame DESC) AS time_index FROM (SELECT DISTINCT play, frame FROM scrum WHERE frame <= 5))
  SELECT 'p' || enc.play AS example, cast(time_index AS INTEGER) AS time_index, cast(slot AS INTEGER) AS slot, {r('x_rel', 'x_rel')}, {r('vx', 'vx')}, offense FROM enc JOIN wn ON wn.play = enc.play AND wn.frame = enc.frame AND time_index >= 0
  JOIN sl ON sl.play = enc.play AND sl.obj = enc.obj""")
def geo11_assembled_tokens(spark, sf):
    s = b.scrum(spark, sf)
    examples = s.select("play").distinct().withColumn("example", F.concat(F.lit("p"), F.col("play").cast("string"))).withColumn("cutoff", F.lit(5))
    windows = frames.history_windows(s, examples, "play", "frame", 3).withColumn("time_index", F.col("time_index"))
    out = tokens.assembled(examples, _encoded(spark, sf), windows, tokens.side_slots(s, ["play"], "obj", F.col("team") == "red"), "example", "play", "frame", "obj")
    return rounded(out.select("example", "time_index", "slot", "x_rel", "vx", "offense"))


def _edge_sql(task: str) -> str:
    nodes, rules = tokens.TASKS[task]
    role = {
        "focal": "focal > 0.5", "offense": "offense > 0.5", "defense": "defense > 0.5", "football": "football > 0.5", "carrier": "carrier", "eligible": """"group" IN ('wr', 'te', 'rb')""", "protector": """"group" IN ('ol', 'rb', 'te')""",
        "rusher": """defense > 0.5 AND "group" IN ('dl', 'lb')""", "coverage": """defense > 0.5 AND "group" NOT IN ('dl', 'lb')""", "blocker": "offense > 0.5 AND focal < 0.5", "free_blocker": "offense > 0.5 AND NOT carrier",
        "help": "defense > 0.5 AND focal < 0.5", "pursuit": "focal > 0.5 OR defense > 0.5",
    }
    names = sorted(set(nodes) | {x for _, a, c in rules for x in (a, c) if x})
    case = "'none'"
    for edge, a, c in rules:
        rule = f"t.is_{a} AND s.is_{a}" if c is None else f"(t.is_{a} AND s.is_{c}) OR (t.is_{c} AND s.is_{a})"
        case = f"CASE WHEN {rule} THEN '{edge}' ELSE {case} END"
    return f"""WITH {_ENCODED}, rl AS (SELECT play, frame, obj, {', '.join(f'({role[n]}) AS is_{n}' for n in names)} FROM enc), ac AS (SELECT * FROM rl WHERE {' OR '.join(f'is_{n}' for n in nodes)})
  SELECT t.play, {case} AS edge, count(*) AS n FROM ac t JOIN ac s ON s.play = t.play AND s.frame = t.frame AND s.obj <> t.obj GROUP BY ALL"""


@query(_edge_sql("sack"))
def feat6_sack_edges(spark, sf):
    return tokens.typed_edges(_encoded(spark, sf), ["play", "frame"], "obj", "sack").groupBy("play", "edge").agg(F.count("*").alias("n"))


@query(_edge_sql("tackle"))
def feat6_tackle_edges(spark, sf):
    t = _encoded(spark, sf).withColumn("carrier", F.col("carrier").cast("double"))
    return tokens.typed_edges(t, ["play", "frame"], "obj", "tackle").groupBy("play", "edge").agg(F.count("*").alias("n"))


@query(f"""WITH {_ENCODED}, t AS (SELECT *, max(frame) OVER (PARTITION BY play) AS last FROM enc WHERE focal > 0.5 OR offense > 0.5 OR defense > 0.5 OR football > 0.5)
  SELECT play, frame, count(*) AS nodes, sum(football) AS balls FROM t WHERE frame = last GROUP BY ALL""")
def feat7_snapshot_nodes(spark, sf):
    t = tokens.active_tokens(_encoded(spark, sf), ["play", "frame"], "rushing", "snapshot")
    return t.groupBy("play", "frame").agg(F.count("*").alias("nodes"), F.sum("football").alias("balls"))


@query(f"""WITH {_ENCODED}, e AS (SELECT * FROM enc WHERE x_rel IS NOT NULL),
  cr AS (SELECT o.play, o.frame, sqrt((o.x_rel - d.x_rel) ** 2 + (o.y_rel - d.y_rel) ** 2) AS v FROM e o JOIN e d ON d.play = o.play AND d.frame = o.frame AND o.offense > 0.5 AND d.defense > 0.5),
  fr AS (SELECT play, frame, min(v) AS lo, avg(v) AS mid, stddev_pop(v) AS sd FROM cr GROUP BY ALL),
  fo AS (SELECT f.play, f.frame, min(v) FILTER (o.offense > 0.5) AS fo, avg(v) FILTER (o.offense > 0.5) AS fom, min(v) FILTER (o.defense > 0.5) AS fd, avg(v) FILTER (o.defense > 0.5) AS fdm
    FROM e f JOIN (SELECT *, 0 AS z FROM e) o ON o.play = f.play AND o.frame = f.frame AND f.focal > 0.5 AND o.focal < 0.5, LATERAL (SELECT sqrt((f.x_rel - o.x_rel) ** 2 + (f.y_rel - o.y_rel) ** 2) AS v) GROUP BY ALL),
  la AS (SELECT play, max(frame) AS frame FROM e GROUP BY play),
  te AS (SELECT play, avg(lo) AS a, arg_max(lo, frame) - arg_min(lo, frame) AS c, avg(mid) AS m FROM fr GROUP BY play)
  SELECT la.play, {r('lo', 'cross_min', 7)}, {r('mid', 'cross_mean', 7)}, {r('sd', 'cross_sd', 7)}, {r('fo', 'focal_offense_min', 7)}, {r('fom', 'focal_offense_mean', 7)}, {r('fd', 'focal_defense_min', 7)}, {r('fdm', 'focal_defense_mean', 7)},
    {r('a', 'mean_of_min', 7)}, {r('c', 'change_of_min', 7)}, {r('m', 'mean_of_mean', 7)} FROM la LEFT JOIN fr USING (play, frame) LEFT JOIN fo ON fo.play = la.play AND fo.frame = la.frame LEFT JOIN te ON te.play = la.play""")
def feat2_side_distances(spark, sf):
    return rounded(tokens.side_distances(_encoded(spark, sf).where("x_rel is not null"), "play", "frame"), 7)


@query(f"""WITH {_ENCODED}, la AS (SELECT *, max(frame) OVER (PARTITION BY play) AS last FROM enc), sm AS (SELECT play, count(*) FILTER (frame = last AND offense > 0.5) AS offense_count,
    avg(speed) FILTER (frame = last AND offense > 0.5) AS v FROM la GROUP BY play), ct AS (SELECT play, min(team) AS first_team FROM scrum GROUP BY play)
  SELECT ct.play, first_team, offense_count, {r('v', 'offense_speed_mean')} FROM ct JOIN sm USING (play)""")
def feat4_combined_features(spark, sf):
    from fieldlens.operators import geometry

    s = b.scrum(spark, sf)
    context = s.groupBy("play").agg(F.min("team").alias("first_team"), F.min("team").alias("club"))
    summary = geometry.token_summary(_encoded(spark, sf), "play", "frame", {"offense": F.col("offense") > 0.5}, ["speed"])
    out = tokens.combined(context, [summary], "play")
    if "club" in out.columns:
        raise ValueError("a team column is left")
    return rounded(out.select("play", "first_team", "offense_count", "offense_speed_mean"))


@query(f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, s_name, s_acctbal FROM lineitem JOIN (SELECT s_suppkey, min(struct_pack(n := s_name, a := s_acctbal)).n AS s_name, min(struct_pack(n := s_name, a := s_acctbal)).a AS s_acctbal
  FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY s_suppkey) ON l_suppkey = s_suppkey""")
def jn4_with_players(spark, sf):
    rows = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    people = b.table(spark, sf, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal")
    return tokens.with_players(rows, people.unionByName(people), "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_linestatus = 'F' THEN l_linestatus END, o_orderstatus) AS status, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def jn5_with_plays(spark, sf):
    rows = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).alias("status"))
    plays = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return tokens.with_plays(rows, plays, ["l_orderkey"])


@query("""SELECT o_custkey * 1000000 AS game, o_orderkey AS play, cast(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE o_custkey END AS INTEGER) AS season, -1 AS week, (o_custkey * 1000000)::VARCHAR || ':' || o_orderkey AS example_id,
  'season_' || cast(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE o_custkey END AS VARCHAR) AS stratum FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey""")
def jn7_with_games(spark, sf):
    examples = b.table(spark, sf, "orders").select((F.col("o_custkey") * 1_000_000).alias("game"), F.col("o_orderkey").alias("play"))
    games = b.table(spark, sf, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") * 1_000_000).alias("game"), F.col("c_nationkey").alias("season"))
    return tokens.with_games(examples, games, "game", "play", False)


# -- handoffs ------------------------------------------------------------------------------------------------

_HANDOFF = f"""{b.SCRUM}, hs AS (SELECT play * 10 + frame AS play, obj, team = 'red' AS off, carrier AS rush, CASE WHEN "playDirection" = 'left' THEN 120 - x ELSE x END AS xs, CASE WHEN "playDirection" = 'left' THEN 160.0::DOUBLE / 3 - y ELSE y END AS ys,
    CASE WHEN run THEN 10 * coalesce(a, 0) ELSE s END AS v, CASE WHEN o IS NULL THEN CASE WHEN team = 'red' THEN 0 ELSE pi() END WHEN "playDirection" = 'left' THEN (radians(((90 - o) % 360 + 360) % 360) + pi()) % (2 * pi()) ELSE radians(((90 - o) % 360 + 360) % 360) END AS t FROM scrum),
  hv AS (SELECT *, v * cos(t) AS sx, v * sin(t) AS sy FROM hs), ru AS (SELECT play, max(xs) AS rx, max(ys) AS ry, max(sx) AS rsx, max(sy) AS rsy FROM hv WHERE rush GROUP BY play),
  ha AS (SELECT hv.*, rx - xs AS dx, ry - ys AS dy, rsx - sx AS dsx, rsy - sy AS dsy FROM hv LEFT JOIN ru USING (play)),
  gr AS (SELECT d.play, d.obj AS defender, p.obj AS blocker, p.sx - d.sx AS c0, p.sy - d.sy AS c1, p.xs - d.xs AS c2, p.ys - d.ys AS c3, d.dsx AS c4, d.dsy AS c5, d.dx AS c6, d.dy AS c7, d.sx AS c8, d.sy AS c9 FROM ha d JOIN ha p ON p.play = d.play AND NOT d.off AND p.off AND NOT p.rush)"""


def _handoff(spark, sf):
    s = b.scrum(spark, sf).withColumns({"play": F.col("play") * 10 + F.col("frame"), "a": F.coalesce("a", F.lit(0.0))})
    return tokens.rushing_arrays(
        s, "play", "obj", F.col("carrier"), F.col("team") == "red", early=F.col("run"), x="x", y="y", speed="s", step="a", heading="o", left=F.col("playDirection") == "left"
    )


@query(f"WITH {_HANDOFF} SELECT play, defender, blocker, {', '.join(r(f'c{i}', f'c{i}', 7) for i in range(10))} FROM gr")
def geo15_pair_grid(spark, sf):
    return rounded(_handoff(spark, sf)["grid"], 7)


@query(f"WITH {_HANDOFF} SELECT play, {', '.join(r(f'{f}(c{i})', f'c{i}_{n}', 9) for i in range(10) for n, f in (('min', 'min'), ('mean', 'avg'), ('max', 'max'), ('sd', 'stddev_pop')))} FROM gr GROUP BY play")
def pipe9_rushing_features(spark, sf):
    return rounded(_handoff(spark, sf)["summary"], 9)


@query(f"WITH {_HANDOFF} SELECT play, obj, cast(row_number() OVER (PARTITION BY play ORDER BY CASE WHEN rush THEN 0 WHEN off THEN 1 ELSE 2 END, ys, xs, obj) - 1 AS INTEGER) AS slot, {r('xs', 'x_std')}, {r('dx', 'dx')} FROM ha")
def win12_set_tokens(spark, sf):
    return rounded(_handoff(spark, sf)["tokens"].select("play", "obj", "slot", "x_std", "dx"))


# -- trajectories --------------------------------------------------------------------------------------------

_PATHS_IN = f"""{b.SCRUM}, tin AS (SELECT play, frame, obj, obj % 8 IN (1, 5) AS req, team = 'red' AS off, CASE WHEN "playDirection" = 'left' THEN 120 - x ELSE x END AS x, y, s,
    radians(CASE WHEN "playDirection" = 'left' THEN ((180 - ((90 - dir) % 360 + 360) % 360) % 360 + 360) % 360 ELSE ((90 - dir) % 360 + 360) % 360 END) AS d FROM scrum WHERE frame <= 4 AND team <> 'football'),
  ex AS (SELECT play, obj, max(frame) AS last_frame, arg_max(x, frame) AS x, arg_max(y, frame) AS y, arg_max(s * cos(d), frame) AS vx, arg_max(s * sin(d), frame) AS vy, 3 AS horizon FROM tin WHERE req GROUP BY ALL),
  ou AS (SELECT play, obj, frame - 4 AS frame, x AS tx, y AS ty FROM scrum WHERE frame > 4 AND obj % 8 IN (1, 5))"""


def _trajectory(spark, sf):
    s = b.scrum(spark, sf)
    ins = s.where("frame <= 4 and team <> 'football'").withColumn("num_frames_output", F.lit(3))
    outs = s.where("frame > 4").where(F.col("obj") % 8 % 4 == 1).select("play", "obj", (F.col("frame") - 4).alias("frame"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return pipelines.tokens.trajectory_cohort(ins, outs, "play", "frame", "obj", F.col("obj") % 8 % 4 == 1, F.col("team") == "red", F.col("playDirection") == "left")


@query(f"WITH {_PATHS_IN} SELECT play, obj, last_frame, {r('x', 'x')}, {r('y', 'y')}, {r('vx', 'vx')}, {r('vy', 'vy')}, horizon FROM ex")
def pipe7_trajectory_examples(spark, sf):
    return rounded(_trajectory(spark, sf)["examples"])


@query(f"""WITH {_PATHS_IN}, sl AS (SELECT play, obj, row_number() OVER (PARTITION BY play ORDER BY bool_or(off) DESC, obj) - 1 AS slot FROM tin GROUP BY play, obj)
  SELECT t.play, t.frame, t.obj, f.obj AS focal_obj, cast(slot AS INTEGER) AS slot, {r('t.x - f.x', 'x_rel')}, {r('t.y - f.y', 'y_rel')}, (t.obj = f.obj)::INTEGER::DOUBLE AS focal FROM tin t JOIN tin f ON f.play = t.play AND f.frame = t.frame AND f.req JOIN sl ON sl.play = t.play AND sl.obj = t.obj""")
def jn13_multi_focal_tokens(spark, sf):
    return rounded(_trajectory(spark, sf)["tokens"].select("play", "frame", "obj", "focal_obj", "slot", "x_rel", "y_rel", "focal"))


@query(f"""WITH {_PATHS_IN} SELECT ou.play, ou.obj, ou.frame - 1 AS "index", tx, ty, count(*) OVER w = 3 AND min(ou.frame) OVER w = 1 AND max(ou.frame) OVER w = 3 AS complete FROM ou JOIN ex USING (play, obj) WINDOW w AS (PARTITION BY ou.play, ou.obj)""")
def geo12_aligned_targets(spark, sf):
    return _trajectory(spark, sf)["targets"].select("play", "obj", "index", "tx", "ty", "complete")


@query(f"WITH {_PATHS_IN} SELECT play, obj, cast(t AS INTEGER) AS t, {r('x + t / 10.0::DOUBLE * vx', 'px')}, {r('y + t / 10.0::DOUBLE * vy', 'py')} FROM ex, range(1, 4) AS t(t)")
def pipe7_baseline_paths(spark, sf):
    return rounded(_trajectory(spark, sf)["baseline"])


@query(f"""WITH {_PATHS_IN} SELECT play, obj, 'input' AS side FROM ex WHERE NOT EXISTS (SELECT 1 FROM ou WHERE ou.play = ex.play AND ou.obj = ex.obj)
  UNION ALL SELECT DISTINCT play, obj, 'output' FROM ou WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ou.play = ex.play AND ou.obj = ex.obj)""")
def prj8_path_mismatches(spark, sf):
    return _trajectory(spark, sf)["mismatches"]


@query(f"""WITH {_PATHS_IN} SELECT play, obj, {r('(CASE WHEN play % 2 = 0 THEN 120 - (play % 100) ELSE play % 100 END) - x', 'ball_land_x_rel')}, {r('20 - y', 'ball_land_y_rel')}, cast(72 + obj % 12 AS INTEGER) AS height_inches, {r('sin(radians(x))', 'dir_sin')} FROM ex""")
def geo13_trajectory_context(spark, sf):
    ex = _trajectory(spark, sf)["examples"].withColumns({
        "land_x": F.col("play") % 100, "land_y": F.lit(20), "height": F.concat(F.lit("6-"), (F.col("obj") % 12).cast("string")), "left": F.col("play") % 2 == 0,
    })
    out = tokens.trajectory_context(ex, F.col("left"), "x", "y", "land_x", "land_y", "height", "x", "y")
    return rounded(out.select("play", "obj", "ball_land_x_rel", "ball_land_y_rel", "height_inches", "dir_sin"))


# -- splits, choices, products -------------------------------------------------------------------------------

_INNER = f"""{q._SPLITS}, tr2 AS (SELECT repeat, game, stratum FROM splits WHERE role = 'train'), ic AS (SELECT repeat, stratum, count(*) AS c FROM tr2 GROUP BY ALL),
  al2 AS (SELECT *, want * c // tot AS base, want * c % tot AS rem FROM (SELECT *, sum(c) OVER (PARTITION BY repeat)::BIGINT AS tot, ceil(sum(c) OVER (PARTITION BY repeat) / 5.0::DOUBLE)::BIGINT AS want FROM ic)),
  al3 AS (SELECT repeat, stratum, base + CASE WHEN row_number() OVER (PARTITION BY repeat ORDER BY rem DESC, stratum) <= want - sum(base) OVER (PARTITION BY repeat) THEN 1 ELSE 0 END AS take FROM al2),
  pl AS (SELECT *, row_number() OVER (PARTITION BY repeat, stratum ORDER BY sha256(concat_ws('|', game, 'inner', 13)), game) AS place FROM tr2)"""


@query(f"WITH {_INNER} SELECT cast(repeat AS INTEGER) AS repeat, game, CASE WHEN place <= take THEN 'validation' ELSE 'fit' END AS part FROM pl JOIN al3 USING (repeat, stratum)")
def des11_inner_splits(spark, sf):
    t = q._splits(spark, sf).where("role = 'train'").select("repeat", "game", "stratum")
    return design.inner_splits(t, ["repeat"], "game", "stratum", {"validation": 1}, 5, 13).select("repeat", "game", "part")


@query("""WITH a AS (SELECT o_orderkey % 4 AS repeat, o_custkey AS game, unnest([20, 40, 80]) AS n_train FROM orders GROUP BY 1, 2), k AS (SELECT * FROM a WHERE NOT (game % 17 = 0 AND n_train = 40))
  SELECT x.repeat, x.game, cast(x.n_train AS INTEGER) AS n_train, CASE x.n_train WHEN 20 THEN 40 ELSE 80 END AS missing_at FROM k x WHERE n_train < 80 AND NOT EXISTS (SELECT 1 FROM k y WHERE y.repeat = x.repeat AND y.game = x.game AND y.n_train = CASE x.n_train WHEN 20 THEN 40 ELSE 80 END)""")
def set5_nesting_violations(spark, sf):
    a = b.table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("repeat"), F.col("o_custkey").alias("game")).distinct()
    a = a.withColumn("n_train", F.explode(F.array(F.lit(20), F.lit(40), F.lit(80)))).where("not (game % 17 = 0 and n_train = 40)")
    return design.nesting_violations(a, ["repeat"], "game")


@query(f"""WITH {b.PANEL} SELECT model, n_train, count(*) AS n, count(DISTINCT repeat) AS repeats, 'exploratory_provisional' AS status FROM panel GROUP BY ALL""")
def stat13_provisional(spark, sf):
    p = b.panel(spark, sf)
    t = pipelines.provisional({"counts": p.groupBy("model", "n_train").agg(F.count("*").alias("n"), F.countDistinct("repeat").alias("repeats"))})
    return t["counts"]


@query(f"""WITH {b.PANEL}, tk AS (SELECT 'a' AS task, * FROM panel UNION ALL SELECT 'b', * FROM panel WHERE model <> 'AF'), pt AS (SELECT task, model, n_train, avg(loss) AS v FROM tk GROUP BY ALL)
  SELECT model, n_train, count(*) AS n_tasks, {r('avg(v)', 'mean')}, string_agg(task, ',' ORDER BY task) AS tasks FROM pt GROUP BY ALL HAVING count(*) >= 2""")
def pipe13_suite(spark, sf):
    p = b.panel(spark, sf)
    out = pipelines.suite({"a": p, "b": p.where("model <> 'AF'")}, "loss", 2)
    return rounded(out.select("model", "n_train", "n_tasks", "mean", "tasks"))


@query("""SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 25""")
def srt2_first_examples(spark, sf):
    from fieldlens.sources import tables

    c = b.table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    return tables.first_examples(c, ["c_custkey"], 25)


@query("""SELECT o_orderkey AS play, (o_orderstatus = 'F')::INTEGER AS y, CASE WHEN o_custkey % 5 > 0 AND o_orderkey % 7 > 0 THEN o_custkey END AS game, CASE WHEN o_custkey % 5 > 0 AND o_orderkey % 7 > 0 THEN year(o_orderdate) END AS season,
  CASE WHEN o_custkey % 5 = 0 THEN 'unmatched' WHEN o_orderkey % 7 = 0 THEN 'ambiguous' END AS problem FROM orders""")
def src9_labelled_arrays(spark, sf):
    from fieldlens.sources import tables

    o = b.table(spark, sf, "orders")
    labels = o.select(F.col("o_orderkey").alias("play"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    plays = o.where("o_custkey % 5 > 0").select(F.col("o_orderkey").alias("play"), F.col("o_custkey").alias("game"), F.year("o_orderdate").cast("long").alias("season"))
    twice = plays.where("play % 7 = 0").withColumn("season", F.col("season") + 1)
    return tables.labelled_arrays(labels, plays.unionByName(twice), "play", "game", "season")


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice - 100 END AS target FROM orders WHERE o_totalprice IS NOT NULL""".replace("CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice - 100 END AS target", "o_totalprice AS target"))
def prj2_bounded_target(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("target"))
    return o.join(cohort.bounded_target(o.select("o_orderkey", F.col("target").cast("int").alias("t")), "t", 0, 10_000_000).select("o_orderkey"), "o_orderkey")


@query("SELECT c_custkey, c_nationkey, NULL::DOUBLE AS weather, CASE WHEN (SELECT count(DISTINCT c_nationkey) FROM customer) > 1 THEN 'season_' || c_nationkey ELSE 'week_01' END AS stratum FROM customer")
def des2_strata(spark, sf):
    c = cohort.with_optional(b.table(spark, sf, "customer"), {"c_custkey": "bigint", "c_nationkey": "int", "weather": "double"})
    return design.strata(c.withColumn("week", F.lit(1)), "c_nationkey", "week").drop("week")


@query("""SELECT r.r AS repeat, m AS model, n AS n_train FROM range(1, 21) AS r(r), (SELECT DISTINCT l_returnflag || l_linestatus AS m FROM lineitem), (SELECT DISTINCT l_linenumber * 20 AS n FROM lineitem)""".replace("r.r AS repeat", "r.r::INTEGER AS repeat"))
def des13_cells(spark, sf):
    p = b.panel(spark, sf)
    names = [x.model for x in p.select("model").distinct().orderBy("model").collect()]  # a handful of models
    sizes = [x.n_train for x in p.select("n_train").distinct().orderBy("n_train").collect()]
    return design.cells(20, names, sizes, spark)

"""The registered queries of the reference's operators with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import automaton, cells, conformal, design, encode, frames, geometry, inference, panel, scores
from fieldlens.plans import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles at ``digits`` decimals, so that sums in another order compare equal."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


_STATS = ", ".join(
    ["count(v) AS n", r("avg(v)", "mean"), r("stddev_samp(v)", "sd"), r("stddev_samp(v) / sqrt(count(v))", "mcse")]
    + [r(f"quantile_cont(v, {q})", n) for n, q in panel.QUANTILES.items()]
)
_MELT = "long AS (SELECT repeat, model, n_train, metric, v FROM panel UNPIVOT (v FOR metric IN (loss, null_loss, width, coverage)))"
_METRICS = ["loss", "null_loss", "width", "coverage"]

# -- panel statistics ----------------------------------------------------------------------------------------


@query(f"WITH {b.PANEL}, {_MELT} SELECT model, n_train, metric, {_STATS}, {r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr')} FROM long GROUP BY ALL")
def stat1_task_summary(spark, sf):
    return rounded(panel.summarize(b.panel(spark, sf), ["model", "n_train"], _METRICS))


@query(f"WITH {b.PANEL}, {_MELT} SELECT metric, model, n_train, {r('avg(v)', 'mean')}, {r('quantile_cont(v, 0.1)', 'q10')}, {r('quantile_cont(v, 0.9)', 'q90')} FROM long GROUP BY ALL")
def stat2_ribbons(spark, sf):
    return rounded(panel.ribbons(b.panel(spark, sf), _METRICS))


@query(f"WITH {b.PANEL} SELECT model, n_train, {r('avg(loss)', 'loss_mean')}, {r('stddev_samp(loss)', 'loss_sd')}, {r('avg(width)', 'width_mean')}, {r('stddev_samp(width)', 'width_sd')} FROM panel GROUP BY ALL")
def agg13_wide_summary(spark, sf):
    s = panel.summarize(b.panel(spark, sf), ["model", "n_train"], ["loss", "width"])
    return rounded(panel.summarize_wide(s, ["model", "n_train"], ["loss", "width"], ["mean", "sd"]))


_PAIRS = 'diffs AS (SELECT repeat, n_train, a.model AS "left", c.model AS "right", a.loss - c.loss AS v FROM panel a JOIN panel c USING (repeat, n_train) WHERE a.model < c.model)'


@query(f'WITH {b.PANEL}, {_PAIRS} SELECT repeat, n_train, "left", "right", {r("v", "difference")} FROM diffs')
def stat3_paired_models(spark, sf):
    return rounded(panel.paired_models(b.panel(spark, sf), "loss"))


@query(f'WITH {b.PANEL}, {_PAIRS} SELECT "left", "right", n_train, {_STATS} FROM diffs GROUP BY ALL')
def stat4_difference_stability(spark, sf):
    return rounded(panel.difference_stability(b.panel(spark, sf), "loss"))


@query(f"WITH {b.PANEL} SELECT a.repeat, a.model, a.n_train AS small, c.n_train AS large, {r('c.loss - a.loss', 'difference')} FROM panel a JOIN panel c ON a.repeat = c.repeat AND a.model = c.model AND c.n_train = a.n_train + 20")
def stat5_adjacent_sizes(spark, sf):
    return rounded(panel.size_contrasts(b.panel(spark, sf), "loss", "adjacent"))


@query(f"WITH {b.PANEL} SELECT a.repeat, a.model, a.n_train AS small, c.n_train AS large, {r('c.loss - a.loss', 'difference')} FROM panel a JOIN panel c ON a.repeat = c.repeat AND a.model = c.model AND c.n_train > a.n_train")
def stat5_all_sizes(spark, sf):
    return rounded(panel.size_contrasts(b.panel(spark, sf), "loss", "all"))


_CHANGES = "ch AS (SELECT repeat, model, max(CASE WHEN n_train = 140 THEN loss END) - max(CASE WHEN n_train = 20 THEN loss END) AS change FROM panel GROUP BY ALL)"


@query(f"WITH {b.PANEL}, {_CHANGES} SELECT repeat, model, {r('change', 'change')} FROM ch")
def stat6_size_changes(spark, sf):
    return rounded(panel.size_changes(b.panel(spark, sf), "loss", 20, 140))


@query(f'WITH {b.PANEL}, {_CHANGES}, d AS (SELECT a.model AS "left", c.model AS "right", a.change - c.change AS v FROM ch a JOIN ch c USING (repeat) WHERE a.model < c.model) SELECT "left", "right", {_STATS} FROM d GROUP BY ALL')
def stat7_difference_in_changes(spark, sf):
    return rounded(panel.difference_in_changes(b.panel(spark, sf), "loss", 20, 140))


def _secondary(spark, sf):
    p = b.panel(spark, sf)
    changed = [p.select("repeat", "model", "n_train", F.lit(name).alias("intervention"), F.col(c).alias("loss")) for name, c in (("no_pairs", "null_loss"), ("half", "coverage"))]
    return p, changed[0].unionByName(changed[1])


@query(f"""WITH {b.PANEL}, s AS (SELECT repeat, model, n_train, 'no_pairs' AS intervention, null_loss - loss AS v FROM panel
  UNION ALL SELECT repeat, model, n_train, 'half', coverage - loss FROM panel) SELECT intervention, model, n_train, {_STATS} FROM s GROUP BY ALL""")
def stat8_secondary_effects(spark, sf):
    return rounded(panel.secondary_effects(*_secondary(spark, sf), "loss", "intervention"))


@query(f"""WITH {b.PANEL}, s AS (SELECT repeat, model, n_train, 'no_pairs' AS intervention, null_loss AS x FROM panel
  UNION ALL SELECT repeat, model, n_train, 'half', coverage FROM panel),
  d AS (SELECT intervention, a.n_train, a.model AS "left", c.model AS "right", a.x - c.x AS v FROM s a JOIN s c USING (repeat, n_train, intervention) WHERE a.model < c.model)
  SELECT intervention, "left", "right", n_train, {_STATS} FROM d GROUP BY ALL""")
def stat9_secondary_pairwise(spark, sf):
    return rounded(panel.secondary_pairwise(_secondary(spark, sf)[1], "loss", "intervention"))


_MEANS = "m AS (SELECT model, n_train, round(avg(loss), 9) AS mean, round(avg(null_loss), 9) AS other FROM panel GROUP BY ALL)"


def _means(spark, sf, metric="loss"):
    return b.panel(spark, sf).groupBy("model", "n_train").agg(F.round(F.avg(metric), 9).alias("mean"))


@query(f"WITH {b.PANEL}, {_MEANS} SELECT n_train, arg_min(model, struct_pack(a := mean, b := model)) AS leader, {r('min(mean)', 'leader_mean')} FROM m GROUP BY n_train")
def srt5_leaders(spark, sf):
    return rounded(panel.leaders(_means(spark, sf), ["n_train"]))


_RANK = "string_agg(model, ' > ' ORDER BY {0}, model)"


@query(f"WITH {b.PANEL}, {_MEANS} SELECT n_train, {_RANK.format('mean')} AS before, {_RANK.format('other')} AS after, {_RANK.format('mean')} <> {_RANK.format('other')} AS changed FROM m GROUP BY n_train")
def stat11_ranking_changes(spark, sf):
    return panel.ranking_changes(_means(spark, sf), _means(spark, sf, "null_loss"), ["n_train"])


@query(f"""WITH {b.PANEL}, k AS (SELECT model, n_train, rank() OVER (PARTITION BY repeat, n_train ORDER BY loss) AS place FROM panel)
  SELECT model, n_train, {r('avg(CASE WHEN place = 1 THEN 1.0::DOUBLE ELSE 0 END)', 'best_share')} FROM k GROUP BY ALL""")
def agg17_best_share(spark, sf):
    return rounded(panel.best_share(b.panel(spark, sf), "loss"))


@query(f"""WITH {b.PANEL}, w AS (SELECT model, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY repeat, n_train ORDER BY loss, model) AS k FROM panel) WHERE k = 1 GROUP BY model)
  SELECT model, coalesce(wins, 0) AS wins FROM (SELECT DISTINCT model FROM panel) LEFT JOIN w USING (model)""")
def agg18_winner_counts(spark, sf):
    return panel.winner_counts(b.panel(spark, sf), "loss")


@query("""WITH c AS (SELECT l_orderkey % 20 + 1 AS repeat, l_returnflag || l_linestatus AS model, l_partkey % 150 AS n_train, count(*) AS n FROM lineitem GROUP BY ALL),
  g AS (SELECT * FROM (SELECT unnest(range(1, 22)) AS repeat), (SELECT DISTINCT l_returnflag || l_linestatus AS model FROM lineitem), (SELECT unnest(range(10, 151)) AS n_train))
  SELECT repeat, model, n_train, coalesce(n, 0) AS n, CASE WHEN g.present IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem
  FROM (SELECT *, true AS present FROM g) g FULL JOIN c USING (repeat, model, n_train) WHERE n IS NULL OR n > 1 OR g.present IS NULL""")
def set3_grid_check(spark, sf):
    """Against an expected grid with a repeat and an anchor that no row has, and without ten anchors that rows have."""
    l_ = b.table(spark, sf, "lineitem")
    cells = l_.select((F.col("l_orderkey") % 20 + 1).alias("repeat"), F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_partkey") % 150).alias("n_train"))
    expected = cells.select("model").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(21).cast("long"))))
    expected = expected.withColumn("n_train", F.explode(F.sequence(F.lit(10).cast("long"), F.lit(150).cast("long"))))
    return panel.grid_check(cells, ["repeat", "model", "n_train"], expected)


@query("SELECT count_if(NOT coalesce(l_discount BETWEEN 0 AND 0.08, false)) AS discount, count_if(NOT coalesce(l_tax > 0, false)) AS tax, count_if(NOT coalesce(isfinite(l_extendedprice), false)) AS price FROM lineitem")
def set6_domain_check(spark, sf):
    c = F.col
    finite = c("l_extendedprice").isNotNull() & ~F.isnan("l_extendedprice") & (F.abs("l_extendedprice") < float("inf"))
    return panel.domain_check(b.table(spark, sf, "lineitem"), {"discount": c("l_discount").between(0, 0.08), "tax": c("l_tax") > 0, "price": finite})


@query(f"""WITH t AS (SELECT r_name AS task, l_returnflag || l_linestatus AS model, l_linenumber * 20 AS n_train, avg(l_discount) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
  SELECT model, n_train, count(*) AS n_tasks, {r('avg(v)', 'mean')}, {r('median(v)', 'median')}, {r('min(v)', 'low')}, {r('max(v)', 'high')}, string_agg(task, ',' ORDER BY task) AS tasks
  FROM t GROUP BY ALL HAVING count(*) >= 3""")
def stat12_suite_synthesis(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(b.games(spark, sf), F.col("o_custkey") == F.col("game"))
    l_ = b.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    p = l_.select(F.col("stratum").alias("task"), F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_linenumber") * 20).alias("n_train"), "l_discount")
    return rounded(panel.task_equal(p, "l_discount", 3))


@query("""WITH a AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), c AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 < 2)
  SELECT count(a.k) AS n_left, count(c.k) AS n_right, count_if(c.k IS NULL) AS left_only, count_if(a.k IS NULL) AS right_only,
    count_if(a.k IS NOT NULL AND c.k IS NOT NULL AND a.v IS DISTINCT FROM c.v) AS different FROM a FULL JOIN c ON a.k = c.k""")
def src10_table_comparison(spark, sf):
    a = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    c = b.table(spark, sf, "customer").where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return panel.compare_tables(a, c, ["k"], ["v"])


# -- frames and cohorts --------------------------------------------------------------------------------------

_CUT = f"""{b.MARKS}, hits AS (SELECT DISTINCT play, frame, lower(marker) AS e FROM marks WHERE lower(marker) IN ('purchase', 'signup')),
  el AS (SELECT DISTINCT play FROM marks),
  cut AS (SELECT play, count(DISTINCT frame) AS n_frames, min(frame) AS cutoff FROM hits GROUP BY play),
  ev AS (SELECT play, string_agg(DISTINCT e, '+' ORDER BY e) AS events FROM hits JOIN cut USING (play) WHERE frame = cutoff GROUP BY play)"""


def _cutoffs(spark, sf):
    m = b.marks(spark, sf)
    valid = m.where("value > 10").select("play", "frame")
    return m, frames.discover_cutoffs(m, m, "play", "frame", "marker", ["purchase", "signup"], valid=valid)


@query(f"""WITH {_CUT} SELECT play, coalesce(n_frames, 0) AS n_frames, cutoff, events,
  CASE WHEN n_frames IS NULL THEN 'no_marker' WHEN v.play IS NULL THEN 'invalid_frame' ELSE 'kept' END AS status
  FROM el LEFT JOIN cut USING (play) LEFT JOIN ev USING (play) LEFT JOIN (SELECT DISTINCT play, frame FROM marks WHERE value > 10) v ON v.play = el.play AND v.frame = cutoff""")
def win4_cutoffs(spark, sf):
    return _cutoffs(spark, sf)[1].select("play", "n_frames", "cutoff", "events", "status")


@query(f"""WITH {_CUT}, w AS (SELECT play, frame, row_number() OVER (PARTITION BY play ORDER BY frame DESC) AS k FROM (SELECT DISTINCT play, frame FROM marks) JOIN cut USING (play) WHERE frame <= cutoff)
  SELECT play, frame, cast(20 - k AS INTEGER) AS time_index FROM w WHERE k <= 20""")
def win1_history_windows(spark, sf):
    m, c = _cutoffs(spark, sf)
    return frames.history_windows(m, c.where("cutoff is not null"), "play", "frame", 20)


@query(f"""WITH {_CUT}, w AS (SELECT play, frame, row_number() OVER (PARTITION BY play ORDER BY frame DESC) AS k FROM (SELECT DISTINCT play, frame FROM marks) JOIN cut USING (play) WHERE frame <= cutoff)
  SELECT play, count(*) AS history, 20 - count(*) AS padding FROM w WHERE k <= 20 GROUP BY play""")
def agg5_history_length(spark, sf):
    m, c = _cutoffs(spark, sf)
    return frames.history_length(frames.history_windows(m, c.where("cutoff is not null"), "play", "frame", 20), "play", 20)


@query(f"""WITH {_CUT} SELECT coalesce(n_frames, 0) AS n_frames, count(*) AS plays FROM el LEFT JOIN cut USING (play) GROUP BY ALL""")
def agg6_marker_counts(spark, sf):
    return frames.marker_counts(_cutoffs(spark, sf)[1])


@query(f"""WITH {b.MARKS}, w AS (SELECT play, min(frame) AS lo, max(frame) AS hi, min(CASE WHEN marker = 'signup' THEN frame END) AS s,
    min(CASE WHEN marker IN ('error', 'purchase') THEN frame END) AS e, count(DISTINCT CASE WHEN marker = 'signup' THEN frame END) AS n_start FROM marks GROUP BY play)
  SELECT play, coalesce(s + 5, lo) AS start_frame, coalesce(e, hi) AS end_frame, n_start FROM w""")
def win5_active_window(spark, sf):
    return frames.active_window(b.marks(spark, sf), "play", "frame", "marker", ["signup"], ["error", "purchase"], 5)


@query(f"""WITH {b.TRACKING}, d AS (SELECT a.play, a.frame, (a.x - c.x) ** 2 + (a.y - c.y) ** 2 AS d2 FROM tracking a JOIN tracking c USING (play, frame) WHERE a.offense AND NOT c.offense),
  k AS (SELECT *, row_number() OVER (PARTITION BY play ORDER BY d2, frame) AS n FROM d) SELECT play, frame AS event_frame, {r('d2', 'd2', 5)} FROM k WHERE n = 1""")
def win6_nearest_frame(spark, sf):
    t = b.tracking(spark, sf)
    return rounded(frames.nearest_frame(t, "play", "frame", F.col("offense"), ~F.col("offense"), "x", "y"), 5)


@query(f"""WITH {b.TRACKING}, k AS (SELECT play, obj, min(CASE WHEN offense THEN 0 ELSE 1 END) AS o FROM tracking GROUP BY ALL)
  SELECT play, obj, cast(row_number() OVER (PARTITION BY play ORDER BY o, obj) - 1 AS INTEGER) AS slot, count(*) OVER (PARTITION BY play) > 8 AS overflow FROM k""")
def win8_stable_slots(spark, sf):
    return frames.stable_slots(b.tracking(spark, sf), "play", "obj", [F.when(F.col("offense"), 0).otherwise(1)], 8)


@query(f"""WITH {b.MARKS} SELECT play, frame, {r('(frame - max(frame) OVER (PARTITION BY play)) / 10.0::DOUBLE', 'to_last')} FROM marks""")
def win13_seconds_to_last(spark, sf):
    return rounded(frames.seconds_to_last(b.marks(spark, sf).select("play", "frame"), "play", "frame", 10.0))


@query(f"""WITH {b.MARKS} SELECT play, marker, max(frame) AS last_frame, {r('arg_max(value, frame)', 'value')} FROM marks GROUP BY ALL""")
def win15_final_state(spark, sf):
    return rounded(frames.final_state(b.marks(spark, sf), ["play", "marker"], "frame", ["value"]))


@query("""SELECT l_orderkey AS play, count(*) AS n_rows, min(l_linenumber) AS first, max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS n_distinct,
  min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY ALL""")
def agg7_completeness(spark, sf):
    return frames.completeness(b.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "play"), ["play"], "l_linenumber")


@query(f"""WITH {b.TRACKING}, f AS (SELECT play, frame, count(DISTINCT obj) AS n FROM tracking GROUP BY ALL), p AS (SELECT play, count(*) AS frames, max(n) AS objects FROM f GROUP BY ALL)
  SELECT max(frames) AS max_frames, max(objects) AS max_objects, count(*) AS plays FROM p""")
def agg8_extents(spark, sf):
    return frames.extents(b.tracking(spark, sf), "play", "frame", "obj")


@query(f"""WITH {b.TRACKING} SELECT * FROM tracking""")
def win3_first_occurrence(spark, sf):
    return b.tracking(spark, sf)


@query("""WITH o AS (SELECT *, coalesce(o_orderstatus IN ('F', 'O'), false) AS a, coalesce(o_totalprice > 50000, false) AS c, coalesce(o_orderpriority <> '5-LOW', false) AS d FROM orders)
  SELECT count(*) AS n_all, count_if(a) AS n_status, count_if(a AND c) AS n_price, count_if(a AND c AND d) AS n_priority, count_if(NOT a) AS excluded_status,
    count_if(a AND NOT c) AS excluded_price, count_if(a AND c AND NOT d) AS excluded_priority FROM o""")
def prj15_cohort_audit(spark, sf):
    rules = [("status", F.col("o_orderstatus").isin("F", "O")), ("price", F.col("o_totalprice") > 50000), ("priority", F.col("o_orderpriority") != "5-LOW")]
    return frames.cohort_audit(b.table(spark, sf, "orders"), rules)


@query(f"""WITH {b.MARKS}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY play, p > 0.2 ORDER BY frame) AS island, p > 0.2 AS up FROM marks)
  SELECT play, count(*) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame FROM g GROUP BY play""")
def win17_scored_frames(spark, sf):
    o = automaton.opportunities(b.marks(spark, sf), ["play"], "frame", "p", 0.2, 3)
    return o.select("play", F.col("n_frames").cast("long").alias("n_frames"), "first_frame", "last_frame")


@query(f"""WITH RECURSIVE {b.MARKS}, walk(play, frame, state, high, low, ev) AS (
  SELECT play, 0, 0, 0, 0, '' FROM (SELECT DISTINCT play FROM marks)
  UNION ALL
  SELECT w.play, m.frame,
    CASE WHEN m.p > 0.2 THEN CASE WHEN w.state <= 1 THEN CASE WHEN (CASE WHEN w.state = 0 THEN 1 ELSE w.high + 1 END) = 3 THEN 2 ELSE 1 END ELSE 2 END
      ELSE CASE WHEN w.state <= 1 THEN 0 WHEN (CASE WHEN w.state = 2 THEN 1 ELSE w.low + 1 END) = 3 THEN 0 ELSE 3 END END,
    CASE WHEN m.p > 0.2 AND w.state <= 1 THEN CASE WHEN w.state = 0 THEN 1 ELSE w.high + 1 END ELSE 0 END,
    CASE WHEN m.p > 0.2 OR w.state <= 1 THEN 0 WHEN w.state = 2 THEN 1 ELSE w.low + 1 END,
    CASE WHEN m.p > 0.2 AND w.state <= 1 AND (CASE WHEN w.state = 0 THEN 1 ELSE w.high + 1 END) = 3 THEN 'open'
      WHEN m.p <= 0.2 AND w.state >= 2 AND (CASE WHEN w.state = 2 THEN 1 ELSE w.low + 1 END) = 3 THEN 'miss' ELSE '' END
  FROM walk w JOIN marks m ON m.play = w.play AND m.frame = w.frame + 1)
  SELECT play, count_if(ev = 'open')::INTEGER AS opportunities, count_if(ev = 'miss')::INTEGER AS misses, coalesce(string_agg(frame::VARCHAR, ',' ORDER BY frame) FILTER (ev = 'open'), '') AS open_frames,
    coalesce(string_agg(frame::VARCHAR, ',' ORDER BY frame) FILTER (ev = 'miss'), '') AS miss_frames FROM walk GROUP BY play""")
def win16_opportunities(spark, sf):
    return automaton.opportunities(b.marks(spark, sf), ["play"], "frame", "p", 0.2, 3).select("play", "opportunities", "misses", "open_frames", "miss_frames")


# -- joins ---------------------------------------------------------------------------------------------------


@query(f"""WITH {b.TRACKING}, p AS (SELECT a.play, a.frame, a.obj AS a, c.obj AS b, a.x - c.x AS d_x, a.y - c.y AS d_y FROM tracking a JOIN tracking c USING (play, frame) WHERE a.obj <> c.obj AND a.offense AND NOT c.offense)
  SELECT play, frame, a, b, {r('d_x', 'd_x')}, {r('d_y', 'd_y')}, {r('sqrt(d_x ** 2 + d_y ** 2)', 'distance')} FROM p""")
def jn12_frame_pairs(spark, sf):
    t = b.tracking(spark, sf)
    return rounded(geometry.pairs(t, ["play", "frame"], "obj", F.col("offense"), ~F.col("offense"), ["x", "y"]))


_DIST = f"{b.TRACKING}, pr AS (SELECT a.play, a.frame, sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) AS d FROM tracking a JOIN tracking c USING (play, frame) WHERE a.obj <> c.obj AND a.offense AND NOT c.offense)"


@query(f"""WITH {_DIST}, f AS (SELECT play, frame, min(d) AS lo, avg(d) AS mid, stddev_pop(d) AS sd FROM pr GROUP BY ALL)
  SELECT play, {r('arg_max(lo, frame)', 'last_min')}, {r('arg_max(mid, frame)', 'last_mean')}, {r('arg_max(sd, frame)', 'last_sd')}, {r('avg(lo)', 'mean_of_min')},
    {r('arg_max(lo, frame) - arg_min(lo, frame)', 'change_of_min')}, {r('avg(mid)', 'mean_of_mean')} FROM f GROUP BY play""")
def feat2_relational_summary(spark, sf):
    t = b.tracking(spark, sf)
    p = geometry.pairs(t, ["play", "frame"], "obj", F.col("offense"), ~F.col("offense"), ["x", "y"])
    return rounded(geometry.relational_summary(p, "play", "frame"))


@query(f"""WITH {_DIST} SELECT play, {r('min(d)', 'distance_min')}, {r('avg(d)', 'distance_mean')}, {r('max(d)', 'distance_max')}, {r('stddev_pop(d)', 'distance_sd')} FROM pr GROUP BY play""")
def agg14_pair_grid(spark, sf):
    t = b.tracking(spark, sf)
    p = geometry.pairs(t, ["play", "frame"], "obj", F.col("offense"), ~F.col("offense"), ["x", "y"])
    return rounded(geometry.pair_grid_summary(p, "play", ["distance"]))


# -- geometry and features -----------------------------------------------------------------------------------


@query(f"""WITH {b.TRACKING} SELECT play, frame, obj, {r("CASE WHEN left THEN 120 - x ELSE x END", "nx")}, {r("CASE WHEN left THEN 160.0::DOUBLE / 3 - y ELSE y END", "ny")},
  {r("sin(radians((90 - dir + 360) % 360)) * CASE WHEN left THEN -1 ELSE 1 END", "dir_sin")}, {r("cos(radians((90 - dir + 360) % 360)) * CASE WHEN left THEN -1 ELSE 1 END", "dir_cos")} FROM tracking""".replace("WHEN left", 'WHEN "left"'))
def geo1_half_turn(spark, sf):
    x, y = geometry.rotate_left(F.col("x"), F.col("y"), F.col("left"))
    sin, cos = fn.angle_components(F.col("dir"), F.col("left"))
    return rounded(b.tracking(spark, sf).select("play", "frame", "obj", x.alias("nx"), y.alias("ny"), sin.alias("dir_sin"), cos.alias("dir_cos")))


@query(f"""WITH {b.TRACKING}, d AS (SELECT *, (90 - dir + 360) % 360 AS m FROM tracking), e AS (SELECT *, CASE WHEN "left" THEN (180 - m + 360) % 360 ELSE m END AS nd FROM d)
  SELECT play, frame, obj, {r('CASE WHEN "left" THEN 120 - x ELSE x END', 'nx')}, {r('nd', 'nd')}, {r('s * cos(radians(nd))', 'vx')}, {r('s * sin(radians(nd))', 'vy')} FROM e""")
def geo2_reflection(spark, sf):
    g = geometry.reflect_left(F.col("x"), F.col("dir"), F.col("s"), F.col("left"))
    return rounded(b.tracking(spark, sf).select("play", "frame", "obj", g["x"].alias("nx"), g["dir"].alias("nd"), g["vx"].alias("vx"), g["vy"].alias("vy")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice / 64, 2) + 0.0 AS q FROM lineitem")
def geo3_quantize(spark, sf):
    l_ = b.table(spark, sf, "lineitem")
    return l_.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (geometry.quantize(F.col("l_extendedprice") / 64, 2) + 0.0).alias("q"))


@query(f"""WITH {b.TRACKING}, w AS (SELECT *, min(CASE WHEN offense THEN x END) OVER f AS ax, min(CASE WHEN offense THEN y END) OVER f AS ay FROM tracking WINDOW f AS (PARTITION BY play, frame))
  SELECT play, frame, obj, {r('x - ax', 'x_rel')}, {r('y - ay', 'y_rel')} FROM w""")
def geo6_centred(spark, sf):
    c = geometry.centred(b.tracking(spark, sf), ["play", "frame"], F.col("offense"), "x", "y")
    return rounded(c.select("play", "frame", "obj", "x_rel", "y_rel"))


@query(f"WITH {b.TRACKING} SELECT play, frame, obj, min(CASE WHEN offense THEN obj END) OVER (PARTITION BY play, frame) AS focal FROM tracking")
def geo7_inferred_focal(spark, sf):
    return geometry.inferred_focal(b.tracking(spark, sf), ["play", "frame"], F.col("offense"), "obj").select("play", "frame", "obj", "focal")


@query(f"""WITH {b.TRACKING}, l AS (SELECT play, obj, arg_max(x, frame) AS x, arg_max(y, frame) AS y, arg_max(s, frame) AS s FROM tracking GROUP BY ALL)
  SELECT play, obj, cast(t AS INTEGER) AS t, {r('x + t / 10.0::DOUBLE * s', 'px')}, {r('y + t / 10.0::DOUBLE * (0 - s)', 'py')} FROM l, range(1, 6) AS h(t)""")
def geo10_constant_velocity(spark, sf):
    last = frames.final_state(b.tracking(spark, sf), ["play", "obj"], "frame", ["x", "y", "s"]).withColumn("vy", -F.col("s"))
    return rounded(geometry.constant_velocity(last, ["play", "obj"], 5, 10.0, "x", "y", "s", "vy"))


@query(f"""WITH {b.TRACKING} SELECT play::VARCHAR AS play, frame, obj, {r('y', 'y')}, {r('dir', 'dir')} FROM tracking
  UNION ALL SELECT play || '_aug', frame, obj, {r('160.0::DOUBLE / 3 - y', 'y')}, {r('2 * pi() - dir', 'dir')} FROM tracking WHERE play % 10 = 0""")
def geo14_mirrored(spark, sf):
    t = b.tracking(spark, sf).select("play", "frame", "obj", "y", "dir")
    return rounded(geometry.mirrored(t, t.where("play % 10 = 0"), "play", "y", "dir"))


@query(f"""WITH {b.TRACKING}, t AS (SELECT *, frame = max(frame) OVER (PARTITION BY play) AS z FROM tracking)
  SELECT play, count_if(z AND offense) AS off_count, {r('avg(x) FILTER (z AND offense)', 'off_x_mean')}, {r('stddev_pop(x) FILTER (z AND offense)', 'off_x_sd')}, {r('min(x) FILTER (z AND offense)', 'off_x_min')},
    {r('max(x) FILTER (z AND offense)', 'off_x_max')}, count_if(z AND NOT offense) AS def_count, {r('avg(x) FILTER (z AND NOT offense)', 'def_x_mean')}, {r('stddev_pop(x) FILTER (z AND NOT offense)', 'def_x_sd')},
    {r('min(x) FILTER (z AND NOT offense)', 'def_x_min')}, {r('max(x) FILTER (z AND NOT offense)', 'def_x_max')}, {r('avg(x)', 'all_x_mean')}, {r('stddev_pop(x)', 'all_x_sd')} FROM t GROUP BY play""")
def feat1_token_summary(spark, sf):
    return rounded(geometry.token_summary(b.tracking(spark, sf), "play", "frame", {"off": F.col("offense"), "def": ~F.col("offense")}, ["x"]))


@query(f"""WITH {b.TRACKING}, k AS (SELECT play, obj, row_number() OVER (PARTITION BY play ORDER BY o, obj) - 1 AS slot FROM (SELECT play, obj, min(CASE WHEN offense THEN 0 ELSE 1 END) AS o FROM tracking GROUP BY ALL)),
  z AS (SELECT play, obj, x FROM (SELECT *, max(frame) OVER (PARTITION BY play) AS mf FROM tracking) WHERE frame = mf)
  SELECT play, {r('max(x) FILTER (slot = 0)', 's0_x')}, {r('max(x) FILTER (slot = 1)', 's1_x')}, {r('max(x) FILTER (slot = 2)', 's2_x')} FROM z JOIN k USING (play, obj) GROUP BY play""")
def feat3_slot_columns(spark, sf):
    t = b.tracking(spark, sf)
    slots = frames.stable_slots(t, "play", "obj", [F.when(F.col("offense"), 0).otherwise(1)], 8)
    last = t.withColumn("mf", F.max("frame").over(Window.partitionBy("play"))).where("frame = mf")
    return rounded(geometry.slot_columns(last.join(slots, ["play", "obj"]), "play", "slot", 3, ["x"]))


@query(f"""WITH {b.TRACKING}, p AS (SELECT a.x - c.x AS dx, a.y - c.y AS dy FROM tracking a JOIN tracking c USING (play, frame) WHERE a.obj <> c.obj)
  SELECT CASE WHEN abs(dy) < 5 THEN 'lateral' WHEN sqrt(dx ** 2 + dy ** 2) < 20 THEN 'near' ELSE 'other' END AS edge, count(*) AS n FROM p GROUP BY ALL""")
def feat6_edge_types(spark, sf):
    t = b.tracking(spark, sf)
    p = geometry.pairs(t, ["play", "frame"], "obj", F.lit(True), F.lit(True), ["x", "y"])
    typed = geometry.edge_types(p, [("near", F.col("distance") < 20), ("lateral", F.abs("d_y") < 5)])
    return typed.groupBy("edge").agg(F.count("*").alias("n"))


@query(f"""WITH {b.TRACKING}, c AS (SELECT *, cast(least(greatest(floor(x / 4), 0), 29) AS INTEGER) AS xbin, cast(least(greatest(floor(y / 4), 0), 13) AS INTEGER) AS ybin FROM tracking)
  SELECT play, frame, xbin, ybin, count(*) AS occupancy, count_if(offense) AS off, {r('avg(s)', 'mean_s')} FROM c GROUP BY ALL""")
def feat8_raster(spark, sf):
    return rounded(geometry.raster(b.tracking(spark, sf), ["play", "frame"], "x", "y", {"off": F.col("offense")}, ["s"], (30, 14), 4.0))


@query(f"""WITH {b.TRACKING}, p AS (SELECT a.play, a.frame, a.obj, c.x - a.x AS dx, c.y - a.y AS dy, a.s, radians(a.dir) AS h FROM tracking a JOIN tracking c USING (play, frame) WHERE a.obj <> c.obj),
  q AS (SELECT *, dx - 0.5::DOUBLE * s * cos(h) AS cx, dy - 0.5::DOUBLE * s * sin(h) AS cy, 3 * (1 + s / 18) / 2 AS al, 3 * (1 - s / 18) / 2 AS ac FROM p)
  SELECT play, frame, obj, {r('sum(exp(-0.5::DOUBLE * (((cx * cos(h) + cy * sin(h)) / al) ** 2 + ((cy * cos(h) - cx * sin(h)) / ac) ** 2)) / (2 * pi() * al * ac))', 'influence')} FROM q GROUP BY ALL""")
def feat11_influence(spark, sf):
    t = b.tracking(spark, sf)
    p = geometry.pairs(t.withColumn("h", F.radians("dir")), ["play", "frame"], "obj", F.lit(True), F.lit(True), ["x", "y"], ("s", "h"))
    value = geometry.influence(-F.col("d_x"), -F.col("d_y"), F.col("a_s"), F.col("a_h"))
    return rounded(p.groupBy("play", "frame", F.col("a").alias("obj")).agg(F.sum(value).alias("influence")))


@query(f"""WITH {b.TRACKING}, cl AS (SELECT play, frame, obj, least(greatest(x, 0), 120) AS cx, least(greatest(y, 0), 53) AS cy FROM tracking),
  site AS (SELECT c.play, c.frame, c.obj, p.cx AS x, p.cy AS y FROM cl c JOIN cl p ON p.play = c.play AND p.frame = c.frame AND p.obj <> c.obj
    UNION ALL SELECT play, frame, obj, cx - 10, cy FROM cl UNION ALL SELECT play, frame, obj, 10 - cx, cy FROM cl WHERE cx < 10),
  half AS (SELECT play, frame, obj, row_number() OVER (PARTITION BY play, frame, obj) AS k, a, bb, c FROM (
    SELECT s.play, s.frame, s.obj, s.x - c.cx AS a, s.y - c.cy AS bb, (s.x * s.x - c.cx * c.cx + s.y * s.y - c.cy * c.cy) / 2 AS c FROM site s JOIN cl c USING (play, frame, obj) WHERE s.x <> c.cx OR s.y <> c.cy
    UNION ALL SELECT play, frame, obj, e.a, e.bb, e.c FROM cl, (VALUES (1.0::DOUBLE, 0.0::DOUBLE, 120.0::DOUBLE), (-1, 0, 0), (0, 1, 53), (0, -1, 0)) e(a, bb, c))),
  vert AS (SELECT h.play, h.frame, h.obj, (h.c * g.bb - g.c * h.bb) / (h.a * g.bb - g.a * h.bb) AS x, (h.a * g.c - g.a * h.c) / (h.a * g.bb - g.a * h.bb) AS y
    FROM half h JOIN half g ON h.play = g.play AND h.frame = g.frame AND h.obj = g.obj AND h.k < g.k WHERE abs(h.a * g.bb - g.a * h.bb) > 1e-12),
  good AS (SELECT DISTINCT play, frame, obj, round(x, 9) AS x, round(y, 9) AS y FROM (SELECT v.play, v.frame, v.obj, v.x, v.y FROM vert v JOIN half h USING (play, frame, obj) GROUP BY ALL
    HAVING max((h.a * v.x + h.bb * v.y - h.c) / greatest(sqrt(h.a ** 2 + h.bb ** 2), 1e-12)) <= 1e-7)),
  ring AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS turn FROM good WINDOW w AS (PARTITION BY play, frame, obj)),
  edge AS (SELECT play, frame, obj, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ring WINDOW w AS (PARTITION BY play, frame, obj ORDER BY turn, x, y)),
  area AS (SELECT play, frame, obj, abs(sum(x * ny - nx * y)) / 2 AS v FROM edge GROUP BY ALL)
  SELECT play, frame, obj, {r('coalesce(v, 0) + 0.0000123', 'area', 3)} FROM cl LEFT JOIN area USING (play, frame, obj)""")
def feat12_cell_area(spark, sf):
    t = b.tracking(spark, sf)
    site = F.struct("obj", F.struct("x", "y").alias("at"))
    per = t.groupBy("play", "frame").agg(F.collect_list(site).alias("sites"))  # a frame's objects meet in one row
    j = per.withColumn("own", F.explode("sites")).select("play", "frame", "sites", "own.obj", "own.at.x", "own.at.y")
    others = F.transform(F.filter("sites", lambda s: s["obj"] != F.col("obj")), lambda s: s["at"])
    return rounded(j.select("play", "frame", "obj", (geometry.carrier_area(F.col("x"), F.col("y"), others) + 0.0000123).alias("area")), 3)  # off the ties of rounding


# -- scores --------------------------------------------------------------------------------------------------


@query(f"""WITH {b.BINARY}, c AS (SELECT *, greatest(least(p, 1 - 1e-12), 1e-12) AS q, 0.4::DOUBLE AS np FROM bin WHERE NOT is_cal),
  v AS (SELECT cell, game, y - p AS bias, (p - y) ** 2 AS brier, -(y * ln(q) + (1 - y) * ln(1 - q)) AS log_loss, (np - y) ** 2 AS null_brier, -(q * ln(q) + (1 - q) * ln(1 - q)) AS entropy FROM c),
  pl AS (SELECT cell, count(*) AS n, avg(brier) AS pb, avg(log_loss) AS pll, avg(null_brier) AS pn, avg(bias) AS pbi, avg(entropy) AS pe FROM v GROUP BY cell),
  g AS (SELECT cell, game, avg(brier) AS b, avg(log_loss) AS l, avg(null_brier) AS n, avg(bias) AS bi, avg(entropy) AS e FROM v GROUP BY ALL),
  gm AS (SELECT cell, avg(b) AS gb, avg(l) AS gl, avg(n) AS gn, avg(bi) AS gbi, avg(e) AS ge FROM g GROUP BY cell)
  SELECT cell, n, {r('pb', 'play_brier')}, {r('pll', 'play_log_loss')}, {r('pn', 'play_null_brier')}, {r('pbi', 'play_bias')}, {r('pe', 'play_entropy')}, {r('gb', 'game_brier')}, {r('gl', 'game_log_loss')},
    {r('gn', 'game_null_brier')}, {r('gbi', 'game_bias')}, {r('ge', 'game_entropy')}, {r('1 - pb / pn', 'play_skill')}, {r('1 - gb / gn', 'game_skill')} FROM pl JOIN gm USING (cell)""")
def met11_binary_row(spark, sf):
    t = b.binary(spark, sf).where("not is_cal").withColumn("np", F.lit(0.4))
    return rounded(scores.binary_row(t, ["cell"], "game", "p", "y", "np"))


_CRPS = f"""{b.PMFS}, c AS (SELECT "row", any_value(game) AS game, any_value(cell) AS cell, sum((cdf - CASE WHEN k >= y THEN 1 ELSE 0 END) ** 2) AS ss, count(*) AS kk, sum(p * k) AS m,
  sum(p * k * k) AS m2, -sum(p * ln(p)) AS ent FROM pmf GROUP BY "row")"""


@query(f'WITH {_CRPS} SELECT "row", {r("ss / kk", "crps")}, {r("ss / 199", "crps_199")}, {r("m", "mean")}, {r("sqrt(m2 - m * m)", "sd", 5)}, {r("ent", "entropy")} FROM c')
def met3_crps(spark, sf):
    p = b.pmfs(spark, sf)
    out = p.select("row", scores.crps(F.col("pmf"), F.col("y")).alias("crps"), (scores.crps_sum(F.col("pmf"), F.col("y")) / 199).alias("crps_199"), fn.pmf_mean(F.col("pmf")).alias("mean"),
                   fn.pmf_sd(F.col("pmf")).alias("sd"), fn.pmf_entropy(F.col("pmf")).alias("entropy"))
    return rounded(out).withColumn("sd", F.round("sd", 5) + 0.0)


@query(f"WITH {_CRPS}, g AS (SELECT cell, game, avg(ss / kk) AS v FROM c GROUP BY ALL) SELECT cell, {r('avg(v)', 'crps')} FROM g GROUP BY cell")
def agg9_game_equal(spark, sf):
    p = b.pmfs(spark, sf)
    return rounded(scores.game_equal(p, ["cell"], "game", {"crps": scores.crps(F.col("pmf"), F.col("y"))}))


@query(f"WITH {b.BINARY}, g AS (SELECT cell, game, quantile_cont(abs(y - p), 0.9) AS v FROM bin GROUP BY ALL) SELECT cell, {r('avg(v)', 'quantile')} FROM g GROUP BY cell")
def agg11_game_equal_quantile(spark, sf):
    return rounded(scores.game_equal_quantile(b.binary(spark, sf), ["cell"], "game", F.abs(F.col("y") - F.col("p")), 0.9))


@query(f"WITH {b.BINARY}, g AS (SELECT cell, game, avg((p - y) ** 2) AS v FROM bin WHERE y = 1 GROUP BY ALL) SELECT cell, {r('avg(v)', 'positive_brier')} FROM g GROUP BY cell")
def agg10_game_equal_label(spark, sf):
    t = b.binary(spark, sf)
    value = F.when(F.col("y") == 1, scores.brier(F.col("p"), F.col("y")))
    return rounded(scores.game_equal(t, ["cell"], "game", {"positive_brier": value}))


@query(f"""WITH {b.BINARY}, q AS (SELECT cell, list_distinct([quantile_cont(p, k / 10.0::DOUBLE) FOR k IN [1]]) AS c FROM bin WHERE is_cal GROUP BY cell),
  cuts AS (SELECT DISTINCT cell, unnest(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS c FROM bin WHERE is_cal GROUP BY cell),
  t AS (SELECT b."row", b.cell, any_value(y) AS y, any_value(p) AS p, count(c) AS k FROM bin b LEFT JOIN cuts ON cuts.cell = b.cell AND c <= p WHERE NOT is_cal GROUP BY ALL),
  n AS (SELECT cell, k, count(*) AS n, avg(y) - avg(p) AS gap FROM t GROUP BY ALL)
  SELECT cell, {r('sqrt(sum(n * gap * gap) / sum(n))', 'reliability')}, count(*) AS n_bins FROM n GROUP BY cell""".replace("q AS (SELECT cell, list_distinct([quantile_cont(p, k / 10.0::DOUBLE) FOR k IN [1]]) AS c FROM bin WHERE is_cal GROUP BY cell),\n  ", ""))
def met8_reliability(spark, sf):
    t = b.binary(spark, sf)
    return rounded(scores.reliability(t.where("is_cal"), t.where("not is_cal"), ["cell"], "p", "y"))


_PATH = f"{b.TRACKING}, e AS (SELECT play, sum((x - 50) ** 2 + (y - 25) ** 2) AS sse, count(*) AS n_points FROM tracking GROUP BY play)"


@query(f"WITH {_PATH} SELECT play, {r('sse', 'sse', 5)}, n_points, {r('sse / (2 * n_points)', 'mse', 5)} FROM e")
def met5_path_errors(spark, sf):
    return rounded(scores.path_errors(b.tracking(spark, sf), "play", F.col("x") - 50, F.col("y") - 25), 5)


@query(f"WITH {_PATH} SELECT play % 10 AS cell, {r('sqrt(sum(sse) / (2 * sum(n_points)))', 'rmse')} FROM e GROUP BY ALL")
def met6_pooled_rmse(spark, sf):
    e = scores.path_errors(b.tracking(spark, sf), "play", F.col("x") - 50, F.col("y") - 25)
    return rounded(scores.pooled_rmse(e.withColumn("cell", F.col("play") % 10), ["cell"]))


@query(f"""WITH {b.PMFS}, t AS (SELECT DISTINCT "row", cell, y FROM pmf WHERE is_cal), n AS (SELECT cell, y AS k, count(*) AS n FROM t GROUP BY ALL),
  s AS (SELECT cell, cast(k AS INTEGER) AS k FROM (SELECT DISTINCT cell FROM t), range(64) AS x(k)), f AS (SELECT cell, k, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (cell, k))
  SELECT cell, k, {r('n / sum(n) OVER (PARTITION BY cell)', 'p')}, {r('sum(n) OVER (PARTITION BY cell ORDER BY k) / sum(n) OVER (PARTITION BY cell)', 'cdf')} FROM f""")
def enc6_empirical_null(spark, sf):
    return rounded(scores.empirical_null(b.pmfs(spark, sf).where("is_cal"), ["cell"], "y", 64))


@query(f"WITH {b.BINARY} SELECT cell, {r('(sum(y) + 0.5::DOUBLE) / (count(*) + 1)', 'prevalence')} FROM bin WHERE is_cal GROUP BY cell")
def enc7_prevalence(spark, sf):
    return rounded(scores.prevalence(b.binary(spark, sf).where("is_cal"), ["cell"], "y"))


# -- conformal -----------------------------------------------------------------------------------------------

_PICK = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}game ORDER BY "row") - 1 AS i, count(*) OVER (PARTITION BY {by}game) AS n FROM {src})
  WHERE i = cast('0x' || substr(sha256('rows|{seed}|' || game), 1, 16) AS UBIGINT) % n)"""
_ITV = f"""{b.PMFS}, itv AS (SELECT "row", any_value(game) AS game, any_value(cell) AS cell, any_value(y) AS y, any_value(is_cal) AS is_cal, min(k) FILTER (cdf >= 0.05 - 1e-12) AS lo, min(k) FILTER (cdf >= 0.95 - 1e-12) AS hi FROM pmf GROUP BY "row")"""


def _intervals(spark, sf):
    p = b.pmfs(spark, sf)
    lo, hi = conformal.central_interval(F.col("pmf"), 0.1)
    return p.select("row", "game", "cell", "y", "is_cal", lo.alias("lo"), hi.alias("hi"))


@query(f'WITH {_ITV} SELECT "row", cast(lo AS INTEGER) AS lo, cast(hi AS INTEGER) AS hi, cast(greatest(lo - y, y - hi, 0) AS INTEGER) AS score FROM itv')
def cal1_central_interval(spark, sf):
    i = _intervals(spark, sf)
    return i.select("row", "lo", "hi", conformal.interval_score(F.col("lo"), F.col("hi"), F.col("y")).alias("score"))


@query(f"""WITH {_ITV}, s AS (SELECT cell, greatest(lo - y, y - hi, 0) AS v FROM itv WHERE is_cal),
  k AS (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY v) AS i, count(*) OVER (PARTITION BY cell) AS n FROM s)
  SELECT cell, max(n) AS n_cal, cast(ceil((max(n) + 1) * 0.9::DOUBLE - 1e-9) AS BIGINT) AS rank,
    cast(coalesce(max(v) FILTER (i = cast(ceil((n + 1) * 0.9::DOUBLE - 1e-9) AS BIGINT)), 64) AS DOUBLE) AS quantile FROM k GROUP BY cell""")
def cal3_split_quantile(spark, sf):
    i = _intervals(spark, sf).where("is_cal").withColumn("s", conformal.interval_score(F.col("lo"), F.col("hi"), F.col("y")))
    return conformal.split_quantile(i, ["cell"], "s", 0.1, 64.0)


@query(f"""WITH {_ITV}, cal AS {_PICK.format(by='cell, ', src='itv WHERE is_cal', seed=9)}, s AS (SELECT cell, greatest(lo - y, y - hi, 0) AS v FROM cal),
  k AS (SELECT cell, v, row_number() OVER (PARTITION BY cell ORDER BY v) AS i, count(*) OVER (PARTITION BY cell) AS n FROM s),
  q AS (SELECT cell, coalesce(max(v) FILTER (i = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 64) AS q FROM k GROUP BY cell),
  t AS (SELECT "row", cell, y, greatest(0, lo - q) AS lower, least(63, hi + q) AS upper FROM itv JOIN q USING (cell) WHERE NOT is_cal)
  SELECT "row", cast(lower AS BIGINT) AS lower, cast(upper AS BIGINT) AS upper, cast(upper - lower AS BIGINT) AS width, y BETWEEN lower AND upper AS hit FROM t""")
def cal5_clustered_intervals(spark, sf):
    i = _intervals(spark, sf)
    out = conformal.clustered_intervals(i.where("is_cal"), i.where("not is_cal"), ["cell"], "game", "row", "lo", "hi", "y", 64, 0.1, 9)
    return out.select("row", "lower", "upper", "width", "hit")


def _label_quantile(label: int) -> str:
    return f"""c{label} AS {_PICK.format(by='cell, ', src=f'bin WHERE is_cal AND y = {label}', seed=5 + label)},
  k{label} AS (SELECT cell, {'1 - p' if label else 'p'} AS v, row_number() OVER (PARTITION BY cell ORDER BY {'1 - p' if label else 'p'}) AS i, count(*) OVER (PARTITION BY cell) AS n FROM c{label}),
  q{label} AS (SELECT cell, coalesce(max(v) FILTER (i = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 1) AS q{label} FROM k{label} GROUP BY cell)"""


@query(f"""WITH {b.BINARY}, {_label_quantile(0)}, {_label_quantile(1)},
  t AS (SELECT "row", p <= coalesce(q0, 1) + 1e-12 AS in0, 1 - p <= coalesce(q1, 1) + 1e-12 AS in1 FROM bin LEFT JOIN q0 USING (cell) LEFT JOIN q1 USING (cell) WHERE NOT is_cal)
  SELECT "row", in0, in1, in0::INTEGER + in1::INTEGER AS set_size FROM t""")
def cal7_label_sets(spark, sf):
    t = b.binary(spark, sf)
    out = conformal.label_sets(t.where("is_cal"), t.where("not is_cal"), ["cell"], "game", "row", "p", "y", 0.1, 5)
    return out.select("row", "in0", "in1", "set_size")


@query(f"""WITH {b.BINARY} SELECT cell, game, "row", y FROM (SELECT *, row_number() OVER (PARTITION BY cell, game ORDER BY sha256(concat_ws('|', '3', cell, game, "row")), "row") AS i FROM bin) WHERE i = 1""")
def win19_smallest_digest(spark, sf):
    return conformal.smallest_digest(b.binary(spark, sf), ["cell"], "game", "row", 3).select("cell", "game", "row", "y")


@query(f"""WITH {b.BINARY} SELECT game, "row", y FROM {_PICK.format(by='', src='bin', seed=17)}""")
def win18_one_per_game(spark, sf):
    return conformal.one_per_game(b.binary(spark, sf), [], "game", "row", 17).select("game", "row", "y")


def _points(spark, sf):
    t = b.binary(spark, sf)
    return t.select("cell", F.round("p", 1).alias("x"), F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w"))


_ISO = f"""{b.BINARY}, g AS (SELECT cell, round(p, 1) AS x, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS wy FROM bin GROUP BY ALL),
  seg AS (SELECT a.cell, a.x AS xa, c.x AS xb, sum(m.wy) / sum(m.w) AS mean FROM g a JOIN g c ON a.cell = c.cell AND a.x <= c.x JOIN g m ON m.cell = a.cell AND m.x BETWEEN a.x AND c.x GROUP BY ALL),
  lo AS (SELECT g.cell, g.x, xa, min(mean) AS v FROM g JOIN seg ON seg.cell = g.cell AND xa <= g.x AND xb >= g.x GROUP BY ALL)"""


@query(f"WITH {_ISO} SELECT lo.cell, {r('lo.x', 'x')}, any_value(g.w) AS weight, {r('max(v)', 'fitted')} FROM lo JOIN g USING (cell, x) GROUP BY lo.cell, lo.x")
def cal11_isotonic(spark, sf):
    return rounded(conformal.isotonic(_points(spark, sf), ["cell"], "x", "y", "w"))


@query(f"""WITH {b.BINARY}, g AS (SELECT cell, round(p, 1) AS x, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS wy FROM bin WHERE is_cal GROUP BY ALL),
  t AS (SELECT DISTINCT cell, round(p, 1) AS t FROM bin WHERE NOT is_cal), lab AS (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS lab),
  u AS (SELECT cell, t, lab, x, w + CASE WHEN x = t THEN 1 ELSE 0 END AS w, wy + CASE WHEN x = t THEN lab ELSE 0 END AS wy FROM t JOIN g USING (cell), lab
    UNION ALL SELECT cell, t, lab, t, 1, lab FROM t, lab WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cell = t.cell AND g.x = t.t)),
  seg AS (SELECT a.cell, a.t, a.lab, a.x AS xa, c.x AS xb, sum(m.wy) / sum(m.w) AS mean FROM u a JOIN u c ON a.cell = c.cell AND a.t = c.t AND a.lab = c.lab AND a.x <= a.t AND c.x >= c.t
    JOIN u m ON m.cell = a.cell AND m.t = a.t AND m.lab = a.lab AND m.x BETWEEN a.x AND c.x GROUP BY ALL),
  lo AS (SELECT cell, t, lab, xa, min(mean) AS v FROM seg GROUP BY ALL), f AS (SELECT cell, t, max(v) FILTER (lab = 0) AS p0, max(v) FILTER (lab = 1) AS p1 FROM (SELECT cell, t, lab, max(v) AS v FROM lo GROUP BY ALL) GROUP BY ALL)
  SELECT "row", {r('p0', 'p0')}, {r('p1', 'p1')}, {r('p1 / (1 - p0 + p1)', 'point')}, {r('p1 - p0', 'imprecision')} FROM bin JOIN f ON f.cell = bin.cell AND f.t = round(bin.p, 1) WHERE NOT is_cal""")
def cal8_venn_abers(spark, sf):
    t = b.binary(spark, sf)
    out = conformal.venn_abers(t.where("is_cal"), t.where("not is_cal"), ["cell"], "p", "y", 1)
    return rounded(out.select("row", "p0", "p1", "point", "imprecision"))


@query()
def cal8_venn_abers_exact(spark, sf):
    t = b.binary(spark, sf)
    out = conformal.venn_abers(t.where("is_cal"), t.where("not is_cal"), ["cell"], "p", "y")
    return rounded(out.select("row", "p0", "p1", "point", "imprecision"))


def _paths(spark, sf):
    l_ = b.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.abs(F.col("l_quantity") - 25)).alias("radial"))
    o = b.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("game"))
    return l_.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("row"), "game", F.col("l_linenumber").alias("h"), "radial")


_PATHS = """paths AS (SELECT l_orderkey AS "row", o_custkey % 200 AS game, l_linenumber AS h, max(abs(l_quantity - 25)) AS radial FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(f"""WITH {_PATHS}, sc AS (SELECT h, max(radial) / 2 AS scale FROM paths GROUP BY h), s AS (SELECT "row", game, max(radial / scale) AS score, avg(scale) AS m FROM paths JOIN sc USING (h) GROUP BY ALL),
  c AS {_PICK.format(by='', src='s WHERE "row" % 2 = 0', seed=4)}, k AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM c),
  q AS (SELECT coalesce(max(score) FILTER (i = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 1e6) AS q FROM k)
  SELECT "row", game, {r('score', 'score')}, score <= q + 1e-12 AS covered, {r('2 * q * m', 'diameter')} FROM s, q WHERE "row" % 2 = 1""")
def cal9_path_tube(spark, sf):
    p = _paths(spark, sf)
    scale = p.groupBy("h").agg((F.max("radial") / 2).alias("scale"))
    return rounded(conformal.path_tube(p.where("row % 2 = 0"), p.where("row % 2 = 1"), scale, "row", "game", "h", "radial", 0.1, 4))


@query(f"""WITH {_PATHS}, fm AS (SELECT h, game % 5 AS fold, quantile_cont(radial, 0.5) AS v, count(*) AS n FROM paths GROUP BY ALL),
  cu AS (SELECT *, sum(n) OVER (PARTITION BY h ORDER BY v, n, fold) AS upto, sum(n) OVER (PARTITION BY h) AS total FROM fm),
  rw AS (SELECT h, greatest(min(v) FILTER (upto >= total / 2.0::DOUBLE - 1e-12), 0.25) AS raw, any_value(total)::DOUBLE AS w FROM cu GROUP BY h),
  sg AS (SELECT a.h AS ha, c.h AS hb, sum(m.w * m.raw) / sum(m.w) AS mean FROM rw a JOIN rw c ON a.h <= c.h JOIN rw m ON m.h BETWEEN a.h AND c.h GROUP BY ALL),
  lo AS (SELECT rw.h, ha, min(mean) AS v FROM rw JOIN sg ON ha <= rw.h AND hb >= rw.h GROUP BY ALL)
  SELECT h, {r('max(v)', 'scale')} FROM lo GROUP BY h""")
def cal10_horizon_scale(spark, sf):
    m = _paths(spark, sf).groupBy("h", (F.col("game") % 5).alias("fold")).agg(F.percentile("radial", F.lit(0.5)).alias("median"), F.count("*").alias("n"))
    return rounded(conformal.horizon_scale(m, "h", "median", "n"))


# -- split design --------------------------------------------------------------------------------------------

_CAPS = f"{b.GAMES}, caps AS (SELECT stratum, count(*) AS capacity FROM games GROUP BY stratum)"


def _alloc(name: str, total: str) -> str:
    return f"""{name}0 AS (SELECT *, ({total}) * capacity // s AS base, ({total}) * capacity % s AS rem FROM (SELECT *, sum(capacity) OVER ()::BIGINT AS s FROM caps)),
  {name} AS (SELECT stratum, capacity, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, stratum) <= ({total}) - sum(base) OVER () THEN 1 ELSE 0 END AS allocation FROM {name}0)"""


@query(f"WITH {_CAPS}, {_alloc('al', '137')} SELECT stratum, capacity, cast(allocation AS BIGINT) AS allocation FROM al")
def des4_largest_remainder(spark, sf):
    caps = b.games(spark, sf).groupBy("stratum").agg(F.count("*").alias("capacity"))
    return design.largest_remainder(caps, [], "stratum", "capacity", F.lit(137))


@query(f"""WITH {_CAPS}, {_alloc('al', '200')}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat_ws('|', game, 'development', 7)), game) AS place FROM games)
  SELECT game, stratum, place <= allocation AS held_out FROM k JOIN al USING (stratum)""")
def des5_hold_out(spark, sf):
    return design.hold_out(b.games(spark, sf), "game", "stratum", 200, 7).select("game", "stratum", "held_out")


_ROLES = {"train": 120, "calibration": 60, "test": 80}
_SPLITS = f"""{_CAPS}, {_alloc('tr', '120')}, {_alloc('ca', '60')}, {_alloc('te', '80')},
  k AS (SELECT r.r AS repeat, game, stratum, row_number() OVER (PARTITION BY r.r, stratum ORDER BY sha256(concat_ws('|', game, 'outer', r.r + 11)), game) AS place FROM games, range(1, 11) AS r(r)),
  splits AS (SELECT repeat, game, k.stratum, CASE WHEN place <= tr.allocation THEN 'train' WHEN place <= tr.allocation + ca.allocation THEN 'calibration'
    WHEN place <= tr.allocation + ca.allocation + te.allocation THEN 'test' END AS role, place FROM k JOIN tr USING (stratum) JOIN ca USING (stratum) JOIN te USING (stratum))"""


def _splits(spark, sf):
    return design.outer_splits(b.games(spark, sf), "game", "stratum", 10, _ROLES, 11)


@query(f"WITH {_SPLITS} SELECT cast(repeat AS INTEGER) AS repeat, game, stratum, role FROM splits")
def des7_outer_splits(spark, sf):
    return _splits(spark, sf).select("repeat", "game", "stratum", "role")


_ORDER = """cs AS (SELECT repeat, stratum, count(*) AS c FROM splits WHERE role = 'train' GROUP BY ALL),
  vec AS (SELECT repeat, list(stratum ORDER BY stratum) AS names, list(c ORDER BY stratum) AS c, sum(c)::BIGINT AS total FROM cs GROUP BY repeat),
  greedy(repeat, pos, pick, taken) AS (
    SELECT repeat, 0::BIGINT, 0, [0::BIGINT FOR x IN c] FROM vec
    UNION ALL SELECT repeat, pos, pick, [taken[i] + CASE WHEN i = pick THEN 1 ELSE 0 END FOR i IN range(1, len(taken) + 1)] FROM (
      SELECT g.repeat, g.pos + 1 AS pos, g.taken, list_position([CASE WHEN g.taken[i] < v.c[i] THEN (g.pos + 1) * v.c[i] - g.taken[i] * v.total END FOR i IN range(1, len(v.c) + 1)],
        list_max([CASE WHEN g.taken[i] < v.c[i] THEN (g.pos + 1) * v.c[i] - g.taken[i] * v.total END FOR i IN range(1, len(v.c) + 1)])) AS pick
      FROM greedy g JOIN vec v ON g.repeat = v.repeat WHERE g.pos < v.total)),
  turns AS (SELECT greedy.repeat, pos, names[pick] AS stratum, row_number() OVER (PARTITION BY greedy.repeat, pick ORDER BY pos) AS i FROM greedy JOIN vec ON greedy.repeat = vec.repeat WHERE pos > 0),
  ord AS (SELECT s.repeat, s.game, s.stratum, t.pos AS train_order FROM (
    SELECT *, row_number() OVER (PARTITION BY repeat, stratum ORDER BY place) AS i FROM splits WHERE role = 'train') s JOIN turns t ON s.repeat = t.repeat AND s.stratum = t.stratum AND s.i = t.i)"""


@query(f"WITH RECURSIVE {_SPLITS}, {_ORDER} SELECT cast(repeat AS INTEGER) AS repeat, game, cast(train_order AS INTEGER) AS train_order FROM ord")
def des8_balanced_order(spark, sf):
    t = _splits(spark, sf).where("role = 'train'")
    return design.balanced_order(t, ["repeat"], "game", "stratum", "place").select("repeat", "game", F.col("train_order").cast("int").alias("train_order"))


@query(f"WITH RECURSIVE {_SPLITS}, {_ORDER} SELECT cast(repeat AS INTEGER) AS repeat, n_train, count(*) AS games, min(game) AS first_game FROM ord, (SELECT unnest([20, 40, 80, 120]) AS n_train) WHERE train_order <= n_train GROUP BY ALL")
def des9_nested_anchors(spark, sf):
    t = design.balanced_order(_splits(spark, sf).where("role = 'train'"), ["repeat"], "game", "stratum", "place")
    return design.nested_anchors(t, [20, 40, 80, 120]).groupBy("repeat", "n_train").agg(F.count("*").alias("games"), F.min("game").alias("first_game"))


@query(f"""WITH {_CAPS}, a AS (SELECT unnest([20, 40, 80, 120]) AS n_train), z AS (SELECT *, n_train * capacity // s AS base, n_train * capacity % s AS rem FROM a, (SELECT *, sum(capacity) OVER ()::BIGINT AS s FROM caps)),
  al AS (SELECT stratum, capacity, n_train, base + CASE WHEN row_number() OVER (PARTITION BY n_train ORDER BY rem DESC, stratum) <= n_train - sum(base) OVER (PARTITION BY n_train) THEN 1 ELSE 0 END AS allocation FROM z)
  SELECT stratum, capacity, n_train, cast(allocation AS BIGINT) AS allocation, coalesce(allocation < lag(allocation) OVER (PARTITION BY stratum ORDER BY n_train), false) AS shrinks FROM al""")
def des10_proportional_anchors(spark, sf):
    caps = b.games(spark, sf).groupBy("stratum").agg(F.count("*").alias("capacity"))
    return design.proportional_anchors(caps, "stratum", "capacity", [20, 40, 80, 120])


@query(f"""WITH RECURSIVE {_CAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat_ws('|', game, 'folds', 3)), game) AS place FROM games),
  f AS (SELECT f, row_number() OVER (ORDER BY sha256(concat_ws('|', f, 'fold_order', 3)), f) AS i FROM (SELECT unnest(range(5)) AS f)),
  st AS (SELECT stratum, capacity, row_number() OVER (ORDER BY sha256(concat_ws('|', stratum, 'strata', 3)), stratum) AS k FROM caps),
  walk(k, left_, deal) AS (
    SELECT 0::BIGINT, [t // 5 + CASE WHEN i <= t % 5 THEN 1 ELSE 0 END FOR i IN range(1, 6)], [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT] FROM (SELECT sum(capacity)::BIGINT AS t FROM caps)
    UNION ALL SELECT k, [left_[i] - deal[i] FOR i IN range(1, 6)], deal FROM (
      SELECT k, left_, [base[i] + CASE WHEN len([1 FOR j IN range(1, 6) IF rest[j] > rest[i] OR (rest[j] = rest[i] AND j < i)]) < n - list_sum(base) THEN 1 ELSE 0 END FOR i IN range(1, 6)] AS deal FROM (
        SELECT st.k, w.left_, st.capacity AS n, [st.capacity * x // list_sum(w.left_)::BIGINT FOR x IN w.left_] AS base, [st.capacity * x % list_sum(w.left_)::BIGINT FOR x IN w.left_] AS rest
        FROM walk w JOIN st ON st.k = w.k + 1))),
  cum AS (SELECT st.stratum, i, list_sum(deal[1:i]) AS upto, list_sum(deal[1:i]) - deal[i] AS after FROM walk JOIN st ON st.k = walk.k, (SELECT unnest(range(1, 6)) AS i))
  SELECT game, k.stratum, cast(f.f AS INTEGER) AS fold FROM k JOIN cum ON cum.stratum = k.stratum AND place > after AND place <= upto JOIN f ON f.i = cum.i""")
def des6_folds(spark, sf):
    return design.folds(b.games(spark, sf), "game", "stratum", 5, 3).select("game", "stratum", "fold")


@query(f"WITH {_SPLITS} SELECT cast(repeat AS INTEGER) AS repeat, role, sha256(string_agg(game::VARCHAR, ',' ORDER BY game::VARCHAR)) AS fingerprint, count(*) AS n_games FROM splits WHERE role IS NOT NULL GROUP BY ALL")
def des14_fingerprint(spark, sf):
    return design.fingerprint(_splits(spark, sf).where("role is not null"), ["repeat", "role"], "game")


@query(f"WITH {_SPLITS}, m AS (SELECT repeat, game, role FROM splits UNION ALL SELECT 1, game, 'test' FROM games WHERE game % 7 = 0) SELECT cast(repeat AS INTEGER) AS repeat, game, count(DISTINCT role) AS n_roles FROM m WHERE role IS NOT NULL GROUP BY ALL HAVING count(DISTINCT role) > 1")
def set5_split_violations(spark, sf):
    s = _splits(spark, sf).select("repeat", "game", "role")
    more = b.games(spark, sf).where("game % 7 = 0").select(F.lit(1).alias("repeat"), "game", F.lit("test").alias("role"))
    return design.split_violations(s.unionByName(more), "game")


# -- inference and decisions ---------------------------------------------------------------------------------

_DRAWS = """draws AS (SELECT d.d AS draw, i.i AS i, cast('0x' || substr(md5(concat_ws('|', '42', d.d, i.i)), 1, 8) AS BIGINT) % 20 AS k FROM range(1, 201) AS d(d), range(20) AS i(i))"""
_EPS = repr(inference.EPS)


def _max_t(source: str, ids: str, value: str, level: float, two_sided: bool) -> str:
    """CTE ci: simultaneous intervals of the mean of ``value`` over the 20 repeats of every estimand."""
    least = repr(fn.t_critical(level, 19, two_sided))
    se = lambda m, s, n: f"greatest({s} / sqrt({n}), {_EPS} * greatest(abs({m}), 1.0::DOUBLE), 1e-15)"
    return f"""{_DRAWS},
  est AS (SELECT {ids}, avg({value}) AS m, stddev_samp({value}) AS s, count(*) AS n FROM {source} GROUP BY ALL),
  boot AS (SELECT {ids}, draw, avg({value}) AS bm, stddev_samp({value}) AS bs FROM {source} JOIN draws ON k = repeat - 1 GROUP BY ALL),
  mt AS (SELECT draw, max({'abs' if two_sided else ''}((bm - m) / {se('bm', 'bs', '20')})) AS t FROM boot JOIN est USING ({ids}) GROUP BY draw),
  crit AS (SELECT greatest(max(t) FILTER (i = ceil({level} * (c - 1) - 1e-9) + 1), {least}) AS critical FROM (SELECT t, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS c FROM mt)),
  ci AS (SELECT {ids}, m AS mean, {se('m', 's', 'n')} AS se, critical, m - critical * {se('m', 's', 'n')} AS lower, m + critical * {se('m', 's', 'n')} AS upper FROM est, crit)"""


_LOSS_DIFFS = f'{b.PANEL}, {_PAIRS}, ds AS (SELECT repeat, n_train, "left", "right", v AS difference FROM diffs)'
_CI = f"""{_LOSS_DIFFS}, {_max_t('ds', 'n_train, "left", "right"', 'difference', 0.95, True)}"""


def _ci(spark, sf, metric="loss", level=0.95):
    d = panel.paired_models(b.panel(spark, sf), metric)
    return inference.max_t_intervals(d, ["n_train", "left", "right"], 20, 200, 42, level)


@query(f'WITH {_CI} SELECT n_train, "left", "right", {r("mean", "mean", 8)}, {r("se", "se", 8)}, {r("critical", "critical", 6)}, {r("lower", "lower", 7)}, {r("upper", "upper", 7)} FROM ci')
def inf2_max_t(spark, sf):
    i = _ci(spark, sf)
    digits = {"mean": 8, "se": 8, "critical": 6, "lower": 7, "upper": 7}
    return i.select("n_train", "left", "right", *[(F.round(c, k) + 0.0).alias(c) for c, k in digits.items()])


@query(f"""WITH {b.PANEL}, {_max_t('panel', 'model, n_train', 'coverage', 0.95, False)}
  SELECT model, n_train, {r('mean', 'mean', 8)}, {r('greatest(0, lower)', 'lower', 7)}, greatest(0, lower) >= 0.88 AS reaches FROM ci""")
def inf3_lower_bounds(spark, sf):
    i = inference.lower_bounds(b.panel(spark, sf), "coverage", ["model", "n_train"], 20, 200, 42, 0.88)
    return i.select("model", "n_train", (F.round("mean", 8) + 0.0).alias("mean"), (F.round("lower", 7) + 0.0).alias("lower"), "reaches")


_ORIENTED = """o AS (SELECT n_train, "left" AS model, "right" AS other, lower, upper FROM ci UNION ALL SELECT n_train, "right", "left", -upper, -lower FROM ci)"""


@query(f"""WITH {_CI}, {_ORIENTED}, c AS (SELECT n_train, model, count_if(upper < 0) AS beats, count(*) AS others FROM o GROUP BY ALL)
  SELECT n_train, max(model) FILTER (beats = others) AS supported_best, count_if(beats = others) AS n_best FROM c GROUP BY n_train""")
def dec1_supported_best(spark, sf):
    return inference.supported_best(_ci(spark, sf), ["n_train"])


@query(f"""WITH {b.PANEL}, {_DRAWS}, d AS (SELECT repeat, n_train, a.model AS model, c.model AS other, a.loss - c.loss AS v FROM panel a JOIN panel c USING (repeat, n_train) WHERE a.model <> c.model),
  e AS (SELECT n_train, model, other, avg(v) AS m, avg(v) / greatest(stddev_samp(v) / sqrt(20), {_EPS} * greatest(abs(avg(v)), 1.0::DOUBLE)) AS t FROM d GROUP BY ALL),
  bt AS (SELECT n_train, model, other, draw, avg(v) AS bm, stddev_samp(v) AS bs FROM d JOIN draws ON k = repeat - 1 GROUP BY ALL),
  mx AS (SELECT n_train, model, draw, max((bm - m) / greatest(bs / sqrt(20), {_EPS} * greatest(abs(bm), 1.0::DOUBLE))) AS x FROM bt JOIN e USING (n_train, model, other) GROUP BY ALL),
  ob AS (SELECT n_train, model, max(t) AS statistic FROM e GROUP BY ALL)
  SELECT n_train, model, {r('any_value(statistic)', 'statistic', 7)}, {r('count_if(x >= statistic) / count(*)', 'p_value')}, count_if(x >= statistic) / count(*) >= 0.05 - 1e-12 AS in_best_set
  FROM mx JOIN ob USING (n_train, model) GROUP BY n_train, model""")
def inf8_best_set(spark, sf):
    d = panel.paired_models(b.panel(spark, sf), "loss")
    out = inference.best_set(d, ["n_train"], 20, 200, 42)
    return out.select("n_train", "model", (F.round("statistic", 7) + 0.0).alias("statistic"), (F.round("p_value", 9) + 0.0).alias("p_value"), "in_best_set")


@query(f"""WITH {b.PANEL}, wd AS (SELECT repeat, n_train, a.model AS "left", c.model AS "right", a.width - c.width AS difference FROM panel a JOIN panel c USING (repeat, n_train) WHERE a.model < c.model),
  {_max_t('wd', 'n_train, "left", "right"', 'difference', 0.95, True).replace('est AS', 'est AS').replace(' ci AS', ' wci AS')},
  {_max_t('panel', 'model, n_train', 'coverage', 0.95, False).replace(_DRAWS + ',', '').replace(' est ', ' est2 ').replace('est AS', 'est2 AS').replace('JOIN est ', 'JOIN est2 ').replace('FROM est,', 'FROM est2,').replace('boot', 'boot2').replace('mt AS', 'mt2 AS').replace('FROM mt', 'FROM mt2').replace('crit AS', 'crit2 AS').replace('est2, crit)', 'est2, crit2)')},
  bo AS (SELECT model, n_train, greatest(0, lower) >= 0.88 AS reaches FROM ci)
  SELECT n_train, "left", "right", CASE WHEN NOT (x.reaches AND y.reaches) THEN 'not_qualified' WHEN upper < 0 THEN 'left_sharper' WHEN lower > 0 THEN 'right_sharper' ELSE 'inconclusive' END AS verdict
  FROM wci JOIN bo x USING (n_train) JOIN bo y USING (n_train) WHERE x.model = "left" AND y.model = "right" """)
def dec2_controlled_sharpness(spark, sf):
    bounds = inference.lower_bounds(b.panel(spark, sf), "coverage", ["model", "n_train"], 20, 200, 42, 0.88)
    return inference.controlled_sharpness(_ci(spark, sf, "width"), bounds, ["n_train"]).select("n_train", "left", "right", "verdict")


@query(f"""WITH {_CI} SELECT CASE WHEN upper < 0 THEN 'supported' WHEN lower > 0 THEN 'opposite' ELSE 'inconclusive' END AS conclusion, count(*) AS n FROM ci GROUP BY ALL""")
def dec3_conclusions(spark, sf):
    return inference.classify(_ci(spark, sf)).groupBy("conclusion").agg(F.count("*").alias("n"))


@query(f"""WITH {_CI}, c2 AS (SELECT greatest(max(t) FILTER (i = ceil(0.9::DOUBLE * (c - 1) - 1e-9) + 1), {fn.t_critical(0.9, 19)!r}) AS k2 FROM (SELECT t, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS c FROM mt)),
  b2 AS (SELECT n_train, "left", "right", critical AS k1, k2, CASE WHEN upper < 0 THEN 'supported' WHEN lower > 0 THEN 'opposite' ELSE 'inconclusive' END AS c1,
    CASE WHEN mean + k2 * se < 0 THEN 'supported' WHEN mean - k2 * se > 0 THEN 'opposite' ELSE 'inconclusive' END AS c2 FROM ci, c2)
  SELECT n_train, "left", "right", c1, c2, c1 = 'inconclusive' AND c2 <> 'inconclusive' AS newly_clear, {r('k2 / k1', 'critical_ratio', 6)}, {r('100 * (1 - k2 / k1)', 'width_reduction', 6)} FROM b2""")
def stat15_level_comparison(spark, sf):
    return rounded(inference.level_comparison(_ci(spark, sf), _ci(spark, sf, level=0.9), ["n_train", "left", "right"]), 6)


@query(f"""WITH {b.PANEL}, {_MEANS}, rk AS (SELECT n_train, {_RANK.format('mean')} <> {_RANK.format('other')} AS changed, max(mean) > 0.06 AS large FROM m GROUP BY n_train)
  SELECT array_to_string(list_filter([CASE WHEN bool_or(changed) THEN 'ranking' END, CASE WHEN bool_or(large) THEN 'large_loss' END], lambda x: x IS NOT NULL), ',') AS reasons, bool_or(changed) OR bool_or(large) AS extend FROM rk""")
def dec4_extension_trigger(spark, sf):
    ch = panel.ranking_changes(_means(spark, sf), _means(spark, sf, "null_loss"), ["n_train"])
    top = _means(spark, sf).groupBy("n_train").agg((F.max("mean") > 0.06).alias("large"))
    out = inference.extension_trigger(ch.join(top, "n_train"), {"ranking": F.col("changed"), "large_loss": F.col("large")})
    return out.select(F.array_join("reasons", ",").alias("reasons"), "extend")


# -- encodings and fits --------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT c_custkey, c_mktsegment AS cell, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS v FROM customer),
  m AS (SELECT cell, quantile_cont(v, 0.5) AS md FROM t WHERE c_custkey % 3 > 0 GROUP BY cell), f AS (SELECT c_custkey, cell, coalesce(v, md) AS x FROM t JOIN m USING (cell)),
  s AS (SELECT cell, avg(x) AS a, stddev_pop(x) AS d FROM f WHERE c_custkey % 3 > 0 GROUP BY cell) SELECT c_custkey, {r('(x - a) / CASE WHEN d > 1e-8 THEN d ELSE 1 END', 'z_v')} FROM f JOIN s USING (cell)""")
def enc1_standardize(spark, sf):
    t = b.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("cell"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("v"))
    return rounded(encode.standardize(t, ["cell"], F.col("c_custkey") % 3 > 0, ["v"]).select("c_custkey", "z_v"))


_CAT = "t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS c, o_orderkey % 3 > 0 AND o_orderpriority <> '5-LOW' AS tr FROM orders)"


@query(f"""WITH {_CAT}, n AS (SELECT c, count(*) AS n FROM t WHERE tr AND c IS NOT NULL GROUP BY c), fill AS (SELECT c FROM n ORDER BY n DESC, c LIMIT 1), k AS (SELECT DISTINCT c FROM t WHERE tr AND c IS NOT NULL)
  SELECT o_orderkey, coalesce(t.c, fill.c) AS level, 1 AS indicator FROM t, fill WHERE coalesce(t.c, fill.c) IN (SELECT c FROM k)""")
def enc2_one_hot(spark, sf):
    t = b.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("c"), ((F.col("o_orderkey") % 3 > 0) & (F.col("o_orderpriority") != "5-LOW")).alias("tr"))
    return encode.one_hot(t, "o_orderkey", F.col("tr"), "c")


@query("""SELECT c_custkey, 'c_name' AS "column", cast(cast('0x' || substr(sha256(CAST('c_name' AS BLOB) || '\\x00'::BLOB || CAST(c_name AS BLOB)), 1, 16) AS UBIGINT) % 8 AS BIGINT) AS bucket FROM customer
  UNION ALL SELECT c_custkey, 'c_mktsegment', cast(cast('0x' || substr(sha256(CAST('c_mktsegment' AS BLOB) || '\\x00'::BLOB || CAST(c_mktsegment AS BLOB)), 1, 16) AS UBIGINT) % 8 AS BIGINT) FROM customer""")
def enc3_hashed_context(spark, sf):
    return encode.hashed_context(b.table(spark, sf, "customer"), "c_custkey", ["c_name", "c_mktsegment"])


@query(f"""WITH {b.TRACKING} SELECT play % 4 AS cell, count(*) AS n, {r('avg(x)', 'x_mean', 8)}, {r('stddev_pop(x)', 'x_sd', 8)}, {r('avg(s)', 's_mean', 8)}, {r('stddev_pop(s)', 's_sd', 8)} FROM tracking WHERE offense GROUP BY ALL""")
def enc4_masked_scaler(spark, sf):
    t = b.tracking(spark, sf).withColumn("cell", F.col("play") % 4)
    return rounded(encode.masked_scaler(t, ["cell"], F.col("offense"), ["x", "s"]), 8)


@query(f"""WITH {b.PMFS} SELECT "row", cast(k AS INTEGER) AS k, {r('k / 63.0::DOUBLE', 't')}, {r('sqrt(k / 63.0::DOUBLE)', 'root')}, {r('(k / 63.0::DOUBLE) ** 2', 'square')}, {r('cdf', 'base')} FROM pmf WHERE k < 63""")
def enc8_threshold_rows(spark, sf):
    p = b.pmfs(spark, sf).select("row", fn.cumulative(F.col("pmf")).alias("cdf"))
    return rounded(encode.threshold_rows(p, "row", "cdf", 64))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cast(h AS INTEGER) AS h, {r('h / 10.0::DOUBLE', 't')}, {r('sqrt(h / 10.0::DOUBLE)', 'root')}, {r('(h / 10.0::DOUBLE) ** 2', 'square')}
  FROM lineitem, range(1, 11) AS r(h) WHERE h <= l_linenumber""".replace("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, ", "l_orderkey, "))
def enc9_horizon_rows(spark, sf):
    return rounded(encode.horizon_rows(b.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", 10))


def _ridge_rows(spark, sf):
    l_ = b.table(spark, sf, "lineitem")
    return l_.select((F.col("l_orderkey") % 7).alias("cell"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_tax") * 100).alias("t"), (F.col("l_extendedprice") / 1000).alias("y"))


@query()
def ml2_ridge(spark, sf):
    m = encode.ridge_moments(_ridge_rows(spark, sf), ["cell"], ["q", "t"], "y")
    beta = encode.ridge_fit(m, ["cell"], 3, 1.0)
    return beta.select("cell", *[(F.round(F.get("beta", F.lit(i)), 6) + 0.0).alias(f"b{i}") for i in range(3)])


@query(f"""WITH {b.TRACKING} SELECT 'x' AS channel, count(*) AS n, {r('sum(x)', 'total', 4)} FROM tracking""")
def snk1_token_totals(spark, sf):
    return rounded(b.tracking(spark, sf).agg(F.lit("x").alias("channel"), F.count("*").alias("n"), F.sum("x").alias("total")), 4)


# -- scalar functions, labels, joins of predictions ----------------------------------------------------------


@query("""SELECT c_custkey, cast(c_custkey % 15 AS DOUBLE) * 60 + c_custkey % 60 AS clock, cast(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS first_id,
  CASE upper(c_mktsegment) WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE 'other' END AS grp, 12 * (c_custkey % 3 + 5) + c_custkey % 12 AS inches,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS amount, c_custkey % 4 = 1 AS flag FROM customer""")
def fn1_scalars(spark, sf):
    c = b.table(spark, sf, "customer")
    k = F.col("c_custkey")
    clock = F.concat_ws(":", (k % 15).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"))
    height = F.concat_ws("-", (k % 3 + 5).cast("string"), (k % 12).cast("string"))
    return c.select(
        "c_custkey", fn.clock_seconds(clock).alias("clock"), fn.first_integer(F.col("c_name")).alias("first_id"), fn.lookup(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}, "other").alias("grp"),
        fn.feet_inches(height).cast("long").alias("inches"), fn.sentinel_number(F.when(k % 5 == 0, "NA").otherwise(F.col("c_acctbal").cast("string"))).alias("amount"),
        fn.loose_boolean(F.when(k % 4 == 1, "1.0").otherwise("no")).alias("flag"),
    )


@query("""SELECT c_custkey, cast(('0x' || substr(sha256('k' || c_custkey), 1, 16))::UBIGINT % 97 AS BIGINT) AS h, sha256('{"id":' || c_custkey || ',"seg":"' || c_mktsegment || '"}') AS j FROM customer""")
def fn15_hashes(spark, sf):
    c = b.table(spark, sf, "customer")
    j = fn.canonical_json(seg=F.col("c_mktsegment"), id=F.col("c_custkey"))
    return c.select("c_custkey", fn.sha_number(F.concat(F.lit("k"), F.col("c_custkey").cast("string")), 97).alias("h"), F.sha2(j.cast("binary"), 256).alias("j"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' THEN 0 END AS label FROM orders
  WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT')""")
def prj4_candidate_labels(spark, sf):
    from fieldlens.operators import cohort

    o = b.table(spark, sf, "orders")
    return cohort.made_missed(o, F.col("o_orderstatus") == "F", (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey", "label")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(cast(l_quantity AS INTEGER), 45), 5) - 5 AS y FROM lineitem")
def prj9_clipped_label(spark, sf):
    from fieldlens.operators import cohort

    l_ = b.table(spark, sf, "lineitem")
    return l_.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cohort.support_index(F.col("l_quantity").cast("int"), 5, 45).alias("y"))


@query(f"""WITH RECURSIVE {_SPLITS}, {_ORDER}, bn AS (SELECT o_orderkey AS "row", o_custkey AS game, cast(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)
  SELECT cast(o.repeat AS INTEGER) AS repeat, n_train, count(*) AS n, {r('(sum(y) + 0.5::DOUBLE) / (count(*) + 1)', 'prevalence')} FROM bn JOIN ord o USING (game), (SELECT unnest([20, 40, 80, 120]) AS n_train) WHERE train_order <= n_train GROUP BY ALL""")
def jn14_training_cells(spark, sf):
    t = design.nested_anchors(design.balanced_order(_splits(spark, sf).where("role = 'train'"), ["repeat"], "game", "stratum", "place"), [20, 40, 80, 120])
    rows = b.binary(spark, sf).select("row", "game", "y").join(t.select("repeat", "n_train", "game"), "game")
    return rounded(rows.groupBy("repeat", "n_train").agg(F.count("*").alias("n"), ((F.sum("y") + 0.5) / (F.count("*") + 1)).alias("prevalence")))


@query(f"""WITH RECURSIVE {_SPLITS}, {_ORDER}, bn AS (SELECT o_orderkey AS "row", o_custkey AS game, cast(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
  prv AS (SELECT o.repeat, n_train, (sum(y) + 0.5::DOUBLE) / (count(*) + 1) AS pv FROM bn JOIN ord o USING (game), (SELECT unnest([20, 40, 80, 120]) AS n_train) WHERE train_order <= n_train GROUP BY ALL),
  tst AS (SELECT repeat, game, avg((pv - y) ** 2) AS v, n_train FROM bn JOIN splits USING (game) JOIN prv USING (repeat) WHERE role = 'test' GROUP BY ALL)
  SELECT cast(repeat AS INTEGER) AS repeat, n_train, {r('avg(v)', 'null_loss')} FROM tst GROUP BY ALL""")
def pipe16_null_losses(spark, sf):
    """Train-only prevalence by cell, scored game-equally on the repeat's test games."""
    s = _splits(spark, sf)
    t = design.nested_anchors(design.balanced_order(s.where("role = 'train'"), ["repeat"], "game", "stratum", "place"), [20, 40, 80, 120])
    rows = b.binary(spark, sf).select("row", "game", "y")
    return rounded(cells.null_losses(rows, t, s.where("role = 'test'"), "game", "y"))


@query(f"""WITH {b.TRACKING}, f AS (SELECT play, min(frame) AS lo, max(frame) AS hi, count(DISTINCT frame) AS n FROM tracking GROUP BY play)
  SELECT CASE WHEN n = 7 THEN 'all' WHEN hi - lo + 1 <> n THEN 'gaps' WHEN hi = 7 THEN 'right' WHEN lo = 1 THEN 'left' ELSE 'inside' END AS layout, count(*) AS plays FROM f GROUP BY ALL""")
def set8_mask_layout(spark, sf):
    from fieldlens.operators import cohort

    return cohort.mask_layout(b.tracking(spark, sf), "play", "frame", 1, 7).groupBy("layout").agg(F.count("*").alias("plays"))


@query(f"""WITH {b.PANEL}, {_MELT}, t AS (SELECT metric, n_train, model, avg(v) AS m FROM long GROUP BY ALL)
  SELECT metric, {r('median(m)', 'median')}, {r('min(m)', 'low')}, {r('max(m)', 'high')}, count(*) AS n FROM t GROUP BY metric""")
def agg19_release_ranges(spark, sf):
    return rounded(panel.metric_ranges(b.panel(spark, sf), _METRICS))


@query(f"""WITH {b.PANEL}, w AS (SELECT repeat, n_train, arg_min(model, struct_pack(a := loss, b := model)) AS configuration FROM panel GROUP BY ALL)
  SELECT n_train, configuration, count(*) AS n, {r('count(*) / 20.0::DOUBLE', 'fraction')} FROM w GROUP BY ALL""")
def agg15_configuration_frequency(spark, sf):
    return rounded(panel.configuration_frequency(b.panel(spark, sf), "loss", 20))


@query(f"""WITH {_CI}, {_ORIENTED}, {_MEANS}, c AS (SELECT n_train, model, count_if(upper < 0) = count(*) AS best FROM o GROUP BY ALL), l AS (SELECT n_train, arg_min(model, struct_pack(a := mean, b := model)) AS leader FROM m GROUP BY n_train)
  SELECT n_train, leader, coalesce(best, false) AS supported FROM l LEFT JOIN c ON c.n_train = l.n_train AND c.model = leader""".replace("SELECT n_train, leader, coalesce", "SELECT l.n_train, leader, coalesce"))
def stat14_leader_matrix(spark, sf):
    return panel.leader_matrix(_means(spark, sf), inference.supported_best(_ci(spark, sf), ["n_train"]), ["n_train"])


@query(f"""WITH {b.PANEL}, cv AS (SELECT model AS candidate, repeat % 5 AS fold, avg(loss) AS loss FROM panel GROUP BY ALL), m AS (SELECT candidate, avg(loss) AS mean, stddev_samp(loss) AS sd FROM cv GROUP BY candidate)
  SELECT candidate, {r('mean', 'mean')}, {r('sd', 'sd')}, candidate = (SELECT arg_min(candidate, struct_pack(a := mean, b := candidate)) FROM m) AS chosen FROM m""")
def ml6_candidate_choice(spark, sf):
    from fieldlens.operators import models

    cv = b.panel(spark, sf).groupBy(F.col("model").alias("candidate"), (F.col("repeat") % 5).alias("fold")).agg(F.avg("loss").alias("loss"))
    return rounded(models.choose(cv, 5))


@query(f"""WITH {b.PANEL}, s AS (SELECT n_train AS target, substr(model, 1, 1) AS family, model AS candidate, avg(loss) AS loss FROM panel GROUP BY ALL), f AS (SELECT target, family, min(loss) AS l FROM s GROUP BY ALL), t AS (SELECT target, avg(l) AS score FROM f GROUP BY target)
  SELECT target, {r('score', 'score')} FROM t ORDER BY t.score, target LIMIT 1""")
def ml7_target_choice(spark, sf):
    from fieldlens.operators import models

    s = b.panel(spark, sf).groupBy(F.col("n_train").alias("target"), F.substring("model", 1, 1).alias("family"), F.col("model").alias("candidate")).agg(F.avg("loss").alias("loss"))
    return rounded(models.choose_target(s))


@query()
def ml1_logistic(spark, sf):
    """Held-out Brier score of a logistic model of the label by price and priority."""
    from fieldlens.operators import models

    l_ = b.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), "l_quantity", "l_discount", "l_tax", (F.col("l_orderkey") % 3 == 0).alias("test"))
    x = ["l_quantity", "l_discount", "l_tax"]
    out = models.probability(models.logistic(l_.where("not test"), x, "y"), l_.where("test"), x)
    return rounded(out.groupBy("y").agg(F.count("*").alias("n"), F.avg(scores.brier(F.col("p"), F.col("y"))).alias("brier")), 4)


# -- composed jobs -------------------------------------------------------------------------------------------


def _cohort(spark, sf):
    from fieldlens.plans import pipelines

    m = b.marks(spark, sf)
    plays = m.select("play").distinct()
    return pipelines.marker_cohort(plays, m, "play", "frame", "marker", F.col("play") % 5 != 0, (F.col("play") % 2).cast("int"), ["purchase"], 10, valid=m.where("value > 5"))


_COHORT = f"""{b.MARKS}, hits AS (SELECT play, min(frame) AS cutoff FROM marks WHERE marker = 'purchase' AND play % 5 <> 0 GROUP BY play),
  kept AS (SELECT play, cutoff FROM hits h WHERE EXISTS (SELECT 1 FROM marks m WHERE m.play = h.play AND m.frame = h.cutoff AND value > 5))"""


@query(f"WITH {_COHORT} SELECT m.play, m.frame, cast(9 - (cutoff - m.frame) AS INTEGER) AS time_index, marker FROM marks m JOIN kept USING (play) WHERE m.frame BETWEEN cutoff - 9 AND cutoff")
def pipe2_cohort_tokens(spark, sf):
    return _cohort(spark, sf)["tokens"].select("play", "frame", "time_index", "marker")


@query(f"WITH {_COHORT} SELECT play, cast(play % 2 AS INTEGER) AS label, cutoff, 'purchase' AS events, cast(least(cutoff, 10) AS BIGINT) AS history, cast(10 - least(cutoff, 10) AS BIGINT) AS padding FROM kept")
def pipe2_cohort_examples(spark, sf):
    return _cohort(spark, sf)["examples"].select("play", "label", "cutoff", "events", "history", "padding")


@query(f"""WITH {_COHORT} SELECT CASE WHEN p.play % 5 = 0 THEN 'not_eligible' WHEN h.play IS NULL THEN 'no_marker' WHEN k.play IS NULL THEN 'invalid_frame' ELSE 'kept' END AS status, count(*) AS plays
  FROM (SELECT DISTINCT play FROM marks) p LEFT JOIN hits h USING (play) LEFT JOIN kept k USING (play) GROUP BY ALL""")
def pipe2_cohort_audit(spark, sf):
    return _cohort(spark, sf)["audit"]


@query(f"""WITH {b.PANEL}, td AS (SELECT repeat, model, n_train, null_loss - loss AS difference FROM panel), {_max_t('td', 'model, n_train', 'difference', 0.95, True)}
  SELECT model, n_train, {r('mean', 'mean', 8)}, CASE WHEN upper < 0 THEN 'supported' WHEN lower > 0 THEN 'opposite' ELSE 'inconclusive' END AS conclusion FROM ci""")
def pipe12_tuning_study(spark, sf):
    from fieldlens.plans import pipelines

    p = b.panel(spark, sf)
    out = pipelines.tuning_study(p, p.withColumn("loss", F.col("null_loss")), "loss", 20, 200, 42)
    return out.select("model", "n_train", (F.round("mean", 8) + 0.0).alias("mean"), "conclusion")


# -- further cohort rules, joins and checks ------------------------------------------------------------------


@query("SELECT o_orderkey, cast(o_orderstatus = 'F' AS INTEGER) AS label FROM orders WHERE o_orderstatus IN ('F', 'O')")
def prj1_outcome_label(spark, sf):
    from fieldlens.operators import cohort

    return cohort.outcome_label(b.table(spark, sf, "orders"), "o_orderstatus", ["F", "O"], "F").select("o_orderkey", "label")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END IN ('', 'NA'), true) AND o_orderstatus <> 'P' AS clean,
  o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 AS run FROM orders""")
def prj5_penalty_and_run(spark, sf):
    from fieldlens.operators import cohort

    o, k = b.table(spark, sf, "orders"), F.col("o_orderkey")
    foul = F.when(k % 3 != 0, F.substring("o_orderpriority", 1, 1))
    nullified = F.when(F.col("o_orderstatus") == "P", " y ")
    result = F.when(k % 3 != 0, F.when(k % 7 == 0, "r").otherwise("C"))
    return o.select("o_orderkey", cohort.no_penalty(foul, nullified).alias("clean"), cohort.is_run(result).alias("run"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), c AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0)
  SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, 'right' FROM c WHERE k NOT IN (SELECT k FROM a)""")
def prj8_key_mismatches(spark, sf):
    from fieldlens.operators import cohort

    a = b.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    return cohort.key_mismatches(a, b.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), ["k"])


@query("""WITH s AS (SELECT l_orderkey AS play, count(*) AS n, count(DISTINCT l_suppkey) AS objects, count_if(l_returnflag = 'R') AS focal,
    count(DISTINCT CASE WHEN l_linestatus = 'F' THEN 'home' ELSE 'away' END) AS sides, count_if(l_linestatus = 'F') AS home, count(DISTINCT l_tax) AS taxes FROM lineitem GROUP BY ALL),
  v AS (SELECT play, list_filter([CASE WHEN n <> 4 THEN 'rows' END, CASE WHEN objects <> 4 THEN 'objects' END, CASE WHEN focal <> 1 THEN 'focal' END, CASE WHEN sides <> 2 OR home * 2 <> 4 THEN 'sides' END,
    CASE WHEN taxes > 1 THEN 'constant_l_tax' END], lambda x: x IS NOT NULL) AS p FROM s)
  SELECT play, array_to_string(p, ',') AS problems FROM v WHERE len(p) > 0""")
def prj16_snapshot_violations(spark, sf):
    from fieldlens.operators import cohort

    l_ = b.table(spark, sf, "lineitem").withColumn("side", F.when(F.col("l_linestatus") == "F", "home").otherwise("away")).withColumnRenamed("l_orderkey", "play")
    out = cohort.snapshot_violations(l_, "play", "l_suppkey", "side", F.col("l_returnflag") == "R", 4, ["l_tax"])
    return out.select("play", F.array_join("problems", ",").alias("problems"))


@query("""WITH g AS (SELECT o_orderkey % 4 < 3 AS band, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT band, label, n + CASE WHEN label = 'P' THEN 1 ELSE 0 END AS expected FROM g WHERE label <> 'O')
  SELECT coalesce(g.band, e.band) AS band, coalesce(g.label, e.label) AS label, n, expected, coalesce(n = expected, false) AS agrees FROM g FULL JOIN e ON g.band = e.band AND g.label = e.label""")
def prj17_band_counts(spark, sf):
    from fieldlens.operators import cohort

    o = b.table(spark, sf, "orders")
    band = F.col("o_orderkey") % 4 < 3
    n = o.groupBy(band.alias("band"), F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    expected = n.where("label <> 'O'").select("band", "label", (F.col("n") + (F.col("label") == "P").cast("int")).alias("expected"))
    return cohort.band_counts(o, band, "o_orderstatus", expected)


@query("SELECT l_suppkey AS game, count(DISTINCT (l_returnflag, l_linestatus)) AS n_records FROM lineitem GROUP BY ALL")
def src11_game_table(spark, sf):
    from fieldlens.sources import tables

    return tables.game_table(b.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "game"), "game", ["l_returnflag", "l_linestatus"]).select("game", "n_records")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def src7_game_scoped_scan(spark, sf):
    from fieldlens.sources import tables

    wanted = b.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.only_games(b.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


@query(f"""WITH {_CRPS}, {_ITV.replace(b.PMFS + ', ', '')}, n AS (SELECT cell, any_value(0) AS z, avg(ss / kk) AS crps, avg(hi - lo) AS width, avg(CASE WHEN i.y BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS coverage
    FROM c JOIN itv i USING ("row", cell) GROUP BY cell) SELECT cell, {r('crps', 'play_crps')}, {r('width', 'play_width')}, {r('coverage', 'play_coverage')} FROM n""")
def met12_distribution_row(spark, sf):
    p = b.pmfs(spark, sf)
    lo, hi = conformal.central_interval(F.col("pmf"), 0.1)
    rows = p.select("cell", "y", scores.crps(F.col("pmf"), F.col("y")).alias("crps"), lo.alias("lo"), hi.alias("hi"))
    hit = F.col("y").between(F.col("lo"), F.col("hi")).cast("double")
    return rounded(rows.groupBy("cell").agg(F.avg("crps").alias("play_crps"), F.avg(F.col("hi") - F.col("lo")).alias("play_width"), F.avg(hit).alias("play_coverage")))


@query(f"""WITH {b.PANEL}, f AS (SELECT model, n_train, avg(coverage) >= 0.9 AS fixed, avg(coverage) + avg(loss) >= 0.95 AS tuned FROM panel GROUP BY ALL) SELECT model, n_train, fixed, tuned, fixed <> tuned AS changed FROM f""")
def dec5_qualification_changes(spark, sf):
    p = b.panel(spark, sf).groupBy("model", "n_train").agg(F.avg("coverage").alias("c"), F.avg("loss").alias("l"))
    fixed = p.select("model", "n_train", (F.col("c") >= 0.9).alias("reaches"))
    return inference.qualification_changes(fixed, p.select("model", "n_train", (F.col("c") + F.col("l") >= 0.95).alias("reaches")), ["model", "n_train"])


@query(f"""WITH {b.PANEL}, s AS (SELECT n_train, model AS candidate, avg(loss) AS loss FROM panel GROUP BY ALL)
  SELECT n_train, arg_min(candidate, struct_pack(a := loss, b := CASE WHEN candidate = 'NO' THEN 0 ELSE 1 END, c := candidate)) AS candidate, {r('min(loss)', 'loss')} FROM s GROUP BY n_train""")
def ml8_frozen_first(spark, sf):
    from fieldlens.operators import models

    s = b.panel(spark, sf).groupBy("n_train", F.col("model").alias("candidate")).agg(F.avg("loss").alias("loss"))
    return rounded(models.frozen_first(s, ["n_train"], F.col("candidate") == "NO"))


@query(f"""WITH {_SPLITS}, ex AS (SELECT repeat, game, role FROM splits WHERE role IN ('test', 'calibration')),
  pr AS (SELECT repeat, game, CASE WHEN game % 50 = 3 THEN 'test' ELSE role END AS got FROM ex WHERE game % 40 <> 1 UNION ALL SELECT repeat, game, role FROM ex WHERE game % 30 = 7
    UNION ALL SELECT repeat, game + 1000000, role FROM ex WHERE game % 25 = 4),
  un AS (SELECT repeat, game, min(got) AS got, count(*) AS n FROM pr GROUP BY ALL)
  SELECT cast(coalesce(ex.repeat, un.repeat) AS INTEGER) AS repeat, count(role) AS expected, count_if(role IS NOT NULL AND got IS NOT NULL) AS present, count_if(got IS NULL) AS missing, count_if(role IS NULL) AS unasked,
    count_if(coalesce(n, 0) > 1) AS repeated, count_if(coalesce(got <> role, false)) AS misplaced FROM ex FULL JOIN un ON ex.repeat = un.repeat AND ex.game = un.game GROUP BY 1""")
def set9_prediction_registry(spark, sf):
    """Saved parts with games missing, in another part, twice, and never asked for."""
    ex = _splits(spark, sf).where("role in ('test', 'calibration')").select("repeat", "game", "role")
    got = ex.where("game % 40 <> 1").withColumn("role", F.when(F.col("game") % 50 == 3, "test").otherwise(F.col("role")))
    got = got.unionByName(ex.where("game % 30 = 7")).unionByName(ex.where("game % 25 = 4").withColumn("game", F.col("game") + 1_000_000))
    return cells.registry_check(ex, got, ["repeat"], ["game"], ["role"])

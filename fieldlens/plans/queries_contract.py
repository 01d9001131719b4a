"""Registered queries of contracts, sinks that are read back, and calibration registries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldlens.operators import cohort, conformal, contract, frames, panel
from fieldlens.plans import bindings as b
from fieldlens.plans.queries import query, r, rounded
from fieldlens.sources import tables, weekly
from fieldlens.sources.steps import shared_folder


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/fieldlens-{name}-{uuid.uuid4().hex}"


def _first(keys: str) -> str:
    return f"array_to_string((list_sort(list_distinct(list({keys}))))[1:3], ',')"


def _reported(df):
    return df.select("rule", "n", F.array_join("first", ",").alias("first"))


# -- contracts -----------------------------------------------------------------------------------------------


@query(f"""WITH v AS (
    SELECT 'l_tax_finite' AS rule, concat_ws(':', l_orderkey, coalesce(l_suppkey::VARCHAR, 'null')) AS k FROM l WHERE l_tax IS NULL
    UNION ALL SELECT 'q_whole', concat_ws(':', l_orderkey, l_suppkey) FROM l WHERE q IS NULL OR q <> floor(q)
    UNION ALL SELECT 'l_returnflag_domain', concat_ws(':', l_orderkey, l_suppkey) FROM l WHERE l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT 'side_domain', concat_ws(':', l_orderkey, l_suppkey) FROM l WHERE side NOT IN ('F', 'O')
    UNION ALL SELECT 'rows', l_orderkey::VARCHAR FROM p WHERE n <> 4
    UNION ALL SELECT 'objects', l_orderkey::VARCHAR FROM p WHERE objects <> 4
    UNION ALL SELECT 'focal', l_orderkey::VARCHAR FROM p WHERE focal <> 1
    UNION ALL SELECT 'sides', l_orderkey::VARCHAR FROM p WHERE coalesce(CASE on_side WHEN 'F' THEN f WHEN 'O' THEN o END, -1) * 2 <> 4
    UNION ALL SELECT 'l_shipmode_constant', l_orderkey::VARCHAR FROM p WHERE modes > 1),
  rules AS (SELECT unnest(['l_tax_finite', 'q_whole', 'l_returnflag_domain', 'side_domain', 'rows', 'objects', 'focal', 'sides', 'l_shipmode_constant']) AS rule)
  SELECT rule, count(k) AS n, coalesce({_first('k')}, '') AS first FROM rules LEFT JOIN v USING (rule) GROUP BY rule""".replace("FROM l ", "FROM li ").replace("WITH v AS", """WITH li AS (
    SELECT l_orderkey, l_suppkey, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_tax END AS l_tax, l_quantity + CASE WHEN l_orderkey % 70 = 0 THEN 0.5::DOUBLE ELSE 0 END AS q, l_returnflag, l_linestatus AS side,
      l_partkey % 2 AS l_shipmode, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS lead FROM lineitem),
  pp AS (SELECT *, CASE WHEN l_suppkey = lead THEN side END AS lead_side FROM li),
  p AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS objects, count_if(l_suppkey = lead) AS focal, max(lead_side) AS on_side, count_if(side = 'F') AS f, count_if(side = 'O') AS o, count(DISTINCT l_shipmode) AS modes FROM pp GROUP BY ALL),
  v AS""").replace("list({k})", "list(k)"))
def prj16_snapshot_contract(spark, sf):
    """Which rules the orders of lineitem break as snapshots of four objects, with some values spoiled."""
    from pyspark.sql import Window

    l_ = b.table(spark, sf, "lineitem")
    tax = F.when(F.col("l_orderkey") % 50 != 0, F.col("l_tax")).alias("l_tax")
    q = (F.col("l_quantity") + F.when(F.col("l_orderkey") % 70 == 0, 0.5).otherwise(0.0)).alias("q")
    rows = l_.select("l_orderkey", "l_suppkey", tax, q, "l_returnflag", F.col("l_linestatus").alias("side"), (F.col("l_partkey") % 2).alias("l_shipmode"), F.min("l_suppkey").over(Window.partitionBy("l_orderkey")).alias("lead"))
    wrong = contract.snapshot_contract(rows, ["l_orderkey"], "l_suppkey", "lead", "side", ["F", "O"], ["l_shipmode"], ["l_tax"], [], ["q"], {"l_returnflag": ["A", "N"]}, 4)
    rules = ["l_tax_finite", "q_whole", "l_returnflag_domain", "side_domain", "rows", "objects", "focal", "sides", "l_shipmode_constant"]
    return _reported(contract.report(wrong, rules))


@query(f"""WITH ex AS (SELECT o_orderkey AS e, CASE WHEN o_orderkey % 40 = 0 THEN 9 ELSE o_orderkey % 3 END AS label FROM orders UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 60 = 0),
  tk AS (SELECT l_orderkey AS e, l_linenumber - 1 AS t, CASE WHEN l_orderkey % 90 = 0 THEN NULL ELSE l_tax END AS x FROM lineitem),
  fr AS (SELECT DISTINCT l_orderkey AS e, l_linenumber - 1 AS t FROM lineitem WHERE l_linenumber <> 3 OR l_orderkey % 10 <> 0),
  g AS (SELECT e, min(t) AS lo, max(t) AS hi, count(DISTINCT t) AS n FROM fr GROUP BY e),
  v AS (SELECT 'example_repeated' AS rule, e::VARCHAR AS k FROM ex GROUP BY e HAVING count(*) > 1
    UNION ALL SELECT 'label_support', e::VARCHAR FROM ex WHERE label NOT IN (0, 1, 2)
    UNION ALL SELECT 'x_finite', concat_ws(':', e, t) FROM tk WHERE x IS NULL
    UNION ALL SELECT 'token_without_frame', concat_ws(':', e, t) FROM (SELECT DISTINCT e, t FROM tk EXCEPT SELECT e, t FROM fr)
    UNION ALL SELECT 'frame_without_example', e::VARCHAR FROM (SELECT DISTINCT e FROM fr EXCEPT SELECT e FROM ex)
    UNION ALL SELECT 'frame_gaps', e::VARCHAR FROM g WHERE hi - lo + 1 <> n
    UNION ALL SELECT 'frame_padding', e::VARCHAR FROM g WHERE lo > 0 AND hi < 6
    UNION ALL SELECT 'support_increasing', '2'),
  rules AS (SELECT unnest(['example_repeated', 'label_support', 'x_finite', 'token_without_frame', 'frame_without_example', 'frame_gaps', 'frame_padding', 'time_range', 'support_increasing', 'feature_order']) AS rule)
  SELECT rule, count(k) AS n, coalesce({_first('k')}, '') AS first FROM rules LEFT JOIN v USING (rule) GROUP BY rule""")
def set8_dataset_contract(spark, sf):
    """Orders as examples and lines as tokens and frames, with some of each spoiled."""
    o, l_ = b.table(spark, sf, "orders"), b.table(spark, sf, "lineitem")
    k = F.col("o_orderkey")
    ex = o.select(k.alias("e"), F.when(k % 40 == 0, 9).otherwise(k % 3).cast("int").alias("label"))
    ex = ex.unionByName(o.where(k % 60 == 0).select(k.alias("e"), F.lit(0).alias("label")))
    tk = l_.select(F.col("l_orderkey").alias("e"), (F.col("l_linenumber") - 1).alias("t"), F.when(F.col("l_orderkey") % 90 != 0, F.col("l_tax")).alias("x"))
    fr = l_.where("l_linenumber <> 3 or l_orderkey % 10 <> 0").select(F.col("l_orderkey").alias("e"), (F.col("l_linenumber") - 1).alias("t")).distinct()
    wrong = contract.dataset_contract(ex, tk, fr, "e", "t", "label", [0.0, 1.0, 1.0], ["x"], ["e", "t", "x"], 7)
    return _reported(contract.report(wrong, ["example_repeated", "label_support", "x_finite", "token_without_frame", "frame_without_example", "frame_gaps", "frame_padding", "time_range", "support_increasing", "feature_order"]))


@query(f"""WITH {b.PANEL}, sec AS (SELECT 'a' AS identity, repeat, model, n_train FROM panel WHERE repeat <> 3 UNION ALL SELECT 'b', repeat, model, n_train FROM panel UNION ALL SELECT 'b', repeat, model, n_train FROM panel WHERE repeat = 5 AND n_train = 40),
  fl AS (SELECT identity, p.* FROM panel p, (VALUES ('a'), ('b')) AS i(identity))
  SELECT identity, 'missing_secondary' AS rule, concat_ws(':', identity, repeat, model, n_train) AS key FROM (SELECT identity, repeat, model, n_train FROM fl EXCEPT SELECT * FROM sec)
  UNION ALL SELECT identity, 'repeated_secondary', concat_ws(':', identity, repeat, model, n_train) FROM sec GROUP BY ALL HAVING count(*) > 1""")
def jn16_unpaired_cells(spark, sf):
    p = b.panel(spark, sf)
    sec = p.where("repeat <> 3").withColumn("identity", F.lit("a")).unionByName(p.withColumn("identity", F.lit("b"))).unionByName(p.where("repeat = 5 and n_train = 40").withColumn("identity", F.lit("b")))
    return panel.secondary_violations(p, sec, "identity")


@query("""WITH n AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'F' THEN 0 END AS label, CAST(NULL AS VARCHAR) AS rule FROM lineitem JOIN n USING (l_orderkey, l_suppkey) WHERE n = 1 AND (l_returnflag = 'R' OR l_linestatus = 'F')
  UNION ALL SELECT l_orderkey, l_suppkey, NULL, 'repeated' FROM n WHERE n > 1""")
def prj4_candidates_once(spark, sf):
    """Labels of candidates with one record, and the candidates that have several."""
    labels, wrong = cohort.candidate_labels(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"], F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")
    at = lambda i: F.element_at(F.split("key", ":"), i).cast("long")
    wrong = wrong.select(at(1).alias("l_orderkey"), at(2).alias("l_suppkey"), F.lit(None).cast("int").alias("label"), "rule")
    return labels.select("l_orderkey", "l_suppkey", "label", F.lit(None).cast("string").alias("rule")).unionByName(wrong)


@query(f"""WITH {b.MARKS}, c AS (SELECT play, count(DISTINCT CASE WHEN marker = 'purchase' THEN frame END) AS s, count(DISTINCT CASE WHEN marker IN ('signup', 'error') THEN frame END) AS e FROM marks GROUP BY play)
  SELECT 'several_starts' AS rule, play::VARCHAR AS key FROM c WHERE s > 1 UNION ALL SELECT 'several_stops', play::VARCHAR FROM c WHERE e > 1""")
def win5_several_markers(spark, sf):
    return frames.marker_violations(b.marks(spark, sf), "play", "frame", "marker", {"several_starts": ["purchase"], "several_stops": ["signup", "error"]})


# -- sinks ---------------------------------------------------------------------------------------------------


def _weeks(spark, sf):
    return b.tracking(spark, sf).withColumn("week", (F.col("play") % 9 + 1).cast("int"))


@query(f"""WITH {b.TRACKING}, n AS (SELECT cast(play % 9 + 1 AS INTEGER) AS week, count(*) AS rows FROM tracking GROUP BY ALL)
  SELECT week, cast(ceil(rows / 500) AS BIGINT) AS files, rows, least(rows, 500) AS most FROM n""")
def snk3_bounded_files(spark, sf):
    """Rows written by week in files of at most 500, read back: files, rows and the largest file of each week."""
    path = _place(spark, "weeks")
    weekly.write_bounded(_weeks(spark, sf), path, ["week"], ["play", "frame", "obj"], 500)
    return weekly.files_of(spark.read.parquet(path), ["week"])


@query(f"""WITH {b.TRACKING} SELECT cast(play % 9 + 1 AS INTEGER) AS week, count(*) AS n, {r('sum(CASE WHEN play % 9 + 1 = 4 THEN x + 1 ELSE x END)', 'total', 4)} FROM tracking GROUP BY ALL""")
def snk1_week_replaced(spark, sf):
    """All weeks are written, then week 4 again with other values: what a reader of the table finds."""
    path = _place(spark, "weeks")
    rows = _weeks(spark, sf)
    weekly.write_bounded(rows, path, ["week"], ["play", "frame", "obj"], 2_000)
    weekly.write_bounded(rows.where("week = 4").withColumn("x", F.col("x") + 1), path, ["week"], ["play", "frame", "obj"], 2_000)
    return rounded(spark.read.parquet(path).groupBy("week").agg(F.count("*").alias("n"), F.sum("x").alias("total")), 4)


@query(f"""WITH {b.BINARY}, c AS (SELECT cell, count(*) AS rows, {r('avg((p - y) ** 2)', 'brier', 8)} FROM bin WHERE NOT is_cal GROUP BY cell)
  SELECT cell, 'metrics' AS kind, 1::BIGINT AS rows, brier FROM c UNION ALL SELECT cell, 'predictions', rows, NULL FROM c""")
def snk2_cell_outputs(spark, sf):
    """Metrics and predictions of each cell in one table for each kind, by cell, read back."""
    from fieldlens.operators import scores

    path, test = _place(spark, "cells"), b.binary(spark, sf).where("not is_cal")
    weekly.write_bounded(test.select("cell", "row", "game", "y", "p"), f"{path}/predictions", ["cell"], ["row"], 5_000)
    metrics = test.groupBy("cell").agg(F.avg(scores.brier(F.col("p"), F.col("y"))).alias("brier"))
    weekly.write_bounded(metrics, f"{path}/metrics", ["cell"], ["brier"], 5_000)
    read = [spark.read.parquet(f"{path}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("metrics", "predictions")]
    both = read[0].select("cell", "kind", "brier").unionByName(read[1].select("cell", "kind", F.lit(None).cast("double").alias("brier")))
    return rounded(both.groupBy("cell", "kind").agg(F.count("*").alias("rows"), F.max("brier").alias("brier")), 8)


@query(f"""WITH {b.PANEL}, t AS (SELECT model, n_train, count(*) AS n FROM panel GROUP BY ALL)
  SELECT 'ribbons' AS product, form, 4 * count(*) AS rows FROM t, (VALUES ('csv'), ('parquet')) AS f(form) GROUP BY form
  UNION ALL SELECT 'summary', form, 4 * count(*) FROM t, (VALUES ('csv'), ('parquet')) AS f(form) GROUP BY form""")
def snk4_products(spark, sf):
    """Two products of an analysis as CSV and as Parquet, read back."""
    p, path = b.panel(spark, sf), _place(spark, "products")
    metrics = ["loss", "null_loss", "width", "coverage"]
    products = {"summary": panel.summarize(p, ["model", "n_train"], metrics), "ribbons": panel.ribbons(p, metrics)}
    counts = []
    for form in ("csv", "parquet"):
        tables.write_products(products, f"{path}/{form}", form)
        for name in products:
            read = spark.read.option("header", True).format(form).load(f"{path}/{form}/{name}")
            counts.append(read.agg(F.lit(name).alias("product"), F.lit(form).alias("form"), F.count("*").alias("rows")))
    return contract.union(counts)


# -- calibration registry ------------------------------------------------------------------------------------


def _cells(spark, sf):
    """Intervals of two models that share rows: repeat = the table's cell."""
    p = b.pmfs(spark, sf)
    parts = []
    for name, alpha in (("narrow", 0.3), ("wide", 0.1)):
        lo, hi = conformal.central_interval(F.col("pmf"), alpha)
        parts.append(p.select(F.lit(name).alias("model"), F.col("cell").alias("repeat"), "row", "game", "y", "is_cal", lo.alias("lo"), hi.alias("hi")))
    return parts[0].unionByName(parts[1])


_REGISTRY = """rg AS (SELECT repeat, game, "row" FROM (SELECT *, row_number() OVER (PARTITION BY repeat, game ORDER BY sha256(concat_ws('|', '9', repeat, game, "row")), "row") AS i
  FROM (SELECT DISTINCT cell AS repeat, game, "row" FROM flat WHERE is_cal)) WHERE i = 1)"""


def _registered(spark, sf):
    rows = _cells(spark, sf)
    cal = rows.where("is_cal")
    registry = weekly.written_once(conformal.calibration_registry(cal, ["repeat"], "game", "row", 9), _place(spark, "registry"))
    return cal, rows.where("not is_cal"), registry


@query(f"""WITH {b.PMFS}, {_REGISTRY} SELECT repeat, game, "row" FROM rg""")
def cal6_registry(spark, sf):
    return _registered(spark, sf)[2]


@query(f"""WITH {b.PMFS}, {_REGISTRY} SELECT repeat, 'wide' AS model, count(*) AS missing, 0::BIGINT AS beside, min(game) AS first FROM rg WHERE game IN (7, 11) GROUP BY repeat""")
def cal6_unpaired_models(spark, sf):
    """One of two models lacks two games: it can't be paired."""
    cal, _, registry = _registered(spark, sf)
    return conformal.registry_mismatches(cal.where("model <> 'wide' or game not in (7, 11)"), registry, ["repeat"], ["model"], "game", "row")


@query(f"""WITH {b.PMFS}, {_REGISTRY}, a(model, alpha) AS (VALUES ('narrow', 0.3::DOUBLE), ('wide', 0.1::DOUBLE)),
  itv AS (SELECT model, "row", game, cell AS repeat, y, is_cal, coalesce(min(k) FILTER (cdf >= alpha / 2 - 1e-12), -1) AS lo, coalesce(min(k) FILTER (cdf >= 1 - alpha / 2 - 1e-12), -1) AS hi FROM pmf, a GROUP BY ALL),
  s AS (SELECT model, repeat, greatest(lo - y, y - hi, 0) AS v FROM itv JOIN rg USING (repeat, game, "row") WHERE is_cal),
  k AS (SELECT model, repeat, v, row_number() OVER (PARTITION BY model, repeat ORDER BY v) AS i, count(*) OVER (PARTITION BY model, repeat) AS n FROM s),
  q AS (SELECT model, repeat, coalesce(max(v) FILTER (i = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 64) AS q, ceil((max(n) + 1) * 0.9::DOUBLE - 1e-9) > max(n) AS fb FROM k GROUP BY ALL),
  t AS (SELECT model, repeat, game, fb, y BETWEEN greatest(0, lo - q) AND least(63, hi + q) AS hit, least(63, hi + q) - greatest(0, lo - q) AS width FROM itv JOIN q USING (model, repeat) WHERE NOT is_cal),
  g AS (SELECT model, repeat, game, fb, avg(hit::INTEGER) AS coverage, avg(width) AS width FROM t GROUP BY ALL),
  c AS (SELECT model, repeat, fb, avg(coverage) AS coverage, avg(width) AS width FROM g GROUP BY ALL),
  l AS (SELECT model, fb, metric, v FROM c UNPIVOT (v FOR metric IN (coverage, width)))
  SELECT model, metric, count(*) AS cells, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, {r('quantile_cont(v, 0.1)', 'p10')}, {r('quantile_cont(v, 0.9)', 'p90')}, count_if(fb) AS fallbacks FROM l GROUP BY ALL""")
def cal6_registered_intervals(spark, sf):
    cal, test, registry = _registered(spark, sf)
    out = conformal.registered_intervals(cal, test, registry, ["repeat"], ["model"], "game", "row", "lo", "hi", "y", 64, 0.1)
    return rounded(conformal.cluster_summary(out, ["repeat"], ["model"], "game"))

"""Results that must not hang on the order in which rows arrive, and work of one task that must not grow with the table."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import cohort, conformal, contract, encode, fits, geometry, trees
from fieldlens.plans import pipelines, queries, queries_products
from fieldlens.sources import weekly


def test_replayed_metrics_are_those_registered(spark):
    """Six decimals of the registered ones: of nine, where float noise lies on either side of a tie, and of seven."""
    again = spark.createDataFrame([(0, 0.32694649999), (1, 0.32694650001), (2, 0.5)], "cell int, m double")
    got = {r.cell: (r.recorded, r.again, r.problem) for r in queries_products._replay(again, "m", ["m"], 0, 1).collect()}
    assert got == {0: (None, 0.326947, "unrecorded"), 1: (0.336947, 0.326947, "deviates")}
    seven = spark.createDataFrame([(0, 0.32694646), (1, 0.3)], "cell int, m double")
    assert {r.cell: r.again for r in queries_products._replay(seven, "m", ["m"], 0, 1, 7).collect()} == {0: 0.326947, 1: 0.3}


def test_local_padding_keeps_rows_whatever_order_calibration_rows_arrive_in(spark):
    rng = random.Random(3)
    rows = [(k, k % 2, k % 3 == 0, rng.random(), rng.gauss(0, 1) / 3, rng.randrange(4)) for k in range(1200)]

    def dealt(batches):  # another order each time the plan runs, as blocks of a shuffle have
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=random.SystemRandom().randrange(2**32))

    df = spark.createDataFrame(rows, "row int, cell int, test boolean, a double, b double, score int").coalesce(1)
    cal = df.where("not test").mapInPandas(dealt, df.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = conformal.local_padding(cal, df.where("test"), ["cell"], ["a", "b"], "score", 0.1, 20)
        assert out.where(F.col("padding").isNotNull()).select("row").distinct().count() == 400
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_scores_at_thresholds_are_those_of_the_long_rows(spark):
    """One row with an array of predictions, as the same rows once for each threshold have them."""
    rng = random.Random(5)
    df = spark.createDataFrame([(k, k % 2, rng.random() if k % 50 else None, rng.randrange(4)) for k in range(600)], "row int, cell int, q double, place int")
    long = df.withColumn("t", F.explode(F.array(*[F.lit(k / 3.0) for k in range(3)]))).withColumn("y", (F.col("place") <= F.col("t") * 3).cast("double"))
    d = trees.Boosting(2, False, trees=2, depth=2, rate=0.5, bins=8, least_rows=5)
    fits = trees.boosted_fits(long.where("cell = 0"), ["cell"], ["t", "q"], "y", d)
    want = {}
    for r in trees.boosted_score(long, fits, ["cell"], ["t", "q"], d).orderBy("row", "t").collect():
        want.setdefault(r.row, []).append(r.prediction)
    out = trees.boosted_score(df, fits, ["cell"], ["t", "q"], d, over=("t", [k / 3.0 for k in range(3)]))
    got = {r.row: r.prediction for r in out.collect()}
    assert len(got) == 600 and got[1] is None and got[0] is None
    assert all(v == (None if None in want[k] else want[k]) for k, v in got.items()) and len({tuple(v) for v in got.values() if v}) > 1


@pytest.mark.parametrize(("place", "by"), [(0, ["cell"]), (1, []), (2, ["cell"])])
def test_trees_over_thresholds_are_those_of_the_long_rows(spark, place, by):
    """One row with a label for each threshold gives the model that a row for each of them gives."""
    rng, values = random.Random(7), [k / 3.0 for k in range(4)]
    rows = [(k, k % 2, rng.random() if k % 50 else None, rng.gauss(0, 1) if k % 70 else float("nan"), rng.randrange(5) if k % 90 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "row int, cell int, q double, v double, place int")
    d = trees.Boosting(3, False, trees=2, depth=2, rate=0.5, bins=8, least_rows=5)
    x = ["q", "v"]
    x.insert(place, "t")
    label = lambda t: (F.col("place") - 4 * t * F.col("q")) * (1 + t)
    long = df.withColumn("t", F.explode(F.array(*map(F.lit, values)))).withColumn("y", label(F.col("t")))
    wide = df.select("cell", "q", "v", *[label(F.lit(t)).alias(f"y{k}") for k, t in enumerate(values)])
    key = lambda r: r.cell if by else None
    want = {key(r): r.model for r in trees.boosted_fits(long, by, x, "y", d).collect()}
    got = {key(r): r.model for r in trees.boosted_fits(wide, by, x, [f"y{k}" for k in range(4)], d, ("t", values)).collect()}
    assert set(got) == set(want) and all(v == pytest.approx(want[c], abs=1e-9) for c, v in got.items())
    at = 3 + 3 * 7
    assert all(len({v[at + k + d.tree_size * j] for j in range(2) for k in range(3)}) > 1 for v in got.values())  # splits by several features
    with pytest.raises(ValueError, match="one for each"):
        trees.boosted_fits(wide, ["cell"], x, ["y0", "y1"], d, ("t", values))


def test_blocks_stay_small_enough_for_a_batch_of_the_reader(spark):
    """Spark's reader of Parquet holds 4,096 blocks at once, so a block's bytes are bounded whatever a cell's rows, before and after it's written anew."""
    df = spark.range(0, 60_000, 1, 3).select((F.col("id") % 2).alias("cell"), F.col("id").cast("double").alias("a"), (F.col("id") * 0.5).alias("b"))
    states = spark.createDataFrame([(c, bytearray(8)) for c in (0, 1)], "cell long, state binary")
    data = fits.blocks(df, ["cell"], ["a", "b"])
    wide = trees._rewritten(data, states, ["cell"], lambda r, _: r[:, [0, 1, 0, 1, 0]])
    for blocks, width in ((data, 2), (wide, 5)):
        told = blocks.select("cell", "m", F.length("body").alias("bytes")).collect()
        assert max(r.bytes for r in told) * 4_096 <= 2**26 and all(r.bytes == 8 * width * r.m for r in told)
        assert {c: sum(r.m for r in told if r.cell == c) for c in (0, 1)} == {0: 30_000, 1: 30_000}
        assert len(told) < 700  # and they are filled
    sums = fits.stepped(wide, states, ["cell"], lambda r, _: np.array([len(r), r[:, 1].sum(), 1.0]), lambda s, _: s)
    got = {r.cell: list(memoryview(bytes(r.state)).cast("d")) for r in sums.collect()}
    assert all(v[0] == 30_000 and v[1] == sum(range(c, 60_000, 2)) / 2 and v[2] < 80 for c, v in got.items())  # steps take many blocks at once


def test_raster_is_not_dealt_out_by_the_scalers_cells(spark):
    cells = spark.range(0, 2000, 1, 8).select((F.col("id") % 2).alias("half"), (F.col("id") % 7).cast("double").alias("v"), "id")
    scaler = encode.raster_scaler(cells, ["half"], F.col("id") > 10, ["v"], F.countDistinct("id"), (2, 2))
    out = encode.scaled_raster(cells, scaler, ["half"], ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2000 and "BroadcastHashJoin" in plan and "hashpartitioning(half" not in plan


def test_many_tasks_of_a_week_leave_no_more_files_than_its_rows_fill(spark, tmp_path):
    path = str(tmp_path / "out")
    week = F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("week")
    df = spark.range(0, 3000, 1, 5).select(week, (F.col("id") % 400).alias("play"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        weekly.write_bounded(df, path, ["week"], ["play"], 30, rows_per_task=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    out = spark.read.parquet(path)
    assert sorted((r.week or 0, r.files, r.rows, r.most) for r in weekly.files_of(out, ["week"]).collect()) == [(0, 34, 1000, 30), (1, 34, 1000, 30), (2, 34, 1000, 30)]
    assert sorted(r.id for r in out.collect()) == list(range(3000))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _area(x, y, sites, box=(120.0, 53.0)):
    poly = [(0.0, 0.0), (box[0], 0.0), box, (0.0, box[1])]
    for sx, sy in sites:
        side = lambda p: (sx - x) * p[0] + (sy - y) * p[1] - (sx * sx - x * x + sy * sy - y * y) / 2
        new = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            f, g = side(p), side(q)
            new += [p] * (f <= 0) + ([(p[0] + f / (f - g) * (q[0] - p[0]), p[1] + f / (f - g) * (q[1] - p[1]))] if f * g < 0 else [])
        poly = new
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2


def test_areas_of_a_batch_match_plain_clipping_and_take_one_shuffle(spark):
    """Rows of one batch with 0 to 21 sites, some on the edge, some at the object itself, some without sites; no fold over arrays in the plan."""
    rng = random.Random(4)
    at = lambda: rng.choice([(rng.uniform(0, 120), rng.uniform(0, 53)), (float(rng.randrange(0, 121, 40)), 0.0)])
    rows = [(k, *at(), [at() for _ in range(rng.choice([0, 1, 3, 21]))] if k % 50 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, y double, sites array<struct<x:double,y:double>>").coalesce(1)
    out = df.withColumn("area", geometry.cell_area(F.col("x"), F.col("y"), F.col("sites")))
    for r in out.collect():
        assert (r.area is None) == (r.sites is None) and (r.sites is None or r.area == pytest.approx(_area(r.x, r.y, r.sites), abs=1e-6))
    plan = _plan(queries.QUERIES["feat12_cell_area"](spark, "/root/testdata/sf0.001"))
    assert "aggregate(" not in plan and len(re.findall(r"\bExchange ", plan)) == 1


def test_defender_features_take_one_shuffle(spark):
    plan = _plan(queries.QUERIES["feat10_defender_features"](spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"\bExchange ", plan)) == 1


def test_framewise_scoring_makes_features_once_and_deals_out_no_cell(spark):
    rows = spark.createDataFrame([(k, f, k * f % 7 / 7.0, float(f > 3)) for k in range(20) for f in range(8)], "k int, f int, a double, y double")
    made = rows.mapInPandas(lambda batches: batches, rows.schema)
    plan = _plan(pipelines.framewise_scoring(made, F.col("k") % 2 == 0, ["k"], "f", ["a"], "y", 1.0, 0.3, 2))
    assert "MapInPandas" not in plan and "hashpartitioning(__cell" not in plan and "SortMergeJoin" not in plan


def test_local_padding_passes_on_one_row_a_point_whatever_the_blocks(spark, monkeypatch):
    """Nearest distances and weights of many calibration blocks are merged in the task; scores of which a task holds few give the same paddings."""
    rng = random.Random(8)
    df = spark.createDataFrame([(k, k % 2, k % 3 == 0, rng.random(), rng.random(), rng.random() * 9) for k in range(600)], "row int, cell int, test boolean, a double, b double, score double")
    run = lambda: conformal.local_padding(df.where("not test"), df.where("test"), ["cell"], ["a", "b"], "score", 0.1, 20)
    want = {r.row: r.padding for r in run().collect()}
    monkeypatch.setattr(conformal, "PADDING_BLOCK", 16)
    merged = run()
    assert "row_number" not in _plan(merged) and {r.row: r.padding for r in merged.collect()} == want and len(want) == 200
    monkeypatch.setattr(conformal, "PADDING_HELD", 300)
    assert {r.row: r.padding for r in run().collect()} == want


def test_a_tackle_cohort_shuffles_rows_and_candidates_once(spark):
    plan = _plan(queries.QUERIES["pipe5_tackle_cohort"](spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"\bExchange ", plan)) == 2


def test_states_before_events_meet_rows_dealt_by_play(spark):
    """Rows, rows of candidates and candidates are shuffled, each once by play, also where nothing is small enough to be sent."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(queries.QUERIES["win7_state_before_event"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\bExchange ", plan)) == 3


def test_snapshot_violations_deal_rows_out_once_and_keep_what_they_mean(spark):
    rng = random.Random(9)
    rows = [(k // 4, rng.choice([1, 2, 3, 4, None]), rng.choice(["home", "home", "away", "ball", None]), rng.random() < 0.3, rng.choice([1.5, 1.5, None, 2.5]) if k % 8 < 4 else 1.5) for k in range(1600)]
    df = spark.createDataFrame(rows, "play int, obj int, side string, focal boolean, c double")
    want = {}
    for play in range(400):
        own = [r for r in rows if r[0] == play]
        values = [{r[i] for r in own} - {None} for i in (1, 2, 4)]
        broken = {"objects": len(values[0]) != 4, "focal": sum(r[3] for r in own) != 1, "sides": len(values[1]) != 2 or sum(r[2] == "home" for r in own) != 2, "constant_c": len(values[2]) > 1}
        if any(broken.values()):
            want[play] = [name for name, b in broken.items() if b]
    out = cohort.snapshot_violations(df, "play", "obj", "side", F.col("focal"), 4, ["c"])
    plan = _plan(out)  # before it runs
    assert len(re.findall(r"\bExchange ", plan)) == 1 and "Expand" not in plan
    assert {r.play: r.problems for r in out.collect()} == want


def test_a_report_reads_violations_once_and_sorts_none(spark):
    rng = random.Random(11)
    rows = [(rng.choice("abc"), f"{rng.randrange(60)}:é") for _ in range(3000)]
    made = spark.createDataFrame(rows, "rule string, key string").repartition(7).mapInPandas(lambda batches: batches, "rule string, key string")
    out = contract.report(made, ["a", "b", "none"])
    plan = _plan(out)
    assert plan.count("MapInPandas") == 1 and "row_number" not in plan
    got = {r.rule: (r.n, r.first) for r in out.collect()}
    assert got == {"none": (0, []), **{k: (sum(r == k for r, _ in rows), sorted({key for r, key in rows if r == k})[:3]) for k in "ab"}}


def test_a_snapshot_contract_counts_objects_without_an_expansion(spark):
    rows = [(1, 1, 1, "h", 5), (1, 1, 1, "a", 5), (1, None, 1, "a", 5), (2, 1, 1, "h", None), (2, 2, 1, "a", 5), (3, 1, 1, "h", None), (3, 2, 1, "a", None), (4, 1, 1, "h", 5), (4, 2, 1, "a", 6)]
    df = spark.createDataFrame(rows, "play int, obj int, lead int, side string, c int")
    wrong = contract.snapshot_contract(df, ["play"], "obj", "lead", "side", ["h", "a"], ["c"], [], [], [], {}, 2)
    assert "Expand" not in _plan(wrong)
    assert sorted((r.rule, r.key) for r in wrong.collect()) == [("c_constant", "2"), ("c_constant", "4"), ("focal", "1"), ("objects", "1"), ("rows", "1")]


def test_horizons_read_lines_once(spark):
    from fieldlens.plans import queries_fits  # noqa: F401  registers the query

    plan = _plan(queries.QUERIES["ml3_boosted_horizons"](spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in plan and "Join" not in plan  # scores read the rows that the fit read, before they were joined anew
    one = spark.createDataFrame([(1, 3, "a"), (2, 1, "b")], "k int, n int, c string")
    assert sorted((r.k, r.h, r.c) for r in encode.horizon_rows(one, "k", "n", 2, ["c"]).collect()) == [(1, 1, "a"), (1, 2, "a"), (2, 1, "b")]


def test_thresholds_do_not_join_rows_with_what_they_have(spark):
    """The rusher's own side and an example's label are in the row: 23 joins, with those of the contract repeated, before."""
    from fieldlens.plans import queries_cohorts  # noqa: F401  registers the query

    plan = queries.QUERIES["pipe1_thresholds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Join ", plan)) <= 5

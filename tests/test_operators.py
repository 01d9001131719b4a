"""Operators on tiny tables with answers worked out by hand."""

import hashlib
import hmac
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.operators import automaton, conformal, design, encode, frames, geometry, inference, panel, scores
from fieldlens.sources import tables


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_scalars(spark):
    s = F.lit
    assert one(spark, fn.clock_seconds(s("12:30"))) == 750 and one(spark, fn.clock_seconds(s("01:02:99"))) == 62 and one(spark, fn.clock_seconds(s("45"))) == 45
    assert one(spark, fn.clock_seconds(s("x"))) is None
    assert one(spark, fn.first_integer(s("20;21"))) == 20 and one(spark, fn.first_integer(s("none"))) is None
    assert one(spark, fn.feet_inches(s(" 6-2 "))) == 74 and one(spark, fn.feet_inches(s("6'2"))) is None
    assert [one(spark, fn.loose_boolean(s(x))) for x in ("True", "1.0", "0", None)] == [True, True, False, False]
    assert [one(spark, fn.sentinel_number(s(x))) for x in ("1.5", "NA", "", " 2 ")] == [1.5, None, None, 2.0]
    assert one(spark, fn.side_name(s("Home"), s("AAA"), s("BBB"))) == "AAA" and one(spark, fn.other_side(s("BBB"), s("AAA"), s("BBB"))) == "AAA"
    assert one(spark, fn.lookup(s("qb"), {"QB": "passer"}, "other")) == "passer" and one(spark, fn.lookup(s("zz"), {"QB": "passer"}, "other")) == "other"
    assert one(spark, fn.yards_from_own_goal(s(30), s(False))) == 70
    sin, cos = fn.angle_components(s(0.0), s(False))
    assert one(spark, sin) == pytest.approx(1) and one(spark, cos) == pytest.approx(0, abs=1e-12)


def test_hashes_equal_hashlib(spark):
    assert one(spark, fn.sha_number(F.lit("k"), 7)) == int(hashlib.sha256(b"k").hexdigest()[:16], 16) % 7
    mac = hmac.new(b"fieldlens", b"key", hashlib.sha256).hexdigest()
    assert one(spark, fn.stable_seed(F.lit("key"))) == int(mac[:8], 16) % (1 << 31)
    assert one(spark, fn.canonical_json(b=F.lit(2), a=F.lit("x"))) == '{"a":"x","b":2}'
    base, scope = fn.metric_scope(F.lit("loss_game_equal"))
    assert (one(spark, base), one(spark, scope)) == ("loss", "game")


def test_t_critical_is_near_tables():
    for df, value in ((19, 2.0930), (49, 2.0096), (99, 1.9842)):
        assert fn.t_critical(0.95, df) == pytest.approx(value, abs=2e-3)


def test_probability_vectors(spark):
    p = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.7)])
    assert one(spark, fn.cumulative(p)) == pytest.approx([0.1, 0.3, 1.0])
    assert one(spark, fn.pmf_mean(p)) == pytest.approx(1.6) and one(spark, fn.pmf_sd(p)) == pytest.approx(math.sqrt(0.44))
    assert one(spark, fn.valid_pmf(p, 3)) and not one(spark, fn.valid_pmf(p, 4))
    pairs = F.array(*[F.struct(F.lit(float(v)).alias("value"), F.lit(w).alias("weight")) for v, w in ((3, 1.0), (1, 2.0), (2, 1.0))])
    assert one(spark, fn.weighted_quantile(pairs, F.lit(0.5))) == 1.0 and one(spark, fn.weighted_quantile(pairs, F.lit(0.7))) == 2.0


def test_scores_with_known_answers(spark):
    df = spark.createDataFrame([(0, 0.1, 1), (1, 0.8, 1), (1, 0.7, 2), (0, 0.2, 2)], "y int, p double, game int")
    assert df.agg(F.avg(scores.brier(F.col("p"), F.col("y")))).first()[0] == pytest.approx(0.045)
    assert scores.game_equal(df, [], "game", {"b": scores.brier(F.col("p"), F.col("y"))}).first().b == pytest.approx(0.045)
    assert scores.prevalence(df, [], "y").first().prevalence == pytest.approx(0.5)
    assert one(spark, fn.skill(F.lit(0.25), F.lit(0.5))) == 0.5 and one(spark, fn.skill(F.lit(0.25), F.lit(0.0))) is None
    eye = spark.createDataFrame([(k, [float(i == k) for i in range(4)]) for k in range(4)], "y int, pmf array<double>")
    assert eye.agg(F.max(scores.crps(F.col("pmf"), F.col("y")))).first()[0] == 0
    path = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0)], "e int, dx double, dy double")
    assert scores.pooled_rmse(scores.path_errors(path, "e", F.col("dx"), F.col("dy")), []).first().rmse == 1.0


def test_automaton_cases(spark):
    def run(values, ids=None):
        ids = ids or range(1, len(values) + 1)
        df = spark.createDataFrame([(1, i, v) for i, v in zip(ids, values)], "k int, f int, p double")
        r = automaton.opportunities(df, ["k"], "f", "p").first()
        return r.opportunities, r.misses, r.open_frames, r.miss_frames

    high, low = [0.9] * 5, [0.1] * 5
    assert run(high + low) == (1, 1, "5", "10")
    assert run([0.75] * 10) == (0, 0, "", "")  # strictly above
    assert run(high + low[:4] + [0.9] + low) == (1, 1, "5", "15")  # a high frame while declining starts the count anew
    assert run(high + low, [*range(1, 5), *range(6, 12)]) == (0, 0, "", "")  # a gap resets
    assert run(high + low + high) == (2, 1, "5,15", "10")


def test_cutoff_rules(spark):
    rows = [(1, 3, "Throw"), (1, 5, "throw"), (1, 3, "snap"), (2, 4, "throw"), (3, 1, "none"), (4, 2, "throw"), (4, 2, "throw")]
    df = spark.createDataFrame(rows, "play int, frame int, marker string")
    ball = spark.createDataFrame([(1, 3), (2, 9), (4, 2)], "play int, frame int")
    got = {r.play: (r.cutoff, r.status, r.events) for r in frames.discover_cutoffs(df, df, "play", "frame", "marker", ["throw", "snap"], valid=ball).collect()}
    assert got == {1: (3, "kept", "snap+throw"), 2: (4, "invalid_frame", "throw"), 3: (None, "no_marker", None), 4: (2, "kept", "throw")}
    unique = {r.play: r.status for r in frames.discover_cutoffs(df, df, "play", "frame", "marker", ["throw"], unique=True).collect()}
    assert unique == {1: "ambiguous", 2: "kept", 3: "no_marker", 4: "kept"}


def test_windows_count_observed_frames_and_partitions_do_not_matter(spark):
    rows = spark.createDataFrame([(1, f) for f in (1, 2, 5, 9, 10, 11)], "play int, frame int")
    cut = spark.createDataFrame([(1, 10)], "play int, cutoff int")
    want = [(2, 0), (5, 1), (9, 2), (10, 3)]
    for n in (1, 17):
        got = frames.history_windows(rows.repartition(n), cut, "play", "frame", 4).collect()
        assert sorted((r.frame, r.time_index) for r in got) == want
    with pytest.raises(ValueError, match="passResult"):
        frames.forbid(rows.withColumn("passResult", F.lit(1)), {"passResult"})


def test_isotonic_equals_pool_adjacent_violators(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 80), rng.random(80)
    blocks = []
    for v in sorted(set(x)):
        blocks.append([y[x == v].sum(), (x == v).sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n, vs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + vs]
    want = {int(v): s / n for s, n, vs in blocks for v in vs}
    df = spark.createDataFrame([(1, int(a), float(b), 1.0) for a, b in zip(x, y)], "cell int, x int, y double, w double")
    got = {r.x: r.fitted for r in conformal.isotonic(df, ["cell"], "x", "y", "w").collect()}
    assert got == pytest.approx(want)


def test_venn_abers_is_exact_over_unrounded_scores(spark, monkeypatch):
    monkeypatch.setattr(conformal, "RANGE_SCORES", 8)
    rng = random.Random(2)
    rows = []
    for k in range(700):
        p = round(rng.random(), rng.choice([2, 6]))
        rows.append((k, "ab"[k % 2], p, int(rng.random() < 0.2 + 0.6 * p), k % 5 > 0))
    df = spark.createDataFrame(rows, "row int, cell string, p double, y int, is_cal boolean")
    got = conformal.venn_abers(df.where("is_cal"), df.where("not is_cal"), ["cell"], "p", "y").collect()
    assert len(got) == 140
    for r in got:
        for label, fit in ((0, r.p0), (1, r.p1)):
            points = {}
            for _, cell, p, y, is_cal in [*rows, (0, r.cell, r.p, label, True)]:
                if is_cal and cell == r.cell:
                    n, s = points.get(p, (0, 0))
                    points[p] = (n + 1, s + y)
            at = sorted(points)
            n, s = (np.concatenate([[0], np.cumsum([points[x][i] for x in at])]) for i in (0, 1))
            k = at.index(r.p)
            means = (s[None, k + 1 :] - s[: k + 1, None]) / (n[None, k + 1 :] - n[: k + 1, None])
            assert abs(means.min(axis=1).max() - fit) < 1e-12


def test_local_padding_in_blocks_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conformal, "PADDING_BLOCK", 16)  # before, a cell was one array
    rng = random.Random(4)
    rows = [(i, i % 2, rng.randrange(40) / 8, rng.random(), rng.randrange(12), i % 3 > 0) for i in range(240)]
    df = spark.createDataFrame(rows + [(900 + i, *rows[1][1:]) for i in range(30)], "row int, cell int, a double, b double, score int, is_cal boolean")
    rows = [tuple(r) for r in df.collect()]
    got = {r.row: r.padding for r in conformal.local_padding(df.where("is_cal"), df.where("not is_cal"), ["cell"], ["a", "b"], "score", 0.1, 20).collect()}
    want = {}
    for i, cell, a, b, _, is_cal in rows:
        if not is_cal:
            cal = [r for r in rows if r[5] and r[1] == cell]
            x = np.array([r[2:4] for r in cal])
            d2 = (((x - [a, b]) / x.std(axis=0)) ** 2).sum(axis=1)
            w, v = np.exp(-d2 / (2 * max(np.sort(d2)[19], 1e-12))), np.array([r[4] for r in cal])
            order = np.argsort(v, kind="stable")
            goal = w.sum() * min(1, 0.9 * (len(cal) + 1) / len(cal))
            want[i] = v[order][np.argmax(np.cumsum(w[order]) >= goal - 1e-12)]
    assert got == want


def test_split_quantile_falls_back_beyond_n(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(5)] + [(2, float(i)) for i in range(99)], "c int, s double")
    got = {r.c: r["quantile"] for r in conformal.split_quantile(df, ["c"], "s", 0.1, 1e6).collect()}
    assert got == {1: 1e6, 2: 89.0}
    assert {r.c: r["quantile"] for r in conformal.split_quantile(df, ["c"], "s", 0.1, None).collect()}[1] == 4.0


def test_carrier_area_by_sampling(spark):
    rng = np.random.default_rng(2)
    pts = [(4.0, 20.0), (10.0, 25.0), (3.0, 40.0), (30.0, 10.0)]
    df = spark.createDataFrame([(pts[0][0], pts[0][1], [dict(x=a, y=b) for a, b in pts[1:]])], "x double, y double, o array<struct<x:double,y:double>>")
    got = df.select(geometry.carrier_area(F.col("x"), F.col("y"), F.col("o"))).first()[0]
    sites = np.array([*pts, (pts[0][0] - 10, pts[0][1]), (10 - pts[0][0], pts[0][1])])
    sample = rng.random((200_000, 2)) * [120, 53]
    share = (((sample[:, None, :] - sites[None]) ** 2).sum(axis=2).argmin(axis=1) == 0).mean()
    assert got == pytest.approx(share * 120 * 53, rel=0.05)


def test_influence_integrates_to_one(spark):
    g = np.arange(-30, 30, 0.25)
    df = spark.createDataFrame([(float(a), float(b)) for a in g for b in g], "dx double, dy double")
    total = df.agg(F.sum(geometry.influence(F.col("dx"), F.col("dy"), F.lit(6.0), F.lit(0.7)))).first()[0] * 0.25**2
    assert total == pytest.approx(1, abs=1e-3)


def test_max_t_matches_numpy(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.1, 0.2, (12, 3))
    df = spark.createDataFrame([(r + 1, f"e{k}", float(d[r, k])) for r in range(12) for k in range(3)], "repeat int, e string, difference double")
    got = {r.e: r for r in inference.max_t_intervals(df, ["e"], 12, 300, 7).collect()}
    idx = np.array([[int(hashlib.md5(f"7|{b}|{i}".encode()).hexdigest()[:8], 16) % 12 for i in range(12)] for b in range(1, 301)])
    boot = d[idx]
    t = np.abs((boot.mean(1) - d.mean(0)) / (boot.std(1, ddof=1) / math.sqrt(12))).max(1)
    crit = max(np.sort(t)[math.ceil(0.95 * 299)], fn.t_critical(0.95, 11))
    assert got["e0"].critical == pytest.approx(crit)
    assert got["e1"].lower == pytest.approx(d[:, 1].mean() - crit * d[:, 1].std(ddof=1) / math.sqrt(12))


def test_bca_contains_the_deviation(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(r, "m", 1, float(x)) for r, x in enumerate(rng.normal(0, 1, 40), 1)], "repeat int, model string, n_train int, loss double")
    r = inference.bca_sd(df, "loss", ["model", "n_train"], 40, 400, 5).first()
    assert r.lower < r.sd < r.upper and 0.5 < r.lower and r.upper < 2


def test_decisions(spark):
    rows = [(10, "a", "b", -2.0, -1.0), (10, "a", "c", -3.0, -1.0), (10, "b", "c", -1.0, 1.0), (20, "a", "b", -1.0, 1.0), (20, "a", "c", -1.0, 1.0), (20, "b", "c", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "n_train int, left string, right string, lower double, upper double")
    assert {r.n_train: r.supported_best for r in inference.supported_best(df, ["n_train"]).collect()} == {10: "a", 20: None}
    bounds = spark.createDataFrame([(n, m, m != "c") for n in (10, 20) for m in "abc"], "n_train int, model string, reaches boolean")
    got = {(r.n_train, r.left, r.right): r.verdict for r in inference.controlled_sharpness(df, bounds, ["n_train"]).collect()}
    assert got[(10, "a", "b")] == "left_sharper" and got[(10, "a", "c")] == "not_qualified" and got[(20, "a", "b")] == "inconclusive"


def test_largest_remainder_and_order(spark):
    caps = spark.createDataFrame([("a", 10), ("b", 10), ("c", 5)], "stratum string, capacity long")
    got = {r.stratum: r.allocation for r in design.largest_remainder(caps, [], "stratum", "capacity", F.lit(7)).collect()}
    assert got == {"a": 3, "b": 3, "c": 1}
    games = spark.createDataFrame([(i, "x" if i < 30 else "y") for i in range(40)], "game int, stratum string")
    splits = design.outer_splits(games, "game", "stratum", 3, {"train": 20, "test": 8}, 1)
    assert design.split_violations(splits, "game").count() == 0
    o = design.balanced_order(splits.where("role = 'train'"), ["repeat"], "game", "stratum", "place")
    half = o.where("train_order <= 12 and stratum = 'x'").groupBy("repeat").count().collect()
    assert all(r["count"] == 9 for r in half)
    sizes = [r["count"] for r in design.folds(games, "game", "stratum", 4, 2).groupBy("fold").count().collect()]
    assert sizes == [10] * 4


def test_encoders(spark):
    df = spark.createDataFrame([(1, True, 1.0), (2, True, None), (3, True, 3.0), (4, False, 5.0)], "k int, tr boolean, v double")
    z = {r.k: r.z_v for r in encode.standardize(df, [], F.col("tr"), ["v"]).collect()}
    assert z[2] == 0 and z[4] == pytest.approx(3 / math.sqrt(2 / 3))
    c = spark.createDataFrame([(1, True, "b"), (2, True, "a"), (3, False, None), (4, False, "z")], "k int, tr boolean, c string")
    assert sorted((r.k, r.level) for r in encode.one_hot(c, "k", F.col("tr"), "c").collect()) == [(1, "b"), (2, "a"), (3, "a")]


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 2))
    y = x @ [1.0, -2.0] + 0.5 + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "cell int, a double, b double, y double")
    beta = encode.ridge_fit(encode.ridge_moments(df, ["cell"], ["a", "b"], "y"), ["cell"], 3, 2.0)
    full = np.c_[np.ones(50), x]
    want = np.linalg.solve(full.T @ full + np.diag([0, 2.0, 2.0]), full.T @ y)
    assert beta.first().beta == pytest.approx(list(want))
    assert encode.linear_score(df, beta, ["cell"], ["a", "b"]).where(F.col("a") == float(x[0, 0])).first().prediction == pytest.approx(float(full[0] @ want))


def test_grid_and_comparison(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "repeat int, model string")
    assert sorted((r.repeat, r.model, r.problem) for r in panel.grid_check(df, ["repeat", "model"]).collect()) == [(2, "a", "duplicate"), (2, "b", "missing")]
    l_, r_ = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "k int, v int"), spark.createDataFrame([(1, 1), (2, 5), (4, 3)], "k int, v int")
    assert tuple(panel.compare_tables(l_, r_, ["k"], ["v"]).first()) == (3, 3, 1, 1, 1)


def test_sources(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "week_03.csv").write_text("gameId,x\n1,2.5\n2,NA\n")
    schema = T.StructType([T.StructField("gameId", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("event", T.StringType())])
    df = tables.with_week(tables.read_csv(spark, str(tmp_path / "week_03.csv"), schema, ["gameId"]))
    assert [tuple(r) for r in df.orderBy("gameId").collect()] == [(1, 2.5, None, 3), (2, None, None, 3)]
    with pytest.raises(ValueError, match="frameId"):
        tables.read_csv(spark, str(tmp_path / "week_03.csv"), schema, ["frameId"])
    assert tables.read_any(spark, str(tmp_path), "week_03").count() == 2
    with pytest.raises(ValueError, match="found 0"):
        tables.read_any(spark, str(tmp_path), "plays")
    tables.write_prepared(df.select("gameId", "week"), str(tmp_path / "out"), ["week"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert tables.week_differences(df, df.withColumn("week", F.lit(4))).count() == 2


def test_streaming_automaton_equals_batch(spark, tmp_path):
    from fieldlens.streaming import incremental

    rng = np.random.default_rng(6)
    rows = [(k, f, float(rng.random() < 0.6)) for k in range(4) for f in range(1, 61)]
    df = spark.createDataFrame(rows, "k int, frame long, p double")
    for week, (lo, hi) in enumerate(((0, 20), (20, 41), (41, 60))):
        df.where((F.col("frame") > lo) & (F.col("frame") <= hi)).coalesce(1).write.parquet(str(tmp_path / f"in/w{week}"))
    stream = spark.readStream.schema("k int, frame long, p double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    events = incremental.opportunity_events(stream, "k", "frame", "p", 0.5, 3)
    q = events.writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.frame, r.event) for r in spark.sql("select * from events").collect()}
    batch = automaton.opportunities(df, ["k"], "frame", "p", 0.5, 3).collect()
    want = {(r.k, int(f), e) for r in batch for e, s in (("open", r.open_frames), ("miss", r.miss_frames)) for f in s.split(",") if f}
    assert got == want and want


def test_ingest_skips_what_it_has_seen(spark, tmp_path):
    from fieldlens.streaming import incremental

    args = (spark, str(tmp_path / "in"), "week int, x int", str(tmp_path / "out"), str(tmp_path / "ck"), lambda d: d.withColumn("y", F.col("x") * 2), "week")
    spark.createDataFrame([(1, 1), (1, 2)], "week int, x int").write.parquet(str(tmp_path / "in"))
    incremental.ingest(*args)
    incremental.ingest(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([(2, 5)], "week int, x int").write.mode("append").parquet(str(tmp_path / "in"))
    incremental.ingest(*args)
    assert sorted(r.y for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4, 10]

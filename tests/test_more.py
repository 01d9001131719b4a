"""Opportunities, splits, tackle features, cells and tokens against brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.operators import automaton, cells, conformal, design, inference, models, panel, tackle, tokens
from fieldlens.sources import tables
from fieldlens.streaming import incremental


def decided(frames, threshold, need):
    """Frame by frame: the event, if any, that the definition puts there."""
    out, kind, length, opened, last = [], None, 0, False, None
    for f, p in sorted(frames.items()):
        if last is not None and f != last + 1:
            kind, length, opened = None, 0, False
        length = length + 1 if kind == (p > threshold) else 1
        kind, last = p > threshold, f
        if length == need and kind != opened:
            opened = kind
            out.append((f, "open" if kind else "miss"))
    return out


def frames_of(seed, n=200):
    rng = random.Random(seed)
    return {f: rng.choice([0.1, 0.1, 0.9, 0.9, 0.5]) for f in range(n) if rng.random() > 0.05}


def test_opportunities_follow_the_definition(spark):
    plays = {k: frames_of(k) for k in range(40)}
    rows = [(k, f, p) for k, x in plays.items() for f, p in x.items()]
    rows += [(99, f, v) for f, v in enumerate([float("nan"), None, float("inf"), 0.9, 0.9, 0.9])] + [(98, 1, 0.2), (98, 1, 0.9), (98, 2, 0.9), (98, 3, 0.9)]
    df = spark.createDataFrame(rows, "k int, frame int, p double").repartition(5)
    got = {r.k: r for r in automaton.opportunities(df, ["k"], "frame", "p", 0.5, 3).collect()}
    for k, x in plays.items():
        events = decided(x, 0.5, 3)
        assert got[k].open_frames == ",".join(str(f) for f, e in events if e == "open")
        assert got[k].miss_frames == ",".join(str(f) for f, e in events if e == "miss") and got[k].n_frames == len(x)
    assert (got[99].n_frames, got[99].open_frames) == (3, "5")  # what is no score leaves a gap
    assert (got[98].n_frames, got[98].open_frames) == (3, "3")  # the larger of two scores of a frame


def test_stream_equals_batch_over_many_batches_and_names_late_frames(spark, tmp_path):
    plays = {k: frames_of(100 + k, 90) for k in range(6)}
    schema = "k int, frame int, p double"
    for b in range(3):  # 30 frames a batch; the second brings one frame of the first again
        rows = [(k, f, p) for k, x in plays.items() for f, p in x.items() if b * 30 <= f < b * 30 + 30] + ([(0, min(plays[0]), 0.9)] if b == 1 else []) + [(1, 30 * b, float("nan"))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events = incremental.opportunity_events(stream, "k", "frame", "p", 0.5, 3)
    seen = []
    events.writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    late = [(r.k, r.frame) for r in seen if r.event == "late"]
    assert late == [(0, min(plays[0]))]
    want = {(k, f, e) for k, x in plays.items() for f, e in decided(x, 0.5, 3)}
    assert {(r.k, r.frame, r.event) for r in seen if r.event != "late"} == want


def test_balanced_order_is_the_greedy_one(spark):
    for caps in ([5, 3, 1], [17, 13, 11, 9], [4], [2, 2, 2]):
        names = [f"s{i}" for i in range(len(caps))]
        rows = [(1, f"{s}-{k}", s, k) for s, c in zip(names, caps, strict=True) for k in range(c)]
        got = design.balanced_order(spark.createDataFrame(rows, "repeat int, game string, stratum string, place int"), ["repeat"], "game", "stratum", "place").orderBy("train_order").collect()
        total, used, want = sum(caps), [0] * len(caps), []
        for t in range(1, total + 1):
            i = max((k for k in range(len(caps)) if used[k] < caps[k]), key=lambda k: (t * caps[k] - used[k] * total, -k))  # noqa: B023
            want.append(f"{names[i]}-{used[i]}")
            used[i] += 1
        assert [r.game for r in got] == want


def test_folds_are_balanced_overall_and_by_stratum(spark):
    rows = [(f"g{s}{k}", f"s{s}") for s, n in enumerate([13, 7, 22, 1]) for k in range(n)]
    got = design.folds(spark.createDataFrame(rows, "game string, stratum string"), "game", "stratum", 5, 3).toPandas()
    assert len(got) == 43 and sorted(got.groupby("fold").size()) == [8, 8, 9, 9, 9]
    per = got.groupby(["stratum", "fold"]).size().unstack(fill_value=0)
    assert ((per.max(axis=1) - per.min(axis=1)) <= 2).all()


def test_inner_splits_and_nesting(spark):
    rows = [(1, f"g{k}", f"s{k % 3}") for k in range(31)]
    got = design.inner_splits(spark.createDataFrame(rows, "repeat int, game string, stratum string"), ["repeat"], "game", "stratum", {"tune": 1, "validation": 1}, 5, 4).toPandas()
    assert got.groupby("part").size().to_dict() == {"fit": 17, "tune": 7, "validation": 7}


def test_best_set_rejects_what_is_clearly_worse(spark):
    rng = np.random.default_rng(4)
    rows = [(r, 10, m, float(base + rng.normal(0, 0.1))) for r in range(1, 31) for m, base in (("a", 1.0), ("b", 1.01), ("c", 2.0))]
    d = panel.paired_models(spark.createDataFrame(rows, "repeat int, n_train int, model string, loss double"), "loss")
    got = {r.model: r for r in inference.best_set(d, ["n_train"], 30, 300, 1).collect()}
    assert got["a"].in_best_set and not got["c"].in_best_set and got["c"].p_value == 0 and got["a"].p_value >= 0.05


def test_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,extra\n1,2,q\nNA,4,q\n")
    (tmp_path / "b.csv").write_text("y,x\n20,10\n")
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("z", T.DoubleType())])
    got = tables.read_csv(spark, str(tmp_path), schema, ["x", "y"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, None), (None, 4, None), (10, 20, None)], key=str)
    (tmp_path / "c.csv").write_text("x,y\nseven,1\n")
    with pytest.raises(Exception, match="not of type"):
        tables.read_csv(spark, str(tmp_path), schema, ["x", "y"]).collect()
    (tmp_path / "c.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="missing columns: y"):
        tables.read_csv(spark, str(tmp_path), schema, ["x", "y"])


def influence(p, at):
    th = math.radians(p["dir"])
    r = np.array([[math.cos(th), -math.sin(th)], [math.sin(th), math.cos(th)]])
    s = np.diag([(3 + 3 * p["s"] / 18) / 2, (3 - 3 * p["s"] / 18) / 2])
    cov = r @ s @ s @ r.T
    d = np.array(at) - (np.array([p["x"], p["y"]]) + 0.5 * p["s"] * r[:, 0])
    return math.exp(-0.5 * d @ np.linalg.inv(cov) @ d) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))


def test_defender_features_match_numpy(spark):
    rng = random.Random(2)
    players = [{"frame": 1, "id": i, "team": "o" if i < 4 else "d", "carrier": i == 0, "x": rng.uniform(20, 60), "y": rng.uniform(5, 48), "s": rng.uniform(0, 8), "dir": rng.uniform(0, 360)} for i in range(8)]
    rows = [(1, 1, p["id"], p["team"], p["carrier"], p["x"], p["y"], p["s"], p["dir"], True) for p in players] + [(1, 2, 0, "o", True, 1.0, 1.0, 1.0, 1.0, False), (1, 3, 5, "d", False, 1.0, 1.0, 1.0, 1.0, False)]
    rows += [(1, 1, 9, "d", False, None, 1.0, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "play int, frame int, id int, team string, carrier boolean, x double, y double, s double, dir double, run boolean")
    got = tackle.defender_features(df, ["play", "frame"], "id", F.col("carrier"), F.col("team") == "o", F.col("team") == "d", F.col("run")).toPandas().set_index("id")
    assert set(got.index) == {4, 5, 6, 7} and list(got.columns) == ["play", "frame", *tackle.FEATURES]
    c, off, dfn = players[0], players[1:4], players[4:]
    v = lambda p: (p["s"] * math.cos(math.radians(p["dir"])), p["s"] * math.sin(math.radians(p["dir"])))
    team = sum(influence(p, (c["x"], c["y"])) for p in off) - sum(influence(p, (c["x"], c["y"])) for p in dfn)
    pts = np.random.default_rng(1).uniform((0, 0), (120, 53), (200_000, 2))
    sites = np.array([[p["x"], p["y"]] for p in players[1:]] + [[c["x"] - 10, c["y"]]])
    mine = ((pts - [c["x"], c["y"]]) ** 2).sum(1) < ((pts[:, None] - sites) ** 2).sum(2).min(1)
    for p in dfn:
        r = got.loc[p["id"]]
        aim = math.atan2(c["y"] + v(c)[1] - p["y"], c["x"] + v(c)[0] - p["x"])
        want = [c["s"], v(p)[0] - v(c)[0], abs(v(p)[1] - v(c)[1]), math.dist((c["x"], c["y"]), (p["x"], p["y"])), math.cos(aim - math.radians(p["dir"]))]
        assert r[tackle.FEATURES[:5]].tolist() == pytest.approx(want)
        assert r.team_influence == pytest.approx(team) and r.blocker_influence == pytest.approx(sum(influence(q, (p["x"], p["y"])) for q in off)) and r.is_run == 1
        assert r.cell_area == pytest.approx(mine.mean() * 120 * 53, rel=0.03)


def test_residual_pmf_is_a_pooled_distribution(spark):
    rng = np.random.default_rng(3)
    base, res = np.cumsum(rng.dirichlet(np.ones(25), 20), axis=1), rng.normal(0, 0.2, (20, 25))
    df = spark.createDataFrame([(i, base[i].tolist(), res[i].tolist()) for i in range(20)], "i int, b array<double>, r array<double>")
    got = df.select("i", models.residual_pmf(F.col("r"), F.col("b")).alias("p")).toPandas().set_index("i").p
    for i in range(20):
        raw, n = np.clip(base[i] + res[i], 0, 1), 25
        fit = np.array([max(min(raw[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)])
        fit[-1] = 1
        assert got[i] == pytest.approx(np.diff(fit, prepend=0).tolist())


def test_order_statistic_counts_ties(spark):
    rows = [("a", float(v)) for v in [1, 1, 1, 2, 2, 3, 3, 3, 3, 9]] + [("b", 1.0), ("b", None)]
    got = {r.c: (r.n_cal, r["rank"], r.quantile) for r in conformal.split_quantile(spark.createDataFrame(rows, "c string, v double"), ["c"], "v", 0.2, 99.0).collect()}
    assert got == {"a": (10, 9, 3.0), "b": (1, 2, 99.0)}


def test_replay_names_what_differs(spark):
    a = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, None), (3, 0.5, 1.0)], "cell int, brier double, width double")
    b = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.6, None), (4, 0.5, 1.0)], "cell int, brier double, width double")
    got = {(r.cell, r.metric, r.problem) for r in cells.replayed(a, b, ["cell"], ["brier", "width"]).collect()}
    assert got == {(2, "brier", "deviates"), (3, "brier", "not_recomputed"), (3, "width", "not_recomputed"), (4, "brier", "unrecorded"), (4, "width", "unrecorded")}


def test_edges_later_rules_win_and_ablations(spark):
    rows = [(1, 1, 1, "qb", 1.0, 0.0, 0.0, 1.0), (1, 1, 2, "rb", 1.0, 0.0, 0.0, 0.0), (1, 1, 3, "dl", 0.0, 1.0, 0.0, 0.0), (1, 1, 4, "db", 0.0, 1.0, 0.0, 0.0), (1, 1, 5, "ball", 0.0, 0.0, 1.0, 0.0), (1, 1, 6, "special", 1.0, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, 'play int, frame int, id int, `group` string, offense double, defense double, football double, focal double')
    edges = lambda task, ablation=None: {(r.target, r.source): r.edge for r in tokens.typed_edges(t, ["play", "frame"], "id", task, ablation).collect()}
    sack = edges("sack")
    assert len(sack) == 20 and 6 not in {x for k in sack for x in k}  # the kicker is no node
    assert sack[2, 3] == sack[3, 2] == "protector_rusher" and sack[1, 2] == "quarterback_protector" and sack[1, 3] == "quarterback_rusher" and sack[2, 4] == "receiver_coverage" and sack[1, 5] == "none"
    assert set(edges("sack", "collapse").values()) == {"generic_relation"}
    run = edges("rushing")
    assert run[2, 6] == run[3, 4] == "same_team_lane" and run[2, 3] == "blocker_coverer" and (2, 3) not in edges("rushing", "drop_blocker_coverer")
    assert edges("trajectory", "no_social") == {} and edges("trajectory")[1, 3] == "focal_opponent" and edges("trajectory")[2, 6] == "same_side_social"
    with pytest.raises(ValueError, match="collide"):
        tokens.combined(t.select("id", "group"), [t.select("id", "group")], "id")

"""Contracts with violating fixtures, weekly files, and sinks that replace a week."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.operators import cohort, conformal, contract, frames, panel, tokens
from fieldlens.sources import tables, weekly

SCHEMA = T.StructType().add("play", "long").add("x", "double")


def snapshot(spark, change=lambda rows: rows):
    rows = [dict(play=p, obj=k, rusher=1, side="home" if k < 3 else "away", x=float(k), dir=None if k == 2 else 90.0, season=2018, yards=4.0, way="left") for p in range(6) for k in range(1, 5)]
    rows = change(rows)
    kinds = "play long, obj long, rusher long, side string, x double, dir double, season long, yards double, way string"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)


def rules(df):
    v = contract.snapshot_contract(df, ["play"], "obj", "rusher", "side", ["home", "away"], ["season", "way"], ["x"], ["dir"], ["yards"], {"season": [2017, 2018], "way": ["left", "right"]}, 4)
    return sorted((r.rule, r.key) for r in v.collect())


def changed(play, only=None, /, **values):
    def change(rows):
        for r in rows:
            if r["play"] == play and only in (None, r["obj"]):
                r.update(values)
        return rows

    return change


@pytest.mark.parametrize(
    ("change", "expect"),
    [
        (lambda rows: rows, []),
        (lambda rows: rows[:-1], [("objects", "5"), ("rows", "5")]),
        (changed(2, 3, obj=4), [("objects", "2")]),
        (changed(2, rusher=9), [("focal", "2"), ("sides", "2")]),
        (changed(2, 2, rusher=2), [("focal", "2")]),
        (changed(1, 2, side="away"), [("sides", "1")]),
        (changed(1, 4, side="bench"), [("side_domain", "1:4")]),
        (changed(3, 1, x=None), [("x_finite", "3:1")]),
        (changed(3, 1, x=float("inf")), [("x_finite", "3:1")]),
        (changed(3, 1, dir=float("nan")), [("dir_finite_if_there", "3:1")]),
        (changed(3, 1, yards=1.5), [("yards_whole", "3:1")]),
        (changed(0, season=2016), [("season_domain", f"0:{k}") for k in range(1, 5)]),
        (changed(0, 2, season=2017), [("season_constant", "0")]),
        (changed(0, 2, way=None), [("way_constant", "0"), ("way_domain", "0:2")]),
    ],
)
def test_each_rule_of_a_snapshot_names_the_play(spark, change, expect):
    assert rules(snapshot(spark, change)) == expect


def test_report_and_error_name_the_first_keys(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(30)], "k long, v long")
    wrong = contract.broken_rows(df, ["k"], {"zero": F.col("v") == 0, "never": F.col("v") > 9, "unknown": F.lit(None).cast("boolean")})
    got = {r.rule: (r.n, r.first) for r in contract.report(wrong, ["zero", "never"]).collect()}
    assert got == {"zero": (6, ["0", "10", "15"]), "never": (0, [])}
    with pytest.raises(contract.ContractError, match=r"zero: 6 \(0, 10, 15\)"):
        contract.enforce(wrong)
    contract.enforce(wrong.where("rule = 'never'"))
    empty = contract.broken_groups(df.limit(0), ["k"], {"many": F.count("*") > 1})
    assert empty.count() == 0 and contract.report(empty, ["many"]).first().n == 0


def test_one_to_one_with_null_keys(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(1,), (3,), (None,), (None,)], "k long")
    assert sorted((r.rule, r.key) for r in contract.not_one_to_one(a, b, ["k"]).collect()) == [("missing_left", "3"), ("missing_right", "2"), ("repeated_left", "1"), ("repeated_right", "null")]


def test_secondary_panel_must_pair(spark):
    p = spark.createDataFrame([(r, "m", 20, 0.5) for r in range(4)], "repeat int, model string, n_train int, loss double")
    full = p.withColumn("what", F.lit("a"))
    assert panel.secondary_effects(p, full, "loss", "what", strict=True).first()["mean"] == 0
    with pytest.raises(contract.ContractError, match="missing_secondary: 1"):
        panel.secondary_effects(p, full.where("repeat > 0"), "loss", "what", strict=True)
    with pytest.raises(contract.ContractError, match="repeated_secondary: 4"):
        panel.secondary_effects(p, full.unionByName(full), "loss", "what", strict=True)


def test_candidates_and_markers(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, 0, 0)], "k long, made int, missed int")
    labels, wrong = cohort.candidate_labels(df, ["k"], F.col("made") == 1, F.col("missed") == 1)
    assert [(r.k, r.label) for r in labels.collect()] == [(1, 1)] and [(r.rule, r.key) for r in wrong.collect()] == [("repeated", "2")]
    m = spark.createDataFrame([(1, 1, "Snap"), (1, 1, "snap"), (2, 1, "snap"), (2, 5, "snap"), (3, 2, None)], "play long, frame int, marker string")
    assert [(r.rule, r.key) for r in frames.marker_violations(m, "play", "frame", "marker", {"snaps": ["snap"]}).collect()] == [("snaps", "2")]


def test_team_names_are_no_features(spark):
    df = spark.createDataFrame([(1, "KC", "home", 3)], "k long, club string, team string, down int")
    assert tokens.without_teams(df).columns == ["k", "down"]


def weeks(folder, numbers, extra=()):
    folder.mkdir(parents=True)
    for n in numbers:
        (folder / f"tracking_week_{n:02d}.csv").write_text(f"play,player_name,x\n{n}1,A,1.5\n{n}2,B,NA\n")
    for name in extra:
        (folder / name).write_text("play,player_name,x\n991,Z,7\n")


def test_weekly_files_without_the_aggregate(spark, tmp_path):
    folder = tmp_path / "nine"
    weeks(folder, range(1, 10), ["tracking_all.csv"])
    assert [w for w, _ in weekly.weekly_files(spark, str(folder), weeks=9)] == list(range(1, 10))
    df = weekly.read_weekly(spark, str(folder), SCHEMA, ["play"], weeks=9)
    assert df.columns == ["play", "x", "week"] and df.count() == 18
    assert sorted((r.week, r.play, r.x) for r in df.where("week > 8").collect() if r.x) == [(9, 91, 1.5)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "player_name" not in plan.partition("ReadSchema")[2]


@pytest.mark.parametrize(("numbers", "extra", "message"), [(range(1, 9), [], "expected 9 weekly files, found 8"), (range(1, 11), [], "found 10"), ([1, 2], ["other_week2.csv"], "several files of week 2"), ([], ["tracking_all.csv"], "no weekly files")])
def test_wrong_weeks_are_an_error_before_a_row_is_read(spark, tmp_path, numbers, extra, message):
    weeks(tmp_path / "w", numbers, extra)
    with pytest.raises(ValueError, match=message):
        weekly.weekly_files(spark, str(tmp_path / "w"), weeks=None if "several" in message or "no weekly" in message else 9)


def test_files_with_other_columns_mix_and_only_first_lines_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("play,x\n1,2.5\n")
    (tmp_path / "b.csv").write_text("x,play,more\n3.5,2,z\n")
    (tmp_path / "c.csv").write_text("")
    got = tables.read_csv(spark, [str(tmp_path / f"{n}.csv") for n in "abc"], SCHEMA, ["play"])
    assert sorted(map(tuple, got.collect())) == [(1, 2.5), (2, 3.5)]
    with pytest.raises(ValueError, match="missing columns: y"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, ["y"])


def test_a_week_is_replaced_and_the_others_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select((F.col("id") % 4 + 1).cast("int").alias("week"), F.col("id").alias("play"), (F.col("id") / 2).alias("x"))
    weekly.write_bounded(df, path, ["week"], ["play"], 60, rows_per_task=100)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    before = files()
    got = weekly.files_of(spark.read.parquet(path), ["week"]).collect()
    assert all(r.rows == 250 and r.most <= 60 and r.files <= 8 for r in got)
    weekly.write_bounded(df.where("week = 2").limit(10), path, ["week"], ["play"], 60)
    after = files()
    assert {f for f in before if "week=2" not in str(f)} == {f for f in after if "week=2" not in str(f)} and all(after[f] == t for f, t in before.items() if f in after)
    assert spark.read.parquet(path).where("week = 2").count() == 10
    scan = spark.read.parquet(path).where("week = 3")
    assert "PartitionFilters: [isnotnull(week" in scan._jdf.queryExecution().executedPlan().toString() and len(scan.inputFiles()) >= 1


def test_draws_are_written_once_for_all(spark, tmp_path):
    path = str(tmp_path / "draws")
    first = weekly.written_once(spark.range(5).select(F.rand().alias("u")), path).collect()
    assert weekly.written_once(spark.range(5).select(F.rand().alias("u")), path).collect() == first


def test_products_of_both_forms(spark, tmp_path):
    products = {"a": spark.range(3), "b": spark.range(0)}
    for form in ("csv", "parquet"):
        tables.write_products(products, str(tmp_path / form), form)
        assert spark.read.option("header", True).format(form).load(str(tmp_path / form / "a")).count() == 3


def test_registry_is_the_same_for_all_models(spark):
    rows = spark.createDataFrame([(1, m, g, 10 * g + k, k) for m in ("a", "b") for g in range(12) for k in range(3)], "repeat int, model string, game long, row long, y int")
    registry = conformal.calibration_registry(rows, ["repeat"], "game", "row", 3)
    assert registry.count() == 12 and registry.select("game").distinct().count() == 12
    mismatches = lambda r: [(x.model, x.missing, x.beside, x.first) for x in conformal.registry_mismatches(r, registry, ["repeat"], ["model"], "game", "row").collect()]
    assert mismatches(rows) == []
    assert mismatches(rows.where("model = 'a' or game not in (4, 5)")) == [("b", 2, 0, 4)]
    extra = spark.createDataFrame([(1, "a", 77, 770, 0)], rows.schema)
    assert mismatches(rows.unionByName(extra)) == [("a", 0, 1, 77)]


def test_frames_without_a_ball_and_tackles_without_a_carrier(spark):
    rows = [(1, 1, 7, "football", 1.0), (1, 1, 8, "red", 1.0), (1, 2, 8, "red", 1.0), (1, 3, 7, "football", None), (2, 1, 7, "FOOTBALL", 1.0), (2, 1, 9, "football", 2.0), (2, 1, 9, "red", 2.0)]
    df = spark.createDataFrame(rows, "play long, frame long, obj long, team string, x double").withColumn("y", F.col("x"))
    got = sorted((r.rule, r.key) for r in tokens.frame_violations(df, ["play", "frame"], "obj", F.col("team")).collect())
    assert got == [("no_ball", "1:2"), ("no_ball", "1:3"), ("object_repeated", "2:1"), ("several_balls", "2:1")]
    with pytest.raises(ValueError, match="carrier"):
        tokens.active_tokens(df, ["play", "frame"], "tackle")

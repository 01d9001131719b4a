"""Fits over many cells against plain numpy versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from fieldlens.operators import encode, fits, models, trees


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for c, n in (("a", 240), ("b", 150), (None, 90)):
        for i in range(n):
            x = [round(rng.gauss(0, 1), 3), round(rng.gauss(0, 1), 1)]
            rows.append((c, *x, int(x[0] + rng.gauss(0, 1) > 0) + int(x[1] > 0.8), round(x[0] ** 2 + x[1] + rng.gauss(0, 0.1), 4), i % 5))
    rows += [("one", 1.0, 2.0, 1, 3.0, 0), ("one", None, 2.0, 0, 3.0, 1), ("one", float("nan"), 2.0, 0, 3.0, 1), ("none", 1.0, None, 1, 1.0, 0)]
    df = spark.createDataFrame(rows, "cell string, u double, v double, y int, z double, f int").repartition(5).cache()
    return rows, df


def usable(rows, cell):
    own = [r for r in rows if r[0] == cell and None not in r[1:3] and not any(math.isnan(v) for v in r[1:3])]
    return np.array([r[1:3] for r in own]), np.array([r[3] for r in own]), np.array([r[4] for r in own]), np.array([r[5] for r in own])


def optimum(x, t, penalty):
    """Gradient of the objective at the given coefficients."""
    x1 = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.array([0] + [penalty] * x.shape[1])
    return lambda beta: x1.T @ (1 / (1 + np.exp(-np.clip(x1 @ beta, -500, 500))) - t) / len(x) + w * beta


def test_logistic_models_are_at_their_optimum(spark, table):
    rows, df = table
    got = fits.logistic_fits(df, ["cell"], ["u", "v"], "y", [0, 1, 2, 7], [0.01, 1.0], "f", [0, 1, 2, 3, 4]).collect()
    assert {r.cell for r in got} == {"a", "b", "one"}  # a null key joins nothing
    assert len(got) == 3 * 4 * 2 * 6
    for r in got:
        x, y, _, f = usable(rows, r.cell)
        keep = np.ones(len(y), bool) if r.fold is None else f != r.fold
        t = (y[keep] == r.label).astype(float)
        assert r.n == keep.sum() and r.converged
        if t.sum() in (0, len(t)):
            assert r.constant and abs(1 / (1 + math.exp(-r.beta[0])) - (t.sum() + 0.5) / (len(t) + 1)) < 1e-12 and r.beta[1:] == [0, 0]
        else:
            assert np.abs(optimum(x[keep], t, r.penalty)(np.array(r.beta))).max() < 1e-7


def test_separable_labels_and_far_values_converge(spark):
    rows = [(float(k), int(k > 50)) for k in range(100)] + [(1e4, 1), (-1e4, 0)]
    df = spark.createDataFrame(rows, "x double, y int")
    (r,) = fits.logistic_fits(df, [], ["x"], "y", [1], [1e-4], steps=60).collect()
    assert r.converged and np.abs(optimum(np.array([[a] for a, _ in rows]), np.array([b for _, b in rows]), 1e-4)(np.array(r.beta))).max() < 1e-6


def test_probabilities_and_held_out_losses(spark, table):
    rows, df = table
    labels, penalties, folds = [0, 1, 2], [1.0, 0.01], [0, 1, 2, 3, 4]
    all_fits = fits.logistic_fits(df, ["cell"], ["u", "v"], "y", labels, penalties, "f", folds)
    losses = fits.logistic_losses(df, ["cell"], ["u", "v"], "y", labels, penalties, "f", folds)
    got = {(r.cell, r.candidate, r.fold): (r.loss, r.n) for r in losses.collect()}
    held = defaultdict(list)
    for i, penalty in enumerate(penalties):
        for f in folds:
            own = all_fits.where((all_fits.penalty == penalty) & (all_fits.fold == f))
            for r in fits.class_probabilities(df.where(df.f == f).dropna(), own, ["cell"], ["u", "v"]).where("not isnan(u)").collect():
                assert abs(sum(r.pmf) - 1) < 1e-12
                held[r.cell, i, f].append(-math.log(max(r.pmf[r.y], 1e-12)))
    assert set(got) == set(held)
    assert all(abs(got[k][0] - np.mean(v)) < 1e-9 and got[k][1] == len(v) for k, v in held.items())
    chosen = {r.cell: r.candidate for r in models.choose(losses, 5, ["cell"]).where("chosen").collect()}
    mean = lambda c, i: np.mean([got[c, i, f][0] for f in folds])
    assert chosen == {c: min((0, 1), key=lambda i: (mean(c, i), i)) for c in ("a", "b")}


def test_ridge_losses_are_those_of_separate_fits(spark, table):
    rows, df = table
    got = {(r.cell, r.candidate, r.fold): r.loss for r in fits.ridge_losses(df.where("not isnan(u)"), ["cell"], ["u", "v"], "z", [0.1, 10.0], "f").collect()}
    for c in ("a", "b", None):
        x, _, z, f = usable(rows, c)
        x1 = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        for i, penalty in enumerate((0.1, 10.0)):
            for k in range(5):
                a = x1[f != k]
                beta = np.linalg.solve(a.T @ a + penalty * np.diag([0, 1, 1]), a.T @ z[f != k])
                assert abs(got[c, i, k] - ((z[f == k] - x1[f == k] @ beta) ** 2).mean()) < 1e-8
    assert len(got) == 30


def plain_boosting(x, y, edges, d):
    """Trees by trying every split of every node on its own rows."""
    share = (y.sum() + 0.5) / (len(y) + 1) if y.min() == y.max() else y.mean()
    score = np.full(len(y), math.log(share / (1 - share)) if d.binary else y.mean())
    soft = lambda g: math.copysign(max(abs(g) - d.l1, 0), g)

    def leaf_value(rows, g, h):
        down = h[rows].sum() + d.l2
        return -soft(g[rows].sum()) / down * d.rate if down > 0 else 0.0

    def grow(rows, level, g, h, out):
        gain = lambda r: soft(g[r].sum()) ** 2 / (h[r].sum() + d.l2)
        best = None
        if level < d.depth:
            for k in range(x.shape[1]):
                for e in edges[k]:
                    left, right = rows[x[rows, k] <= e], rows[x[rows, k] > e]
                    if min(len(left), len(right)) >= d.least_rows:
                        value = gain(left) + gain(right) - gain(rows)
                        if value > 1e-12 and (best is None or value > best[0] + 1e-9):
                            best = (value, left, right)
        if best is None:
            out[rows] = leaf_value(rows, g, h)
        else:
            grow(best[1], level + 1, g, h, out)
            grow(best[2], level + 1, g, h, out)

    for _ in range(d.trees):
        p = 1 / (1 + np.exp(-score)) if d.binary else score
        out = np.zeros(len(y))
        grow(np.arange(len(y)), 0, p - y, p * (1 - p) if d.binary else np.ones(len(y)), out)
        score = score + out
    return 1 / (1 + np.exp(-score)) if d.binary else score


@pytest.mark.parametrize("binary", [True, False])
def test_boosted_trees_are_those_of_the_plain_version(spark, table, binary):
    rows, df = table
    df = df.where("cell is not null").withColumn("t", (df.y > 0).cast("int"))
    d = trees.Boosting(2, binary, trees=4, depth=3, rate=0.3, bins=8, least_rows=5, l1=0.2, l2=0.5)
    edges = {r.cell: (r["__e0"], r["__e1"]) for r in trees.bin_edges(df.where("not isnan(u) and v is not null and u is not null"), ["cell"], ["u", "v"], 8).collect()}
    model = trees.boosted_fits(df, ["cell"], ["u", "v"], "t" if binary else "z", d)
    got = defaultdict(list)
    for r in trees.boosted_score(df, model, ["cell"], ["u", "v"], d).collect():
        if r.u is None or math.isnan(r.u) or r.v is None:
            assert r.prediction is None
        else:
            got[r.cell].append((r.u, r.v, round(r.prediction, 9)))
    for c in ("a", "b", "one"):
        x, y, z, _ = usable(rows, c)
        p = plain_boosting(x, (y > 0).astype(float) if binary else z, edges[c], d)
        assert sorted(got[c]) == sorted((u, v, round(k, 9)) for (u, v), k in zip(x.tolist(), p.tolist()))


def test_boosted_thresholds_learn_the_residuals_of_a_distribution(spark):
    """Threshold rows of a row's features, fitted by squared error, give a distribution that follows the feature."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, float(i % 10), min(4, max(0, int((i % 10) / 2 + rng.gauss(0, 0.3))))) for i in range(400)]
    df = spark.createDataFrame(rows, "row long, x double, y int").withColumn("base", F.array(*[F.lit(sum(r[2] <= k for r in rows) / 400) for k in range(5)]))
    long = encode.threshold_rows(df, "row", "base", 5).withColumnRenamed("base", "b").join(df.select("row", "x", "y"), "row")
    long = long.withColumn("residual", (F.col("y") <= F.col("k")).cast("double") - F.col("b"))
    d = trees.Boosting(3, False, trees=6, depth=4, rate=0.5, bins=16, least_rows=5, l2=0.1)
    fit = trees.boosted_fits(long, [], ["x", "t", "b"], "residual", d)
    scored = trees.boosted_score(long.withColumn("one", F.lit(1)), fit.withColumn("one", F.lit(1)), ["one"], ["x", "t", "b"], d)
    pmf = scored.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "prediction"))), lambda s: s["prediction"]).alias("r")).join(df, "row")
    pmf = pmf.select("row", "x", "y", models.residual_pmf(F.concat("r", F.array(F.lit(0.0))), F.col("base")).alias("pmf")).collect()
    assert all(abs(sum(r.pmf) - 1) < 1e-9 and min(r.pmf) >= -1e-12 for r in pmf)
    assert sum(max(range(5), key=lambda k: r.pmf[k]) == r.y for r in pmf) > 280  # half of the labels are ties of two classes


def test_distribution_functions_against_known_values(spark):
    from pyspark.sql import functions as F

    from fieldlens.functions import scalars as fn

    exact = {(0.975, 1): 12.706204736174698, (0.975, 2): 4.302652729749462, (0.975, 10): 2.2281388519862735, (0.95, 19): 1.7291328115213698, (0.975, 100): 1.983971518523552}
    rows = [(p, n) for p, n in exact] + [(0.025, 10), (0.5, 3), (0.3, 301), (0.0, 4), (1.0, 4), (0.4, 0)]
    df = spark.createDataFrame(rows, "p double, n int").withColumn("q", fn.t_quantiles(F.col("p"), F.col("n"))).withColumn("back", fn.t_cdf(F.col("q"), F.col("n")))
    got = {(r.p, r.n): r for r in df.collect()}
    assert all(abs(got[k].q - v) < 1e-9 and abs(fn.t_critical(2 * k[0] - 1, k[1]) - v) < 1e-9 for k, v in exact.items())
    assert abs(got[0.025, 10].q + exact[0.975, 10]) < 1e-9 and got[0.5, 3].q == 0
    assert all(got[k].q is None for k in [(0.0, 4), (1.0, 4), (0.4, 0)])
    assert all(abs(r.back - r.p) < 1e-10 for r in got.values() if r.q is not None)
    z = [-8.0, -3.3, -2.0, -0.1, 0.0, 1.999, 2.0, 2.001, 4.5, 7.0]
    for r in spark.createDataFrame([(v,) for v in z], "z double").withColumn("p", fn.normal_cdf(F.col("z"))).withColumn("back", fn.normal_quantiles(F.col("p"))).collect():
        assert abs(r.p / (0.5 * math.erfc(-r.z / math.sqrt(2))) - 1) < 1e-12
        assert r.z > 4 or abs(r.back - r.z) < 1e-9


def test_framewise_scoring_is_ridge_and_the_automaton(spark):
    from pyspark.sql import functions as F

    from fieldlens.plans import pipelines

    rng = random.Random(6)
    rows = []
    for k in range(12):
        level = 0.0
        for f in range(60):
            level = 0.8 * level + rng.gauss(0, 1)
            if rng.random() > 0.05:
                rows.append((k, f, level, rng.gauss(0, 1), level + rng.gauss(0, 0.2)))
    df = spark.createDataFrame(rows, "k long, f long, a double, b double, y double").repartition(4)
    got = pipelines.framewise_scoring(df, F.col("k") % 3 > 0, ["k"], "f", ["a", "b"], "y", 2.0, 0.3, 3).collect()
    train = np.array([[1, a, b] for k, _, a, b, _ in rows if k % 3])
    beta = np.linalg.solve(train.T @ train + 2.0 * np.diag([0, 1, 1]), train.T @ np.array([y for k, *_, y in rows if k % 3]))
    for r in got:
        opened, kind, length, last, opens, misses = False, None, 0, None, [], []
        for f, a, b in sorted((f, a, b) for k, f, a, b, _ in rows if k == r.k):
            high = float(np.array([1, a, b]) @ beta) > 0.3
            if last is not None and f != last + 1:
                opened, kind, length = False, None, 0
            length = length + 1 if high == kind else 1
            kind, last = high, f
            if length == 3 and high != opened:
                opened = high
                (opens if high else misses).append(f)
        text = lambda v: ",".join(map(str, v))
        assert (r.opportunities, r.misses, r.open_frames, r.miss_frames) == (len(opens), len(misses), text(opens), text(misses))
    assert len(got) == 12 and sum(r.opportunities for r in got) > 10

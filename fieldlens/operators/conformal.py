"""Conformal intervals, sets and tubes, and the calibration of probabilities.

Cells are groups of rows (``by``); calibration scores of a cell meet its test rows either as one order statistic
(a number) or, for local weighting and isotonic fits, as reduced arrays.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.sources.steps import written

#: Ranges of scores in a cell at most, and the distinct scores from which there are several.
RANGES, RANGE_SCORES = 256, 4096
#: Calibration rows, and test points, in a block of local_padding().
PADDING_BLOCK = 512
#: Sums of weights, one for each point of a block and score, that a task of local_padding() holds before it passes them on.
PADDING_HELD = 1 << 21


def central_interval(pmf: Column, alpha: float) -> tuple[Column, Column]:
    """First index whose cdf reaches alpha / 2, and 1 - alpha / 2 (CAL-1)."""
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0).alias("k"), none.alias("lo"), none.alias("hi"))

    def step(a: Column, p: Column) -> Column:
        cdf = a["cdf"] + p
        at = lambda name, level: F.coalesce(a[name], F.when(cdf >= level - 1e-12, a["k"])).alias(name)
        return F.struct(cdf.alias("cdf"), (a["k"] + 1).alias("k"), at("lo", alpha / 2), at("hi", 1 - alpha / 2))

    found = F.aggregate(pmf, start, step)
    missing = F.lit(-1)
    return F.coalesce(found["lo"], missing), F.coalesce(found["hi"], missing)


def interval_score(lo: Column, hi: Column, y: Column) -> Column:
    """How far y lies outside [lo, hi] (CAL-2)."""
    return F.greatest(lo - y, y - hi, F.lit(0))


def conformal_rank(n: Column, alpha: float) -> Column:
    return F.ceil((n + 1) * (1 - alpha) - 1e-9)


def split_quantile(scores: DataFrame, by: list[str], score: str, alpha: float, fallback: float | None) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score by cell; beyond n the ``fallback``, or the largest score where
    that is None (CAL-3, SRT-4). ``n_cal, rank, quantile``."""
    counts = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("__c"))  # ties are counted before they are ranked
    run = Window.partitionBy(*by).orderBy(score)
    ranked = counts.withColumn("__upto", F.sum("__c").over(run)).withColumn("n_cal", F.sum("__c").over(Window.partitionBy(*by)))
    ranked = ranked.withColumn("rank", conformal_rank(F.col("n_cal"), alpha))
    agg = (ranked.groupBy(*by) if by else ranked).agg(
        F.max("n_cal").alias("n_cal"), F.max("rank").alias("rank"), F.min(F.when(F.col("__upto") >= F.col("rank"), F.col(score))).alias("q"), F.max(score).alias("largest")
    )
    other = F.col("largest") if fallback is None else F.lit(fallback)
    return agg.select(*by, "n_cal", "rank", F.coalesce(F.col("q").cast("double"), other.cast("double")).alias("quantile"))


def one_per_game(df: DataFrame, by: list[str], game: str, row: str, seed: int) -> DataFrame:
    """One row per game, at the index that a hash of seed and game gives in row order (WIN-18)."""
    w = Window.partitionBy(*by, game)
    n = F.count("*").over(w)
    pick = fn.sha_number(F.concat(F.lit(f"rows|{seed}|"), F.col(game).cast("string")), n)
    return df.withColumn("__i", F.row_number().over(w.orderBy(row)) - 1).withColumn("__k", pick).where("__i = __k").drop("__i", "__k")


def smallest_digest(df: DataFrame, by: list[str], game: str, row: str, seed: int) -> DataFrame:
    """One row per game, that of the smallest digest, ties to the smaller row id (WIN-19)."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, game, row]]).cast("binary"), 256)
    w = Window.partitionBy(*by, game).orderBy(digest, row)
    return df.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def clustered_intervals(calibration: DataFrame, test: DataFrame, by: list[str], game: str, row: str, lo: str, hi: str, y: str, classes: int, alpha: float, seed: int) -> DataFrame:
    """Test rows with ``lower, upper, width, hit``: central intervals padded by the split-conformal quantile of one
    calibration row per game, clipped to the support (CAL-5, CAL-6, CAL-12)."""
    drawn = one_per_game(calibration, by, game, row, seed).withColumn("__s", interval_score(F.col(lo), F.col(hi), F.col(y)))
    q = split_quantile(drawn, by, "__s", alpha, float(classes)).select(*by, "quantile")
    both = test.join(q, by) if by else test.crossJoin(F.broadcast(q))  # one number
    lower, upper = F.greatest(F.lit(0), F.col(lo) - F.ceil("quantile")), F.least(F.lit(classes - 1), F.col(hi) + F.ceil("quantile"))
    out = both.withColumn("lower", lower.cast("long")).withColumn("upper", upper.cast("long"))
    return out.withColumn("width", F.col("upper") - F.col("lower")).withColumn("hit", F.col(y).between(F.col("lower"), F.col("upper")))


def calibration_registry(rows: DataFrame, repeat: list[str], game: str, row: str, seed: int) -> DataFrame:
    """One calibration row for each repeat and game, whatever the model: that of the smallest digest among the rows of any model (CAL-6, WIN-19).
    Write it once (sources.weekly.written_once) and let every cell of the repeat join it."""
    return smallest_digest(rows.select(*repeat, game, row).distinct(), repeat, game, row, seed)


def registry_mismatches(rows: DataFrame, registry: DataFrame, repeat: list[str], model: list[str], game: str, row: str) -> DataFrame:
    """Cells that don't have exactly the registry's games and rows, and so can't be paired: ``repeat, model, missing, beside, first`` (games that
    the cell lacks, or lacks the registered row of; games that the registry lacks; the least of either)."""
    cells = rows.select(*repeat, *model).distinct()
    wanted = cells.join(registry.select(*repeat, game, row), repeat)
    on = [*repeat, *model, game]
    lacking = wanted.join(rows.select(*on, row).distinct(), [*on, row], "left_anti").select(*on, F.lit(1).alias("missing"), F.lit(0).alias("beside"))
    beside = rows.select(*on).distinct().join(registry.select(*repeat, game), [*repeat, game], "left_anti").select(*on, F.lit(0).alias("missing"), F.lit(1).alias("beside"))
    return lacking.unionByName(beside).groupBy(*repeat, *model).agg(F.sum("missing").alias("missing"), F.sum("beside").alias("beside"), F.min(game).alias("first"))


def registered_intervals(
    calibration: DataFrame, test: DataFrame, registry: DataFrame, repeat: list[str], model: list[str], game: str, row: str, lo: str, hi: str, y: str, classes: int, alpha: float
) -> DataFrame:
    """Test rows with ``lower, upper, width, hit, fallback``: central intervals of every cell padded by the split-conformal quantile of the registry's rows,
    which are the same for all models of a repeat (CAL-6). ``fallback``: there are too few games for the quantile, so the whole support stands."""
    by = [*repeat, *model]
    drawn = calibration.join(registry.select(*repeat, game, row), [*repeat, game, row], "left_semi").withColumn("__s", interval_score(F.col(lo), F.col(hi), F.col(y)))
    q = split_quantile(drawn, by, "__s", alpha, float(classes)).select(*by, "quantile", (F.col("rank") > F.col("n_cal")).alias("fallback"))
    out = test.join(q, by)
    lower, upper = F.greatest(F.lit(0), F.col(lo) - F.ceil("quantile")), F.least(F.lit(classes - 1), F.col(hi) + F.ceil("quantile"))
    out = out.withColumn("lower", lower.cast("long")).withColumn("upper", upper.cast("long")).drop("quantile")
    return out.withColumn("width", F.col("upper") - F.col("lower")).withColumn("hit", F.col(y).between(F.col("lower"), F.col("upper")))


def cluster_summary(intervals: DataFrame, repeat: list[str], model: list[str], game: str) -> DataFrame:
    """By model over the repeats: mean, deviation, tenth and ninetieth percentile of a cell's coverage and width, which weigh games equally, and the
    cells that fell back (AGG-20): ``model, metric, cells, mean, sd, p10, p90, fallbacks``."""
    by = [*repeat, *model]
    per_game = intervals.groupBy(*by, game).agg(F.avg(F.col("hit").cast("double")).alias("coverage"), F.avg("width").alias("width"), F.bool_or("fallback").alias("fallback"))
    cell = per_game.groupBy(*by).agg(F.avg("coverage").alias("coverage"), F.avg("width").alias("width"), F.bool_or("fallback").alias("fallback"))
    long = cell.select(*by, "fallback", F.explode(F.create_map(F.lit("coverage"), F.col("coverage"), F.lit("width"), F.col("width"))).alias("metric", "v"))
    quantile = lambda q: F.percentile("v", F.lit(q))
    return long.groupBy(*model, "metric").agg(
        F.count("*").alias("cells"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), quantile(0.1).alias("p10"), quantile(0.9).alias("p90"), F.count_if("fallback").alias("fallbacks")
    )


def label_sets(calibration: DataFrame, test: DataFrame, by: list[str], game: str, row: str, p: str, y: str, alpha: float, seed: int) -> DataFrame:
    """Label-conditional sets of a binary label: ``in0, in1, set_size`` (CAL-7). The score of a label is one minus
    its probability; each label has its own quantile, over one row per game that has the label."""
    score = lambda c, k: (1 - c) if k else c
    drawn = [
        one_per_game(calibration.where(F.col(y) == k), by, game, row, seed + k).select(*by, F.lit(k).alias("__label"), score(F.col(p), k).alias("__s")) for k in (0, 1)
    ]
    q = split_quantile(drawn[0].unionByName(drawn[1]), [*by, "__label"], "__s", alpha, 1.0)
    both = [F.max(F.when(F.col("__label") == k, F.col("quantile"))).alias(f"q{k}") for k in (0, 1)]
    q = (q.groupBy(*by) if by else q).agg(*both)  # one small table for both labels
    out = test.join(q, by, "left") if by else test.crossJoin(F.broadcast(q))  # two numbers
    for k in (0, 1):
        out = out.withColumn(f"in{k}", score(F.col(p), k) <= F.coalesce(F.col(f"q{k}"), F.lit(1.0)) + 1e-12)
    return out.withColumn("set_size", F.col("in0").cast("int") + F.col("in1").cast("int"))


def local_padding(calibration: DataFrame, test: DataFrame, by: list[str], features: list[str], score: str, alpha: float, k: int) -> DataFrame:
    """Test rows with ``padding``: the weighted quantile of a cell's calibration scores, weighted by a Gaussian of the
    scaled feature distance whose bandwidth is the distance of the k-th neighbour (CAL-4, JN-18, FN-19).

    Calibration rows and test points, each counted once, meet in pairs of bounded blocks. A block of points meets the calibration blocks one after the
    other, and what it has of them is merged as they come: the k nearest distances, which make the bandwidth, then weights summed by score. So what leaves
    a task doesn't grow with the number of calibration blocks, and a task holds one pair. Points are known by their scaled features, so the
    scales are written: a deviation that is had again, its parts added in another order, differs in the last bit, and rows would not find their point."""
    scale = written(calibration.groupBy(*by).agg(F.count("*").alias("__n"), *[F.stddev_pop(f).alias(f"s_{f}") for f in features]))
    unit = lambda f: F.when(F.col(f"s_{f}") > 1e-12, F.col(f"s_{f}")).otherwise(1.0)
    x = F.array(*[F.col(f).cast("double") / unit(f) for f in features])
    spent = [f"s_{f}" for f in features]
    cal = calibration.join(scale, by).groupBy(*by, F.col(score).cast("double").alias("v"), x.alias("x")).agg(F.count("*").alias("m"))
    at = test.join(scale, by).withColumn("__x", x).drop(*spent)
    points = at.select(*by, F.col("__x").alias("x")).distinct()

    def blocks(rows: DataFrame, item: list[str]) -> DataFrame:
        parts = rows.groupBy(*by).agg(F.ceil(F.count("*") / PADDING_BLOCK).alias("parts"))
        dealt = rows.join(parts, by).withColumn("part", F.pmod(F.xxhash64(*item), F.col("parts")))
        return dealt.groupBy(*by, "part").agg(F.collect_list(F.struct(*item)).alias("rows"), F.first("parts").alias("parts"))

    there = blocks(cal, ["v", "x", "m"]).withColumnRenamed("rows", "cal")

    def met(rows: DataFrame, item: list[str]) -> DataFrame:
        """Each block of points with each block of the cell's calibration rows; merged by key, so that a block's pairs follow each other."""
        asked = blocks(rows, item).withColumnRenamed("part", "block")
        lanes = asked.groupBy(*by).agg(F.first("parts").alias("lanes"))
        sent = there.drop("part", "parts").join(lanes, by).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)))
        return sent.drop("lanes").join(asked.drop("parts").hint("merge"), [*by, "block"]).select(*by, "cal", "rows", "block")

    n_by = len(by)

    def sides(batch: pa.RecordBatch, k: int) -> tuple:
        cal_, rows = batch.column(n_by)[k].values, batch.column(n_by + 1)[k].values
        a, b = (np.asarray(t.field("x").flatten(), np.float64).reshape(len(t), -1) for t in (rows, cal_))
        d2 = np.zeros((len(a), len(b)))
        for f in range(a.shape[1]):
            d2 += (b[None, :, f] - a[:, f, None]) ** 2
        return rows, cal_, d2

    def table(batch: pa.RecordBatch, k: int, rows: pa.Array, of: np.ndarray, more: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        own = [batch.column(c).take(pa.array(np.full(len(of), k))) for c in range(n_by)]
        return pa.RecordBatch.from_arrays([*own, rows.field("x").take(pa.array(of)), *[y if isinstance(y, pa.Array) else pa.array(y) for y in more]], [*by, "x", *names])

    def pairs(batches):
        """(batch, row in it, whether the pair before was of the same block of points)."""
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                key = [batch.column(c)[i].as_py() for c in (*range(n_by), n_by + 2)]
                yield batch, i, key == last
                last = key

    def nearest(batches):
        held = None

        def done(batch, i, rows, best):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * best.shape[1], pa.int32()), pa.array(best.reshape(-1)))
            return table(batch, i, rows, np.arange(len(best)), [lists], ["d2"])

        for batch, i, same in pairs(batches):
            rows, cal_, d2 = sides(batch, i)
            d2 = np.repeat(d2, np.minimum(np.asarray(cal_.field("m")), k), axis=1)
            if same:
                d2 = np.concatenate([held[-1], d2], axis=1)
            elif held:
                yield done(*held)
            held = batch, i, rows, np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, :k]
        if held:
            yield done(*held)

    def weights(batches):
        held = None

        def done(batch, i, rows, values, sums):
            return table(batch, i, rows, np.repeat(np.arange(sums.shape[1]), len(values)), [np.tile(values, sums.shape[1]), sums.T.reshape(-1)], ["v", "w"])

        for batch, i, same in pairs(batches):
            rows, cal_, d2 = sides(batch, i)
            w = np.exp(-d2 / (2 * np.asarray(rows.field("band"))[:, None])) * np.asarray(cal_.field("m"))
            own = np.asarray(cal_.field("v"))
            before = held[3] if same else np.zeros(0)
            values = np.union1d(before, own)
            if held and (not same or len(values) * len(w) > PADDING_HELD):
                yield done(*held)
                before, values = np.zeros(0), np.unique(own)
            sums = np.zeros((len(values), len(w)))
            if len(before):
                sums[np.searchsorted(values, before)] = held[4]
            np.add.at(sums, np.searchsorted(values, own), w.T)
            held = batch, i, rows, values, sums
        if held:
            yield done(*held)

    types = {f.name: f.dataType.simpleString() for f in calibration.schema}
    named = "".join(f"`{c}` {types[c]}, " for c in by) + "x array<double>, "
    near = met(points, ["x"]).mapInArrow(nearest, f"{named}d2 array<double>")
    merged = near.groupBy(*by, "x").agg(F.sort_array(F.flatten(F.collect_list("d2"))).alias("d2"))
    band = merged.select(*by, "x", F.greatest(F.array_max(F.slice("d2", 1, k)), F.lit(1e-12)).alias("band"))
    sums = met(band, ["x", "band"]).mapInArrow(weights, f"{named}v double, w double").groupBy(*by, "x", "v").agg(F.sum("w").alias("w"))
    own = Window.partitionBy(*by, "x")
    level = F.least(F.lit(1.0), (1 - alpha) * (F.col("__n") + 1) / F.col("__n"))
    run = sums.join(scale.select(*by, "__n"), by).withColumn("cum", F.sum("w").over(own.orderBy("v"))).withColumn("total", F.sum("w").over(own))
    reached = F.min(F.when(F.col("cum") >= F.col("total") * level - 1e-12, F.col("v")))
    found = run.groupBy(*by, "x").agg(F.ceil(F.coalesce(reached, F.max("v"))).alias("padding")).withColumnRenamed("x", "__x")
    return at.drop("__n").join(found, [*by, "__x"]).drop("__x")


def isotonic(points: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted isotonic fit of y on x by pooling adjacent violators (CAL-10, CAL-11, ML-5). Points are first grouped by x; a cell's groups become one array."""
    g = points.groupBy(*by, x).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(y)).alias("wy"))
    arrays = g.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), "w", "wy"))).alias("p"))
    fit = fn.pooled(F.col("p"))
    return arrays.select(*by, F.posexplode(F.zip_with("p", fit, lambda p, f: F.struct(p["x"].alias(x), p["w"].alias("weight"), f.alias("fitted")))).alias("i", "r")).select(*by, f"r.{x}", "r.weight", "r.fitted")


def venn_abers(calibration: DataFrame, test: DataFrame, by: list[str], p: str, y: str, precision: int | None = None) -> DataFrame:
    """Test rows with ``p0, p1, point, imprecision`` (CAL-8): p1 is the isotonic fit at the row's score once the
    row is appended with label 1, p0 with 0; point = p1 / (1 - p0 + p1). Scores are taken as they are, or rounded to
    ``precision`` digits.

    The fit at a score is the slope at which the lower hulls of the running counts on both sides of it meet. Counts
    are summed by cell and score first; ranges of scores give their hulls, those of a cell are merged to what lies on
    either side of each range, and within a range only its own scores are walked."""
    score = (F.col(p) if precision is None else F.round(p, precision)).cast("double").alias("__t")
    bins = calibration.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("s"))
    marks = test.withColumn("__t", score)
    both = bins.withColumn("asked", F.lit(0)).unionByName(marks.select(*by, "__t").distinct().select(*by, "__t", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(1).alias("asked")))
    levels = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    stride = F.greatest(F.floor(F.lit(RANGES * RANGE_SCORES) / F.count("*")), F.lit(1))
    cuts = bins.groupBy(*by).agg(F.array_distinct(F.percentile_approx("__t", levels, 10_000)).alias("cuts"), stride.alias("stride"))
    at = both.groupBy(*by, "__t").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("asked").alias("asked")).join(cuts, by)
    below = F.size(F.filter("cuts", lambda x: x < F.col("__t")))
    at = at.withColumn("__g", F.floor(below / F.col("stride")).cast("int")).drop("cuts", "stride")
    types = {f.name: f.dataType.simpleString() for f in at.schema}
    named = "".join(f"`{c}` {types[c]}, " for c in by)

    def push(points: list, slopes: list, x: int, z: int, sign: int) -> list:
        """Add a point to a lower hull walked to the right (sign 1) or the left (-1); the points that it removes."""
        gone = []
        while len(points) > 1 and sign * ((z - points[-1][1]) * (points[-1][0] - points[-2][0]) - (points[-1][1] - points[-2][1]) * (x - points[-1][0])) <= 0:
            gone.append(points.pop())
            slopes.pop()
        if points:
            slopes.append(sign * (z - points[-1][1]) / (x - points[-1][0]))
        points.append((x, z))
        return gone

    def key(t: pa.Table, rows: int) -> list:
        return [pa.chunked_array([pa.repeat(t.column(c)[0], rows)]) for c in by]

    def hull(t: pa.Table) -> pa.Table:
        t = t.sort_by("__t")
        points, slopes, x, z = [(0, 0)], [], 0, 0
        for n, v in zip(t.column("n").to_pylist(), t.column("s").to_pylist(), strict=True):
            if n:
                x, z = x + n, z + v
                push(points, slopes, x, z, 1)
        return pa.Table.from_arrays([*key(t, 1), pa.array([t.column("__g")[0].as_py()], pa.int32()), pa.array([[a for a, _ in points]], pa.list_(pa.int64())), pa.array([[b for _, b in points]], pa.list_(pa.int64()))], [*by, "__g", "hn", "hs"])

    def sides(t: pa.Table) -> pa.Table:
        t = t.sort_by("__g")
        hulls = {g: list(zip(a, b, strict=True)) for g, a, b in zip(*[t.column(c).to_pylist() for c in ("__g", "hn", "hs")], strict=True)}
        groups, start, x, z = range(max(hulls) + 2), {}, 0, 0
        left, slopes, lefts, rights = [(0, 0)], [], {}, {}
        for g in groups:
            start[g], lefts[g] = (x, z), list(left)
            for a, b in hulls.get(g, [])[1:]:
                push(left, slopes, x + a, z + b, 1)
            if g in hulls:
                x, z = x + hulls[g][-1][0], z + hulls[g][-1][1]
        right, slopes = [(x, z)], []
        for g in reversed(groups):
            rights[g] = list(right)
            for a, b in hulls.get(g, [])[-2::-1]:
                push(right, slopes, start[g][0] + a, start[g][1] + b, -1)
        columns = [pa.array([[q[i] for q in side[g]] for g in groups], pa.list_(pa.int64())) for side in (lefts, rights) for i in (0, 1)]
        return pa.Table.from_arrays([*key(t, len(groups)), pa.array(list(groups), pa.int32()), *columns], [*by, "__g", "ln", "ls", "rn", "rs"])

    def meet(left: list, up: list, right: list, down: list, label: int) -> float:
        lo, hi, v, last = -1.0, 2.0, 0.5, None
        for _ in range(200):
            a, b = left[bisect.bisect_left(up, v)], right[bisect.bisect_right(down, -v)]
            if (a, b) == last:
                break
            last, rise, run = (a, b), b[1] + label - a[1], b[0] + 1 - a[0]
            lo, hi = (v, hi) if rise > v * run else (lo, v)
            v = rise / run if lo <= rise / run <= hi else (lo + hi) / 2
        return v

    def walk(t: pa.Table, around: pa.Table) -> pa.Table:
        if not t.num_rows or not around.num_rows:
            return pa.Table.from_arrays([*[t.column(c).slice(0, 0) for c in by], *[pa.array([], pa.float64())] * 3], [*by, "__t", "p0", "p1"])
        t = t.sort_by("__t")
        n, s, asked, at_ = (t.column(c).to_pylist() for c in ("n", "s", "asked", "__t"))
        left, right = (list(zip(around.column(a)[0].as_py(), around.column(b)[0].as_py(), strict=True)) for a, b in (("ln", "ls"), ("rn", "rs")))
        up = [(d - b) / (c - a) for (a, b), (c, d) in itertools.pairwise(left)]
        down = [-(d - b) / (c - a) for (a, b), (c, d) in itertools.pairwise(right)]
        x, z = right[-1]
        removed = []
        for k in reversed(range(len(n))):
            if n[k]:
                x, z = x - n[k], z - s[k]
                removed.append(push(right, down, x, z, -1))
        out = []
        for k in range(len(n)):
            if n[k]:
                right.pop()
                if down:
                    down.pop()
                for a, b in reversed(removed.pop()):
                    if right:
                        down.append(-(b - right[-1][1]) / (a - right[-1][0]))
                    right.append((a, b))
            if asked[k]:
                out.append((at_[k], meet(left, up, right, down, 0), meet(left, up, right, down, 1)))
            if n[k]:
                x, z = x + n[k], z + s[k]
                push(left, up, x, z, 1)
        return pa.Table.from_arrays([*key(t, len(out)), *[pa.array([r[i] for r in out], pa.float64()) for i in range(3)]], [*by, "__t", "p0", "p1"])

    place = [*by, "__g"]
    hulls = at.where("n > 0").groupBy(*place).applyInArrow(hull, f"{named}__g int, hn array<long>, hs array<long>")
    around = hulls.groupBy(*by).applyInArrow(sides, f"{named}__g int, ln array<long>, ls array<long>, rn array<long>, rs array<long>")
    fitted = at.groupBy(*place).cogroup(around.groupBy(*place)).applyInArrow(walk, f"{named}__t double, p0 double, p1 double")
    out = marks.join(fitted, [*by, "__t"]).drop("__t")
    return out.withColumn("point", F.col("p1") / (1 - F.col("p0") + F.col("p1"))).withColumn("imprecision", F.col("p1") - F.col("p0"))


def path_tube(
    calibration: DataFrame, test: DataFrame, scale: DataFrame, example: str, game: str, horizon: str, radial: str, alpha: float, seed: int, by: list[str] | None = None
) -> DataFrame:
    """Test paths with ``covered, diameter``: the score of a path is its largest radial error over the horizon's scale,
    over one calibration path per game, by cell where ``by`` names one (CAL-9)."""
    by = by or []
    score = lambda df: df.join(scale, horizon).groupBy(*by, example, game).agg(F.max(F.col(radial) / F.col("scale")).alias("score"), F.avg("scale").alias("__m"))
    drawn = one_per_game(score(calibration), by, game, example, seed)
    q = split_quantile(drawn, by, "score", alpha, 1e6).select(*by, "quantile")
    both = score(test).join(q, by) if by else score(test).crossJoin(F.broadcast(q))  # one number
    return both.select(*by, example, game, "score", (F.col("score") <= F.col("quantile") + 1e-12).alias("covered"), (2 * F.col("quantile") * F.col("__m")).alias("diameter"))


def horizon_scale(medians: DataFrame, horizon: str, median: str, count: str, floor: float = 0.25) -> DataFrame:
    """Scale by horizon: the count-weighted lower median of fold medians, at least ``floor``, made monotone (CAL-10)."""
    pairs = F.collect_list(F.struct(F.col(median).cast("double").alias("value"), F.col(count).cast("double").alias("weight")))
    raw = medians.groupBy(horizon).agg(pairs.alias("v"), F.sum(count).cast("double").alias("w"))
    raw = raw.select(F.lit(1).alias("__all"), horizon, F.greatest(fn.weighted_quantile(F.col("v"), F.lit(0.5)), F.lit(floor)).alias("raw"), "w")
    return isotonic(raw, ["__all"], horizon, "raw", "w").select(horizon, F.col("fitted").alias("scale"))

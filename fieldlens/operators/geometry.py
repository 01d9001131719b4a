"""Tracking geometry and frame-local features over long tables: one row per (play, frame, object)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn


def rotate_left(x: Column, y: Column, left: Column, length: float = 120.0, width: float = 160 / 3) -> tuple[Column, Column]:
    """Half-turn of plays that run left (GEO-1)."""
    return F.when(left, length - x).otherwise(x), F.when(left, width - y).otherwise(y)


def reflect_left(x: Column, angle: Column, speed: Column, left: Column, length: float = 120.0) -> dict[str, Column]:
    """Reflection along x only: x, mathematical direction in degrees, and velocity components (GEO-2)."""
    d = F.pmod(90.0 - angle, F.lit(360.0))
    d = F.when(left, F.pmod(180.0 - d, F.lit(360.0))).otherwise(d)
    return {"x": F.when(left, length - x).otherwise(x), "dir": d, "vx": speed * F.cos(F.radians(d)), "vy": speed * F.sin(F.radians(d))}


def quantize(value: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimals (GEO-3)."""
    return F.rint(value * 10**digits) / 10**digits


def centred(rows: DataFrame, frame_keys: list[str], anchor: Column, x: str, y: str) -> DataFrame:
    """Adds ``x_rel, y_rel`` to the frame's anchor object (ball, focal player); null where a frame has none (GEO-6,
    GEO-9, GEO-16, JN-11)."""
    w = Window.partitionBy(*frame_keys)
    ax, ay = (F.min(F.when(anchor, F.col(c))).over(w) for c in (x, y))
    return rows.withColumn("x_rel", F.col(x) - ax).withColumn("y_rel", F.col(y) - ay)


def inferred_focal(rows: DataFrame, frame_keys: list[str], candidate: Column, obj: str) -> DataFrame:
    """Adds ``focal``: the smallest id among a frame's candidates (GEO-7)."""
    return rows.withColumn("focal", F.min(F.when(candidate, F.col(obj))).over(Window.partitionBy(*frame_keys)))


def constant_velocity(last: DataFrame, keys: list[str], horizon: int, hz: float, x: str, y: str, vx: str, vy: str) -> DataFrame:
    """Baseline path: position plus t / hz times velocity for t = 1..horizon (GEO-10)."""
    t = last.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return t.select(*keys, "t", (F.col(x) + F.col("t") / hz * F.col(vx)).alias("px"), (F.col(y) + F.col("t") / hz * F.col(vy)).alias("py"))


def mirrored(rows: DataFrame, sample: DataFrame, key: str, y: str, angle: str, width: float = 160 / 3) -> DataFrame:
    """``rows`` plus mirrored copies of the sampled keys, with ``_aug`` on their key (GEO-14)."""
    copy = rows.join(sample.select(key).distinct(), key, "left_semi")
    copy = copy.withColumn(key, F.concat(F.col(key).cast("string"), F.lit("_aug"))).withColumn(y, width - F.col(y)).withColumn(angle, 2 * math.pi - F.col(angle))
    return rows.withColumn(key, F.col(key).cast("string")).unionByName(copy)


def pairs(rows: DataFrame, frame_keys: list[str], obj: str, left: Column, right: Column, columns: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of different objects within a frame, one from either role, with differences ``d_<column>`` and
    the distance in the first two columns; columns to ``carry`` come as ``a_<column>`` of the first object (JN-12, GEO-15). A frame's objects, a few dozen, meet in one row: one shuffle, no
    self-join. Frames with a null key have no pairs."""
    item = F.struct(F.col(obj).alias("o"), *columns, *carry)
    known = rows.dropna(subset=frame_keys)
    held = known.groupBy(*frame_keys).agg(F.collect_list(F.when(left, item)).alias("__l"), F.collect_list(F.when(right, item)).alias("__r"))
    both = held.where((F.size("__l") > 0) & (F.size("__r") > 0)).withColumn("__a", F.explode("__l")).withColumn("__b", F.explode("__r"))
    both = both.select(*frame_keys, F.col("__a.o").alias("a"), F.col("__b.o").alias("b"), *[(F.col(f"__a.{c}") - F.col(f"__b.{c}")).alias(f"d_{c}") for c in columns], *[F.col(f"__a.{c}").alias(f"a_{c}") for c in carry])
    return both.where("a <> b").withColumn("distance", F.sqrt(F.col(f"d_{columns[0]}") ** 2 + F.col(f"d_{columns[1]}") ** 2))


def pair_grid_summary(pairs_: DataFrame, play: str, columns: list[str]) -> DataFrame:
    """min, mean, max and population deviation of every pair column by play (AGG-14)."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max), ("sd", F.stddev_pop))]
    return pairs_.groupBy(play).agg(*aggs)


def token_summary(rows: DataFrame, play: str, time: str, roles: dict[str, Column], channels: list[str]) -> DataFrame:
    """Per play: at the last frame count, mean, sd, min and max of every channel by role; over all frames mean and
    sd of every channel (FEAT-1)."""
    last = F.max(time).over(Window.partitionBy(play))
    r = rows.withColumn("__last", F.col(time) == last)
    aggs = []
    for role, rule in roles.items():
        here = F.col("__last") & rule
        aggs.append(F.count_if(here).alias(f"{role}_count"))
        for c in channels:
            v = F.when(here, F.col(c))
            aggs += [F.avg(v).alias(f"{role}_{c}_mean"), F.stddev_pop(v).alias(f"{role}_{c}_sd"), F.min(v).alias(f"{role}_{c}_min"), F.max(v).alias(f"{role}_{c}_max")]
    for c in channels:
        aggs += [F.avg(c).alias(f"all_{c}_mean"), F.stddev_pop(c).alias(f"all_{c}_sd")]
    return r.groupBy(play).agg(*aggs)


def relational_summary(pairs_: DataFrame, play: str, time: str) -> DataFrame:
    """Cross-side distances: at the last frame min, mean and sd; over frames the mean of minima, their change from first
    to last, and the mean of means (FEAT-2)."""
    per = pairs_.groupBy(play, time).agg(F.min("distance").alias("lo"), F.avg("distance").alias("mid"), F.stddev_pop("distance").alias("sd"))
    last = F.max_by(F.struct("lo", "mid", "sd"), time)
    return per.groupBy(play).agg(
        last["lo"].alias("last_min"), last["mid"].alias("last_mean"), last["sd"].alias("last_sd"), F.avg("lo").alias("mean_of_min"),
        (F.max_by("lo", time) - F.min_by("lo", time)).alias("change_of_min"), F.avg("mid").alias("mean_of_mean"),
    )


def slot_columns(rows: DataFrame, play: str, slot: str, slots: int, channels: list[str]) -> DataFrame:
    """One column for each slot and channel (FEAT-3)."""
    cells = [F.max(F.when(F.col(slot) == s, F.col(c))).alias(f"s{s}_{c}") for s in range(slots) for c in channels]
    return rows.groupBy(play).agg(*cells)


def edge_types(pairs_: DataFrame, rules: list[tuple[str, Column]], default: str = "other") -> DataFrame:
    """Adds ``edge``: of the rules that hold the last one names the edge (FEAT-6, FEAT-7)."""
    out = F.lit(default)
    for name, rule in rules:
        out = F.when(rule, F.lit(name)).otherwise(out)
    return pairs_.withColumn("edge", out)


def raster(rows: DataFrame, keys: list[str], x: str, y: str, flags: dict[str, Column], means: list[str], bins: tuple[int, int], cell: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Sparse raster: by occupied cell the sum of each flag and the mean of each channel (FEAT-8)."""
    at = lambda c, o, n: F.least(F.greatest(F.floor((F.col(c) - o) / cell), F.lit(0)), F.lit(n - 1)).cast("int")
    r = rows.withColumn("xbin", at(x, origin[0], bins[0])).withColumn("ybin", at(y, origin[1], bins[1]))
    return r.groupBy(*keys, "xbin", "ybin").agg(F.count("*").alias("occupancy"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.avg(m).alias(f"mean_{m}") for m in means])


def influence(dx: Column, dy: Column, speed: Column, heading: Column, radius: float = 3.0, top_speed: float = 18.0) -> Column:
    """Density of a player's Gaussian influence at offset (dx, dy) from the player (FEAT-11). Deviations are
    (radius +- radius * speed / top_speed) / 2 along and across the heading (radians); the mean lies half a second ahead.
    In the heading's own axes the inverse of the covariance is closed."""
    ratio = speed / top_speed
    along, across = radius * (1 + ratio) / 2, radius * (1 - ratio) / 2
    cx, cy = dx - 0.5 * speed * F.cos(heading), dy - 0.5 * speed * F.sin(heading)
    u, v = cx * F.cos(heading) + cy * F.sin(heading), cy * F.cos(heading) - cx * F.sin(heading)
    return F.exp(-0.5 * ((u / along) ** 2 + (v / across) ** 2)) / (2 * math.pi * along * across)


def _clipped_areas(x: np.ndarray, y: np.ndarray, n: np.ndarray, sx: np.ndarray, sy: np.ndarray, box: tuple[float, float]) -> np.ndarray:
    """cell_area() of a batch of rows, of which row i has the next ``n[i]`` of the sites (sx, sy): all rows' polygons are clipped by their k-th
    bisector at once, for k = 0, 1, ... A site with a missing coordinate leaves nothing of the cell."""
    first, rows = np.cumsum(n) - n, len(x)
    px, py, size = np.tile(np.array([0.0, box[0], box[0], 0.0]), (rows, 1)), np.tile(np.array([0.0, 0.0, box[1], box[1]]), (rows, 1)), np.full(rows, 4)
    for k in range(int(n.max(initial=0))):
        live = np.flatnonzero((n > k) & (size > 0))
        if not len(live):
            break
        ox, oy, tx, ty, m = x[live], y[live], sx[first[live] + k], sy[first[live] + k], size[live][:, None]
        a, b, c = (tx - ox)[:, None], (ty - oy)[:, None], ((tx * tx - ox * ox + ty * ty - oy * oy) / 2)[:, None]
        at = np.arange(int(m.max()))
        p, q, there, following = px[live, : len(at)], py[live, : len(at)], at < m, np.where(at + 1 < m, at + 1, 0)
        f = a * p + b * q - c  # at most 0 on the near side
        g, near = np.take_along_axis(f, following, 1), f <= 0
        cross = there & (((f < 0) & ~(g <= 0)) | (~near & (g < 0)))
        t = np.divide(f, f - g, out=np.zeros_like(f), where=cross)
        both = np.stack([near & there, cross], axis=2).reshape(len(live), -1)  # a vertex, then the crossing behind it
        to, count = np.cumsum(both, axis=1) - 1, both.sum(axis=1)
        width = int(count.max())
        if width > px.shape[1]:
            px, py = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (px, py))
        i, j = np.nonzero(both)
        for all_, v in ((px, p), (py, q)):
            ends = np.stack([v, v + t * (np.take_along_axis(v, following, 1) - v)], axis=2).reshape(len(live), -1)
            all_[live[i], to[i, j]] = ends[i, j]
        size[live] = count
    total = np.zeros(rows)
    for k in range(px.shape[1]):
        after = np.where(k + 1 < size, min(k + 1, px.shape[1] - 1), 0)
        term = px[:, k] * py[np.arange(rows), after] - px[np.arange(rows), after] * py[:, k]
        total = total + np.where(k < size, term, 0.0)
    return np.abs(total) / 2


def cell_area(x: Column, y: Column, sites: Column, box: tuple[float, float] = (120.0, 53.0)) -> Column:
    """Area of the part of the box that is nearer to (x, y) than to any of ``sites`` (array<struct<x, y>>) (FEAT-12); null where ``sites`` is.

    The box, as a polygon, is clipped by one perpendicular bisector after the other; then the shoelace formula. A task takes Arrow batches of rows.
    """
    number = lambda v: pc.fill_null(v.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)

    @F.arrow_udf("double")
    def areas(x: pa.Array, y: pa.Array, sites: pa.Array) -> pa.Array:
        n, each = pc.fill_null(pc.list_value_length(sites), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(sites)
        with np.errstate(all="ignore"):
            out = _clipped_areas(number(x), number(y), n, number(pc.struct_field(each, "x")), number(pc.struct_field(each, "y")), box)
        return pa.array(out, pa.float64(), mask=pc.is_null(sites).to_numpy(zero_copy_only=False))

    return areas(x, y, sites)


def carrier_area(x: Column, y: Column, others: Column, trail: float = 10.0, box: tuple[float, float] = (120.0, 53.0)) -> Column:
    """cell_area() of a carrier among ``others``, all clipped to the box, and a virtual site ``trail`` behind it; a
    virtual site off the field also acts through its mirror image on it."""
    inside = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(top))
    cx, cy = inside(x, box[0]), inside(y, box[1])
    sites = F.transform(others, lambda s: F.struct(inside(s["x"], box[0]).alias("x"), inside(s["y"], box[1]).alias("y")))
    virtual = F.array(F.struct((cx - trail).alias("x"), cy.alias("y")))
    mirror = F.when(cx < trail, F.array(F.struct((trail - cx).alias("x"), cy.alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return cell_area(cx, cy, F.concat(sites, virtual, mirror), box)

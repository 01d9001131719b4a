"""Gradient-boosted trees of many cells in one job, from histograms.

Features become bins at quantiles of their cell. A pass over the cells' blocks of rows adds up gradients, curvatures and rows by (node, feature,
bin) for all cells at once, and the best split of each node follows from those sums: one shuffle for each level of each tree, whatever
the number of cells. After a tree its leaves are added to the rows' scores, and the blocks are written anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.fits import SPREAD, _arrow, _block, _cells, _joined, _schema, _told, block_rows, blocks, stepped
from fieldlens.sources.steps import released, written


@dataclass(frozen=True)
class Boosting:
    """What is fitted. ``binary``: log loss of labels 0 and 1, else squared error. Splits leave ``least_rows`` rows on both sides; gains and
    leaves have the penalties l1 (on the sum of gradients) and l2 (on the curvature).

    A cell's state is a line of doubles: start, finished trees, level; the bins' upper edges by feature; then for each tree the nodes' features
    (-1: not split, all rows go left), the last bin on the left, and the leaves.
    """

    features: int
    binary: bool = True
    trees: int = 10
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    least_rows: int = 20
    l1: float = 0.0
    l2: float = 1.0

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1

    @property
    def tree_size(self) -> int:
        return 2 * self.inner + (1 << self.depth)

    def edges(self, state: np.ndarray) -> np.ndarray:
        return state[3 : 3 + self.features * (self.bins - 1)].reshape(self.features, -1)

    def tree(self, state: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = 3 + self.features * (self.bins - 1) + k * self.tree_size
        t = state[at : at + self.tree_size]
        return t[: self.inner], t[self.inner : 2 * self.inner], t[2 * self.inner :]

    def node(self, x: np.ndarray, state: np.ndarray, k: int, level: int) -> np.ndarray:
        """Place of each row (of bins) among the nodes of a level of tree k."""
        feature, last, _ = self.tree(state, k)
        place = np.zeros(len(x), np.int64)
        for step in range(level):
            own = (1 << step) - 1 + place
            f = feature[own].astype(np.int64)
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > last[own])
            place = 2 * place + right
        return place

    def binned(self, x: np.ndarray, state: np.ndarray, but: int | None = None) -> np.ndarray:
        """Bins of x, which has all features, or all ``but`` one."""
        edges = [e for k, e in enumerate(self.edges(state)) if k != but]
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)

    def partial(self, rows: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Rows are bins, label, score."""
        p, level = self.features, int(state[2])
        x, y, score = rows[:, :p].astype(np.int64), rows[:, p], rows[:, p + 1]
        chance = 1 / (1 + np.exp(-score)) if self.binary else score
        grad, curve = chance - y, chance * (1 - chance) if self.binary else np.ones(len(y))
        place = self.node(x, state, int(state[1]), level)
        out = np.zeros((p, 3, (1 << level) * self.bins))
        for k in range(p):
            at = place * self.bins + x[:, k]
            for c, weight in enumerate((grad, curve, None)):
                out[k, c] = np.bincount(at, weight, (1 << level) * self.bins)
        return out.reshape(-1)

    def gain(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - self.l1, 0) ** 2 / np.maximum(h + self.l2, 1e-300)

    def leaf(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        down = h + self.l2
        return np.where(down > 0, -np.sign(g) * np.maximum(np.abs(g) - self.l1, 0) / np.where(down > 0, down, 1), 0.0) * self.rate

    def step(self, sums: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The splits of a level; after the last level also the leaves."""
        state, level = state.copy(), int(state[2])
        feature, last, leaves = self.tree(state, int(state[1]))
        g, h, n = np.moveaxis(sums.reshape(self.features, 3, 1 << level, self.bins), 1, 0)
        left = [np.cumsum(v, axis=2) for v in (g, h, n)]
        whole = [v[:, :, -1:] for v in left]
        gains = self.gain(left[0], left[1]) + self.gain(whole[0] - left[0], whole[1] - left[1]) - self.gain(whole[0], whole[1])
        fits = (left[2] >= self.least_rows) & (whole[2] - left[2] >= self.least_rows)
        gains = np.where(fits, gains, -np.inf)
        for node in range(1 << level):
            f, b = np.unravel_index(int(np.argmax(gains[:, node])), (self.features, self.bins))  # ties: first feature, lowest bin
            own = (1 << level) - 1 + node
            split = gains[f, node, b] > 1e-12
            feature[own], last[own] = (f, b) if split else (-1, 0)
            if level == self.depth - 1:
                a, c = (left[k][f, node, b] for k in (0, 1)) if split else (whole[k][0, node, 0] for k in (0, 1))
                rest = [whole[k][f, node, 0] - v for k, v in ((0, a), (1, c))]
                leaves[2 * node], leaves[2 * node + 1] = self.leaf(np.array([a, rest[0]]), np.array([c, rest[1]]))
        state[2] = level + 1
        return state

    def added(self, x: np.ndarray, state: np.ndarray, k: int) -> np.ndarray:
        return self.tree(state, k)[2][self.node(x, state, k, self.depth)]

    def margin(self, raw: np.ndarray, state: np.ndarray) -> np.ndarray:
        x, out = self.binned(raw, state), np.full(len(raw), state[0])
        for k in range(int(state[1])):
            out += self.added(x, state, k)
        return out


@dataclass(frozen=True)
class _Over:
    """A feature that is no column: each row stands for one row for each of its values, with a label (and score) for each."""

    design: Boosting
    place: int
    values: tuple[float, ...]

    @property
    def edges(self) -> list[float]:
        """As bin_edges() has them, where each value has as many rows."""
        v, bins = sorted(self.values), self.design.bins
        return sorted({v[-(-k * len(v) // bins) - 1] for k in range(1, bins)})

    def long(self, rows: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The rows that they stand for: bins of all features, label, score."""
        p, k, at = self.design.features, len(self.values), self.place
        out = np.empty((len(rows), k, p + 2))
        out[:, :, :at], out[:, :, at + 1 : p] = rows[:, None, :at], rows[:, None, at : p - 1]
        out[:, :, at] = np.searchsorted(self.design.edges(state)[at], self.values, "left")
        out[:, :, p], out[:, :, p + 1] = rows[:, p - 1 : p - 1 + k], rows[:, p - 1 + k :]
        return out.reshape(-1, p + 2)


def bin_edges(df: DataFrame, by: list[str], x: list[str], bins: int) -> DataFrame:
    """Upper edges of the bins of each feature in each cell, but the last: its distinct quantiles, by percentile_approx."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    return (df.groupBy(*by) if by else df).agg(*[F.array_distinct(F.percentile_approx(F.col(c).cast("double"), at, F.lit(10_000))).alias(f"__e{k}") for k, c in enumerate(x)])


def boosted_fits(df: DataFrame, by: list[str], x: list[str], y: str | list[str], design: Boosting, over: tuple[str, list[float]] | None = None) -> DataFrame:
    """``by, model`` (the state of design, as doubles): boosted trees of every cell (ML-3).

    ``over`` names a feature of ``x`` that is no column, with the values that it takes; ``y`` then has a column of labels for each of them. A row stands for
    so many rows, which exist only in the passes over a block.

    Trees start from the labels' log odds, or mean. A cell with one label only (binary) has the constant (hits + 0.5) / (n + 1) and no
    splits. Rows with null or non-finite numbers or a null cell take no part; cells without other rows have no model. Missing quantiles
    (fewer distinct values than bins) leave bins empty.
    """
    p, labels = design.features, [y] if isinstance(y, str) else list(y)
    wide = _Over(design, x.index(over[0]), tuple(map(float, over[1]))) if over else None
    if len(labels) != (len(wide.values) if wide else 1):
        raise ValueError("y is one column of labels, or one for each value of over")
    but, x = wide.place if wide else None, [c for c in x if not over or c != over[0]]
    if not x:
        raise ValueError("x has no column")
    usable = df.where(reduce(lambda a, b: a & b, [F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in [*x, *labels]]))
    edges = bin_edges(usable, by, x, design.bins)
    n_by, names = len(by), [*by, "state"]
    size = 3 + design.features * (design.bins - 1) + design.trees * design.tree_size

    def start(batches):
        for batch in batches:
            states = []
            for k in range(batch.num_rows):
                state = np.zeros(size)
                found = [batch.column(n_by + f)[k].as_py() or [] for f in range(len(x))]
                if wide:
                    found.insert(but, wide.edges)
                for own, got in zip(design.edges(state), found):
                    own[:] = np.inf
                    own[: len(got)] = got
                states.append(state.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_by], pa.array(states, pa.binary())], names)

    states = written(edges.mapInArrow(start, _schema(df, by, state="binary")))
    q, k = len(x), len(labels)
    data = written(blocks(usable, by, [*x, *labels], k))
    long = wide.long if wide else lambda rows, _: rows

    def begin(sums, state):
        n, hits = sums
        state = state.copy()
        share = (hits + 0.5) / (n + 1) if hits in (0, n) else hits / n
        state[0] = np.log(share / (1 - share)) if design.binary else hits / n
        return state

    begun = written(stepped(data, states, by, lambda rows, state: np.array([len(rows) * k, rows[:, q:].sum()]), begin))
    released(states)
    states = begun
    rows = written(_rewritten(data, states, by, lambda r, s: np.concatenate([design.binned(r[:, :q], s, but), r[:, q:], np.full((len(r), k), s[0])], axis=1)))
    released(data)
    for tree in range(design.trees):
        for _ in range(design.depth):
            later = written(stepped(rows, states, by, lambda r, s: design.partial(long(r, s), s), design.step))
            released(states)
            states = later

        def grown(r, s, tree=tree):
            r = r.copy()
            r[:, q + k :] += design.added(long(r, s)[:, :p].astype(np.int64), s, tree).reshape(len(r), k)
            return r

        if tree + 1 < design.trees:
            more = written(_rewritten(rows, states, by, grown))
            released(rows)
            rows = more
        done = written(_changed(states, by, tree + 1))
        released(states)
        states = done
    out = written(_told(states, by, {"model": "array<double>"}, lambda state: [(state.tolist(),)]))
    released(rows, states)
    return out


def _changed(states: DataFrame, by: list[str], trees: int) -> DataFrame:
    """The states with so many trees finished, at the first level of the next."""
    n_by = len(by)

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                state = np.frombuffer(batch.column(n_by)[k].as_py(), np.float64).copy()
                state[1:3] = trees, 0
                out.append(state.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_by], pa.array(out, pa.binary())], [*by, "state"])

    return states.select(*by, "state").mapInArrow(run, _schema(states, by, state="binary"))


def _rewritten(data: DataFrame, states: DataFrame, by: list[str], change) -> DataFrame:
    """The blocks' rows as ``change(rows, state)`` makes them, in blocks."""
    joined = data.join(states, by) if by else data.crossJoin(F.broadcast(states))  # one state
    n_by = len(by)

    def run(batches):
        for batch in batches:
            for at, _, rows, state in _joined(batch, n_by):
                rows, keys = change(rows, state), [batch.column(c).slice(at, 1) for c in range(n_by)]
                most = block_rows(rows.shape[1])
                for lo in range(0, len(rows), most):
                    yield _block(keys, rows[lo : lo + most], [*by, "m", "body"])

    return joined.select(*by, "m", "body", "state").mapInArrow(run, _schema(data, by, m="int", body="binary"))


def boosted_score(
    df: DataFrame, fits: DataFrame, by: list[str], x: list[str], design: Boosting, name: str = "prediction", over: tuple[str, list[float]] | None = None
) -> DataFrame:
    """Adds the probability of label 1, or the regression's value; null where a cell has no model or a feature is null or not finite.
    ``over`` names a feature of ``x`` that is no column, with the values that it takes: the prediction is an array with one for each of them, so
    that a row with many thresholds stays one row.

    A cell's model comes before its rows in every task that has some of them, so it isn't copied to each row.
    """
    columns, n_by = df.columns, len(by)
    place, values = (x.index(over[0]), [float(v) for v in over[1]]) if over else (None, [])
    x = [c for k, c in enumerate(x) if k != place]
    here = [F.col(c) for c in columns]
    none = F.array().cast("array<double>")  # not null: with each row, Arrow's writer goes over the nulls at the end of a list column again
    rows = df.select(*here, *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(x)], none.alias("__model"), F.lit(1).alias("__kind"), (F.monotonically_increasing_id() % SPREAD).cast("int").alias("__salt"))
    empty = [F.lit(None).cast(t).alias(c) if c not in by else F.col(c) for c, t in df.dtypes]
    models = fits.select(*empty, *[F.lit(None).cast("double").alias(f"__x{k}") for k in range(len(x))], F.col("model").alias("__model"), F.lit(0).alias("__kind"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__salt"))
    both = rows.unionByName(models).repartition(*by, "__salt").sortWithinPartitions(*by, "__salt", "__kind")
    at, total = [columns.index(c) for c in by], len(columns)

    def run(batches):
        now, model = None, None
        for batch in batches:
            keys = pa.RecordBatch.from_arrays([*[batch.column(k) for k in at], batch.column(total + len(x) + 2)], [*by, "salt"])
            for cell, lo, hi in _cells(keys, n_by + 1):
                part = batch.slice(lo, hi - lo)
                if cell != now:
                    now, model = cell, None
                kind = np.asarray(part.column(total + len(x) + 1))
                if kind[0] == 0:
                    model = np.array(part.column(total + len(x))[0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                value = np.full((part.num_rows, max(len(values), 1)), np.nan)
                raw = np.stack([np.asarray(part.column(total + k).to_pandas(), np.float64) for k in range(len(x))], axis=1) if x else np.zeros((part.num_rows, 0))
                good = np.isfinite(raw).all(1)
                if model is not None and good.any():
                    for k in range(value.shape[1]):
                        full = np.insert(raw[good], place, values[k], axis=1) if over else raw[good]
                        margin = design.margin(full, model)
                        value[good, k] = 1 / (1 + np.exp(-margin)) if design.binary else margin
                if over:
                    ends = pa.array(np.arange(len(value) + 1) * len(values), pa.int32())
                    told = pa.ListArray.from_arrays(ends, pa.array(value.reshape(-1)), mask=pa.array(np.isnan(value).any(1)))
                else:
                    told = pa.array(value[:, 0], mask=np.isnan(value[:, 0]))
                yield pa.RecordBatch.from_arrays([*part.columns[:total], told], [*columns, name])

    return both.mapInArrow(run, _schema(df, columns, **{name: "array<double>" if over else "double"}))

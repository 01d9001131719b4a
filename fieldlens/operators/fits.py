"""Models of many cells in one job: one-vs-rest logistic fits, cross-validated choices, boosted trees.

The rows of a cell are packed into blocks of numbers once. A pass adds up, block by block where the blocks lie, what one step
of every model needs (gradients and curvatures, or histograms), and the step itself is taken from the sums of
a cell. So the number of jobs depends on the steps, not on cells, classes, folds or candidates, and a large cell is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import scalars as fn
from fieldlens.sources.steps import released, written

#: Rows that a step takes at once, and tasks over which a cell's blocks are dealt.
BLOCK_ROWS, SPREAD = 4_096, 64
#: Bytes of a block. Spark's reader of Parquet holds 4,096 rows of a table at once, so 64 MB of blocks; blocks of BLOCK_ROWS rows would be half a gigabyte in each task.
BLOCK_BYTES = 16_384


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _schema(df: DataFrame, by: list[str], **more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {t}" for c, t in [*((c, kinds[c]) for c in by), *more.items()])


def _arrow(df: DataFrame, by: list[str]) -> list[pa.DataType]:
    return list(df.select(*by).limit(0).toArrow().schema.types) if by else []


def _cells(batch: pa.RecordBatch, by: int) -> Iterator[tuple[tuple, int, int]]:
    """(cell, from, to) of the runs of rows with equal first columns."""
    keys = list(zip(*(batch.column(k).to_pylist() for k in range(by)))) if by else [()] * batch.num_rows
    lo = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[lo]:
            yield keys[lo], lo, k
            lo = k


def _joined(batch: pa.RecordBatch, n_by: int) -> Iterator[tuple[int, tuple, np.ndarray, np.ndarray]]:
    """(place in the batch, cell, rows, state) of neighbouring blocks of a cell, up to BLOCK_ROWS rows at a time. Columns are those of the cell, m, body, state."""
    m, body = batch.column(n_by).to_pylist(), batch.column(n_by + 1)
    for cell, lo, hi in _cells(batch, n_by):
        state = np.frombuffer(batch.column(n_by + 2)[lo].as_py(), np.float64)
        while lo < hi:
            end, size = lo + 1, m[lo]
            while end < hi and size + m[end] <= BLOCK_ROWS:
                size += m[end]
                end += 1
            yield lo, cell, np.frombuffer(b"".join(body.slice(lo, end - lo).to_pylist()), np.float64).reshape(size, -1), state
            lo = end


def _block(keys: list[pa.Array], rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys, pa.array([len(rows)], pa.int32()), pa.array([np.ascontiguousarray(rows, np.float64).tobytes()], pa.binary())], names)


def block_rows(numbers: int) -> int:
    return max(1, BLOCK_BYTES // (8 * numbers))


def blocks(df: DataFrame, by: list[str], numbers: list[str], room: int = 0) -> DataFrame:
    """The cell's columns, m, and ``numbers`` of m rows as one binary of doubles, row by row; ``room`` is how many more numbers a row gets later.
    Rows with a null or non-finite number take no part."""
    number = lambda c: F.col(c).cast("double")
    usable = [number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")) for c in numbers]
    rows = df.where(reduce(lambda a, b: a & b, usable))
    rows = rows.select(*by, *[number(c).alias(f"__{k}") for k, c in enumerate(numbers)], (F.monotonically_increasing_id() % SPREAD).alias("__salt"))
    n_by, arrow, names, most = len(by), _arrow(df, by), [*by, "m", "body"], block_rows(len(numbers) + room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def done():
            return _block([pa.array([v], t) for v, t in zip(now, arrow)], np.concatenate(held), names)

        for batch in batches:
            values = np.stack([np.asarray(batch.column(n_by + k), np.float64) for k in range(len(numbers))], axis=1)
            for cell, lo, hi in _cells(batch, n_by):
                if size and cell != now:
                    yield done()
                    held, size = [], 0
                now = cell
                while lo < hi:
                    end = min(hi, lo + most - size)
                    held.append(values[lo:end])
                    size += end - lo
                    lo = end
                    if size == most:
                        yield done()
                        held, size = [], 0
        if size:
            yield done()

    return rows.repartition(*by, "__salt").sortWithinPartitions(*by, "__salt").drop("__salt").mapInArrow(run, _schema(df, by, m="int", body="binary"))


def stepped(data: DataFrame, states: DataFrame, by: list[str], partial: Callable, step: Callable) -> DataFrame:
    """New states of all cells: ``partial(rows, state)`` gives sums of some blocks, which are added within a task, then
    ``step(sums, state)`` the new state; all are flat arrays of doubles."""
    joined = data.join(states, by) if by else data.crossJoin(F.broadcast(states))  # one state
    n_by, arrow, names = len(by), _arrow(data, by), [*by, "sums", "state"]

    def row(cell, sums, state):
        return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(cell, arrow)], pa.array([sums.tobytes()], pa.binary()), pa.array([state.tobytes()], pa.binary())], names)

    def add(batches):
        now, sums, state = None, None, None
        for batch in batches:
            for _, cell, rows, own in _joined(batch, n_by):
                if sums is not None and cell != now:
                    yield row(now, sums, state)
                    sums = None
                now, state = cell, own
                more = partial(rows, state)
                sums = more if sums is None else sums + more
        if sums is not None:
            yield row(now, sums, state)

    def take(key, table):
        total = sum(np.frombuffer(s.as_py(), np.float64) for s in table.column("sums"))
        state = step(total, np.frombuffer(table.column("state")[0].as_py(), np.float64))
        cell = [pa.array([k.as_py()], t) for k, t in zip(key, arrow)]
        return pa.Table.from_arrays([*cell, pa.array([np.ascontiguousarray(state, np.float64).tobytes()], pa.binary())], names=[*by, "state"])

    sums = joined.select(*by, "m", "body", "state").mapInArrow(add, _schema(data, by, sums="binary", state="binary"))
    out = _schema(data, by, state="binary")
    if not by:
        return sums.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(lambda _, table: take((), table), out)
    return sums.groupBy(*by).applyInArrow(take, out)


def _started(data: DataFrame, by: list[str], state: np.ndarray) -> DataFrame:
    cells = data.select(*by).distinct() if by else data.sparkSession.range(1)
    return cells.select(*by, F.lit(bytearray(np.ascontiguousarray(state, np.float64).tobytes())).alias("state"))


def _told(states: DataFrame, by: list[str], fields: dict[str, str], rows: Callable) -> DataFrame:
    """One row for each tuple of ``fields`` (names and types) that ``rows(state)`` gives."""
    n_by, arrow = len(by), _arrow(states, by)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cell = [batch.column(c)[k].as_py() for c in range(n_by)]
                told = rows(np.frombuffer(batch.column(n_by)[k].as_py(), np.float64))
                columns = [pa.array([r[i] for r in told], _ARROW[t]) for i, t in enumerate(fields.values())]
                yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(told), t) for v, t in zip(cell, arrow)], *columns], [*by, *fields])

    return states.select(*by, "state").mapInArrow(run, _schema(states, by, **fields))


# --- logistic models ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Logistic:
    """All models of a cell: one for each label (against the rest), penalty and left-out fold (None: no fold is left out).

    A model's state is whether it is done, the rows it has, the best loss so far, the coefficients of that, and those to try next
    (intercept first).
    """

    features: int
    labels: tuple[float, ...]
    penalties: tuple[float, ...]
    folds: tuple[float, ...] = ()

    @property
    def models(self) -> list[tuple[float, float, float | None]]:
        return list(product(self.labels, self.penalties, [None, *self.folds]))

    def start(self) -> np.ndarray:
        state = np.zeros((len(self.models), 3 + 2 * (self.features + 1)))
        state[:, 2] = np.inf
        return state

    def read(self, state: np.ndarray) -> np.ndarray:
        return state.reshape(len(self.models), -1)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with a leading one, which are of each model's label, and which it learns from."""
        p = self.features
        x = np.concatenate([np.ones((len(rows), 1)), rows[:, :p]], axis=1)
        target = np.stack([rows[:, p] == label for label, _, _ in self.models], axis=1)
        use = np.stack([np.ones(len(rows), bool) if fold is None else rows[:, p + 1] != fold for _, _, fold in self.models], axis=1)
        return x, target, use

    def partial(self, rows: np.ndarray, state: np.ndarray) -> np.ndarray:
        s, q = self.read(state), self.features + 1
        x, target, use = self.masks(rows)
        out = np.zeros((len(s), 3 + q + q * q))
        out[:, 0], out[:, 1] = use.sum(0), (use & target).sum(0)
        for k in np.flatnonzero(s[:, 0] == 0):
            own = x[use[:, k]]
            t = target[use[:, k], k]
            eta = own @ s[k, 3 + q :]
            p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
            out[k, 2] = (np.logaddexp(0, eta) - t * eta).sum()
            out[k, 3 : 3 + q] = own.T @ (p - t)
            out[k, 3 + q :] = (own.T @ (own * (p * (1 - p))[:, None])).reshape(-1)
        return out.reshape(-1)

    def step(self, sums: np.ndarray, state: np.ndarray, tolerance: float) -> np.ndarray:
        s, q = self.read(state).copy(), self.features + 1
        total = sums.reshape(len(s), -1)
        for k, (_, penalty, _) in enumerate(self.models):
            n, hits = total[k, :2]
            if s[k, 0]:
                continue
            s[k, 1] = n
            if hits in (0, n):  # one label only: its smoothed share
                share = (hits + 0.5) / (n + 1)
                s[k, 0], s[k, 2], s[k, 3:] = 2, 0, 0
                s[k, 3] = s[k, 3 + q] = np.log(share / (1 - share))
                continue
            beta, best = s[k, 3 + q :].copy(), s[k, 3 : 3 + q].copy()
            weight = np.full(q, penalty)
            weight[0] = 0
            loss = total[k, 2] / n + 0.5 * (weight * beta * beta).sum()
            if loss > s[k, 2] + 1e-12 * abs(s[k, 2]):  # too far: half the way back
                s[k, 3 + q :] = (beta + best) / 2
                continue
            g = total[k, 3 : 3 + q] / n + weight * beta
            h = total[k, 3 + q :].reshape(q, q) / n + np.diag(weight)
            s[k, 2], s[k, 3 : 3 + q] = loss, beta
            move = np.linalg.lstsq(h, g, rcond=None)[0]
            s[k, 3 + q :] = beta - move
            s[k, 0] = float(np.abs(g).max() < tolerance or np.abs(move).max() < tolerance)
        return s


def logistic_fits(
    df: DataFrame, by: list[str], x: list[str], y: str, labels: list[int], penalties: list[float], fold: str | None = None, folds: list[int] = (), steps: int = 30, tolerance: float = 1e-9
) -> DataFrame:
    """L2 logistic models of every cell, by Newton steps (ML-1): ``by, label, penalty, fold, n, beta`` (intercept first), ``constant, converged``.

    Each label is fitted against the rest: mean log loss plus penalty / 2 times the squares of the slopes. With ``fold``, each is also
    fitted without the rows of each fold (ML-6); ``fold`` is null for the model of all rows. A model that sees one side only is the
    constant (hits + 0.5) / (n + 1). Rows with null or non-finite numbers or a null cell take no part; a cell without other rows has no models.
    """
    design = Logistic(len(x), tuple(map(float, labels)), tuple(map(float, penalties)), tuple(map(float, folds)))
    data = written(blocks(df, by, [*x, y, *([fold] if fold else [])]))
    states = _logistic_states(data, by, design, steps, tolerance)
    q = design.features + 1

    def rows(state: np.ndarray) -> list[tuple]:
        return [(int(k), a, None if f is None else int(f), int(s[1]), s[3 : 3 + q].tolist(), s[0] == 2, s[0] > 0) for (k, a, f), s in zip(design.models, design.read(state))]

    out = written(_told(states, by, {"label": "int", "penalty": "double", "fold": "int", "n": "bigint", "beta": "array<double>", "constant": "boolean", "converged": "boolean"}, rows))
    released(data, states)
    return out


def _logistic_states(data: DataFrame, by: list[str], design: Logistic, steps: int, tolerance: float) -> DataFrame:
    models = len(design.models)
    going = lambda state: [(bool((state.reshape(models, -1)[:, 0] == 0).any()),)]
    states = written(_started(data, by, design.start()))
    for _ in range(steps):
        later = written(stepped(data, states, by, design.partial, lambda sums, state: design.step(sums, state, tolerance)))
        released(states)
        states = later
        if not _told(states, by, {"going": "boolean"}, going).where("going").limit(1).count():
            break
    return states


def class_probabilities(df: DataFrame, fits: DataFrame, by: list[str], x: list[str]) -> DataFrame:
    """Adds ``pmf``: the labels' probabilities in order, which are normalised where there are several, from fits of one penalty and no fold."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("label", "beta"))), lambda m: m["beta"])
    models = (fits.groupBy(*by) if by else fits).agg(ordered.alias("__betas"))
    terms = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in x])
    out = (df.join(models, by) if by else df.crossJoin(F.broadcast(models))).withColumn("__x", terms)  # one row of models
    eta = lambda beta: fn.total(F.zip_with("__x", beta, lambda a, b: a * b))
    raw = F.transform("__betas", lambda beta: 1 / (1 + F.exp(-eta(beta))))
    out = out.withColumn("__raw", raw)
    pmf = F.when(F.size("__raw") > 1, F.transform("__raw", lambda p: p / fn.total(F.col("__raw")))).otherwise(F.col("__raw"))
    return out.select(*df.columns, pmf.alias("pmf"))


def logistic_losses(df: DataFrame, by: list[str], x: list[str], y: str, labels: list[int], penalties: list[float], fold: str, folds: list[int], steps: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """Held-out mean log loss of every candidate penalty and fold (ML-6): ``by, candidate`` (place in ``penalties``)``, fold, loss, n``.

    With one label the probability is that of the label; with several the labels' probabilities are normalised. All models of all folds
    come from one run of logistic_fits().
    """
    design = Logistic(len(x), tuple(map(float, labels)), tuple(map(float, penalties)), tuple(map(float, folds)))
    data = written(blocks(df, by, [*x, y, fold]))
    states = _logistic_states(data, by, design, steps, tolerance)
    p, q, k, a, f = design.features, design.features + 1, len(labels), len(penalties), len(folds)

    def partial(rows: np.ndarray, state: np.ndarray) -> np.ndarray:
        beta = design.read(state)[:, 3 : 3 + q].reshape(k, a, f + 1, q)[:, :, 1:]
        xs, out = np.concatenate([np.ones((len(rows), 1)), rows[:, :p]], axis=1), np.zeros((a, f, 2))
        for j, fold_ in enumerate(design.folds):
            own = rows[:, p + 1] == fold_
            if not own.any():
                continue
            raw = 1 / (1 + np.exp(-np.clip(np.einsum("nq,kaq->kan", xs[own], beta[:, :, j]), -500, 500)))
            hit = np.stack([rows[own, p] == label for label in design.labels])[:, None]
            chance = np.where(hit[0], raw[0], 1 - raw[0]) if k == 1 else (raw * hit).sum(0) / raw.sum(0)
            out[:, j, 0] = -np.log(np.clip(chance, 1e-12, 1)).sum(1)
            out[:, j, 1] = own.sum()
        return out.reshape(-1)

    def rows(state: np.ndarray) -> list[tuple]:
        s = state.reshape(a, f, 2)
        return [(i, int(design.folds[j]), float(s[i, j, 0] / s[i, j, 1]), int(s[i, j, 1])) for i in range(a) for j in range(f) if s[i, j, 1]]

    held = stepped(data, states, by, partial, lambda sums, state: sums)
    out = written(_told(held, by, {"candidate": "int", "fold": "int", "loss": "double", "n": "bigint"}, rows))
    released(data, states)
    return out


# --- ridge models ---------------------------------------------------------------------------------------------------


def ridge_losses(df: DataFrame, by: list[str], x: list[str], y: str, penalties: list[float], fold: str) -> DataFrame:
    """Held-out mean squared error of every candidate penalty and fold (ML-6): ``by, candidate, fold, loss, n``, in one pass over the rows.

    A fold's moments taken from the cell's leave those of the training rows; the held-out error follows from the fold's own
    moments. The intercept isn't penalised. Rows with a null take no part; a cell with one fold has no losses.
    """
    from fieldlens.operators.encode import ridge_moments

    usable = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*x, y, fold]]))
    per = ridge_moments(usable, [*by, fold], [*x, y], y)  # the label as a last feature gives its square
    cell = (per.groupBy(*by) if by else per).agg(F.collect_list(F.struct(F.col(fold).cast("int").alias("fold"), "n", "xtx")).alias("folds"))  # a row a fold
    size, n_by = len(x) + 1, len(by)

    def run(batches):
        for batch in batches:
            told = []
            for k in range(batch.num_rows):
                parts = batch.column(n_by)[k].as_py()
                if len(parts) < 2:
                    continue
                both, n = np.array([np.reshape(m["xtx"], (size + 1, size + 1)) for m in parts]), np.array([m["n"] for m in parts])
                a, b, yy = both[:, :size, :size], both[:, :size, size], both[:, size, size]
                for i, penalty in enumerate(penalties):
                    weight = np.full(size, float(penalty))
                    weight[0] = 0
                    for j, m in enumerate(parts):
                        beta = np.linalg.lstsq(a.sum(0) - a[j] + np.diag(weight), b.sum(0) - b[j], rcond=None)[0]
                        error = yy[j] - 2 * beta @ b[j] + beta @ a[j] @ beta
                        told.append((k, i, m["fold"], max(float(error), 0.0) / int(n[j]), int(n[j])))
            columns = [batch.column(c).take(pa.array([t[0] for t in told], pa.int64())) for c in range(n_by)]
            kinds = ("int", "int", "double", "bigint")
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([t[1 + c] for t in told], _ARROW[kind]) for c, kind in enumerate(kinds)]], [*by, "candidate", "fold", "loss", "n"])

    return cell.mapInArrow(run, _schema(df, by, candidate="int", fold="int", loss="double", n="bigint"))

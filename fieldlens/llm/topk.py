"""Exact top-k inner-product search pruned by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm._spark import small_batches

#: Vectors in a block, queries in one, and vectors of a lane, which one task holds.
BLOCK, QUERY_BLOCK, LANE = 2048, 256, 50_000
#: Segments by resolution, coarse to fine.
RESOLUTIONS = (4, 16)
#: Vectors with a component beyond this are compared in integers of any size.
LARGEST = float(1 << 26)
_BLOCKS = "dim int, wide boolean, ids binary, vectors binary"


def quantised(batch: pa.RecordBatch) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(dimension, wide, ids, values) of the usable vectors of a batch of (id, vector). Values are floor(256 x), of
    wide vectors floor(256 x) / 256 as float64, which is exact."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        finite, raw, flat = np.isfinite(flat), flat, np.floor(flat * 256)
        exact = np.where(np.abs(raw) < 2.0**52, flat / 256, raw)
        large = ~(np.abs(flat) < LARGEST)
    at = np.concatenate([[0], np.cumsum(lengths)])
    usable = (lengths > 0) & np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    wrong = np.concatenate([[0], np.cumsum(~finite)])
    usable &= wrong[at[1:]] == wrong[at[:-1]]
    beyond = np.concatenate([[0], np.cumsum(large)])
    wide = beyond[at[1:]] > beyond[at[:-1]]
    id_ = np.asarray(ids.fill_null(0))
    out = []
    for dim in np.unique(lengths[usable]):
        for kind in (False, True):
            rows = np.flatnonzero(usable & (lengths == dim) & (wide == kind))
            spots = at[rows][:, None] + np.arange(dim)
            if len(rows):
                out.append((int(dim), kind, id_[rows].astype(np.int64), exact[spots] if kind else flat[spots].astype(np.int32)))
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, wide, ids, v in quantised(b):
                for k in range(0, len(ids), size):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([wide]), pa.array([ids[k : k + size].tobytes()]), pa.array([v[k : k + size].tobytes()])], ["dim", "wide", "ids", "vectors"]
                    )

    return rows.mapInArrow(run, _BLOCKS)


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """[rows, 2 * segments]: mean and deviation of each segment times the root of its length. The inner product
    of two such rows bounds that of the vectors from above (as |x - y|^2 >= the sum over segments of
    length * ((mean_x - mean_y)^2 + (deviation_x - deviation_y)^2))."""
    parts = np.array_split(v.astype(np.float64), min(segments, v.shape[1]), axis=1)
    means = [p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    return np.stack(means + [p.std(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)


class Lane:
    """Blocks of candidates with their statistics, which queries pass one after the other."""

    def __init__(self) -> None:
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, cid: np.ndarray, c: np.ndarray) -> None:
        self.blocks.append((cid, c, *[segment_statistics(c, n) for n in RESOLUTIONS]))

    def search(self, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best candidates of each query in the lane, ties to the smaller id. What a query has found in one block is what candidates of the next have to
        reach, first by their bounds."""
        coarse, fine, q64 = segment_statistics(q, RESOLUTIONS[0]), segment_statistics(q, RESOLUTIONS[1]), q.astype(np.int64)
        least = np.full(len(qid), -np.inf)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qid]  # ids, scores

        def take(i: int, cid: np.ndarray, score: np.ndarray) -> None:
            ids, scores = np.concatenate([found[i][0], cid]), np.concatenate([found[i][1], score])
            best = np.lexsort((ids, -scores))[:k]
            found[i] = ids[best], scores[best]
            if len(best) == k:
                least[i] = scores[best[-1]]

        for cid, c, coarse_c, fine_c in self.blocks:
            bound = coarse @ coarse_c.T
            bound += 1e-6 * (1 + np.abs(bound))
            bound[qid[:, None] == cid[None, :]] = -np.inf
            for i in np.flatnonzero((bound >= least[:, None]).any(axis=1)):
                row, seen = bound[i], np.zeros(0, np.int64)
                if least[i] == -np.inf:  # nothing to reach yet: the highest bounds first
                    seen = np.argpartition(-row, min(4 * k, len(row)) - 1)[: 4 * k]
                    seen = seen[row[seen] > -np.inf]
                    take(i, cid[seen], c[seen].astype(np.int64) @ q64[i])
                rest = (row >= least[i]) & (row > -np.inf)
                rest[seen] = False
                rest = np.flatnonzero(rest)
                near = fine_c[rest] @ fine[i]
                rest = rest[near + 1e-6 * (1 + np.abs(near)) >= least[i]]
                if len(rest):
                    take(i, cid[rest], c[rest].astype(np.int64) @ q64[i])
        sizes = [len(f[0]) for f in found]
        return np.repeat(qid, sizes), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def beyond_long(score: int) -> bytes:
    """Bytes in the order of scores: one value for all that fit a long."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\x80\x00"
    size = (abs(score).bit_length() + 7) // 8
    return (0x8000 + size).to_bytes(2) + score.to_bytes(size) if score > 0 else (0x8000 - size).to_bytes(2) + (256**size - 1 + score).to_bytes(size)


def search_wide(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As Lane.search(), in Python's integers; rows of (query, candidate, score)."""
    out = []
    for i in range(len(qid)):
        score, other = c @ q[i], np.flatnonzero(cid != qid[i])
        best = sorted(other, key=lambda j: (-score[j], cid[j]))[:k]  # noqa: B023
        out += [(int(qid[i]), int(cid[j]), int(score[j])) for j in best]
    return out


def _integers(v: bytes, wide: bool, dim: int) -> np.ndarray:
    if not wide:
        return np.frombuffer(v, np.int32).reshape(-1, dim).astype(object)
    return np.array([int(x) * 256 if abs(x) >= 2.0**52 else int(x * 256) for x in np.frombuffer(v).tolist()], object).reshape(-1, dim)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products for each row whose id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``. Components are floor(256 x). Candidates are all rows but those
    with the query's own id; ties go to the smaller id. Candidates are dealt to lanes of LANE vectors, one task each; blocks of queries, which are a stated share of
    the table, pass each lane, where what a query has found so far prunes what follows. A lane returns k rows a query.

    Vectors that are null or empty or hold a null or a non-finite component take no part, nor do rows with a null id. A score that doesn't fit a long ranks exactly and is given as null. Vectors of different lengths are never compared.
    Repeated rows are candidates each on their own; where rows share a query's id, the least usable vector asks. A query without candidates gives no row; an empty table gives
    an empty result. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = rows.where((F.col("id") % every == 0) & (F.size("v") > 0) & fine).groupBy("id").agg(F.min("v").alias("v"))  # of the usable rows of an id
    asked = _blocks(asked, QUERY_BLOCK).select(F.col("dim"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # Each block of queries goes once to each of so many lanes, each block of candidates to one of them.
    n = rows.count()
    lanes = max(1, -(-n // LANE), min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK)))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    there = _blocks(rows, BLOCK).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    there = there.select("dim", "lane", F.lit(0).alias("asks"), "wide", "ids", "vectors")
    asked = asked.select("dim", "lane", F.lit(1).alias("asks"), F.col("q_wide").alias("wide"), F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"))
    work = there.unionByName(asked).repartition("dim", "lane").sortWithinPartitions("dim", "lane", "asks")
    columns = ["query_id", "vec_id", "score", "beyond"]

    def answer(dim: int, wide: bool, ids: bytes, v: bytes, lane: Lane, odd: list[tuple[bool, bytes, bytes]], plain: list[tuple[bool, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if not wide and lane.blocks:
            got = lane.search(np.frombuffer(ids, np.int64), np.frombuffer(v, np.int32).reshape(-1, dim), k)
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in got], pa.array([b"\x80\x00"] * len(got[0]), pa.binary())], columns)
        for other_wide, other_ids, other in [*odd, *(plain if wide else [])]:
            rows = search_wide(np.frombuffer(ids, np.int64), _integers(v, wide, dim), np.frombuffer(other_ids, np.int64), _integers(other, other_wide, dim), k)
            keys = [beyond_long(r[2]) for r in rows]
            scores = pa.array([r[2] if key == b"\x80\x00" else None for r, key in zip(rows, keys, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], scores, pa.array(keys, pa.binary())], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lane, odd, plain = None, Lane(), [], []
        for b in batches:
            for i in range(b.num_rows):
                dim, number, asks, wide, ids, v = (c[i].as_py() for c in b.columns)
                if (dim, number) != now:
                    now, lane, odd, plain = (dim, number), Lane(), [], []
                if asks:
                    yield from answer(dim, wide, ids, v, lane, odd, plain)
                elif wide:
                    odd.append((wide, ids, v))
                else:
                    lane.add(np.frombuffer(ids, np.int64), np.frombuffer(v, np.int32).reshape(-1, dim))
                    plain.append((wide, ids, v))

    found = work.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

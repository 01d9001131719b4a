"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm import _text as tx
from fieldlens.llm._spark import cut, discard, held_out, may_be_in, small_batches

#: Bytes of a word's first part that form a term of their own beside the whole word.
STEMS = (4, 5)
#: Terms that a model holds at most: by strength of association, and by frequency (these can interact).
STRONG, FREQUENT = 4096, 2048
#: Documents a term must occur in.
LEAST_DOCS = 3
FACTORS = 8


@dataclass
class Model:
    """Sorted term hashes, their weights, their factors, and the intercept."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability for each document, whose distinct known terms are index[at[i]:at[i + 1]]."""
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, self.factors, self.bias, index, at)[0], -30, 30)))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _forward(weights, factors, bias, index, at):
    n = np.maximum(np.diff(at), 1)[:, None]
    v = factors[index]
    s = _sums(v, at)
    # The pairwise part is a mean over terms, so that long documents don't drown in it.
    pairs = 0.5 * ((s**2 - _sums(v**2, at)) / n).sum(axis=1)
    return bias + _sums(weights[index][:, None], at)[:, 0] + pairs, v, s, n


def train(index: np.ndarray, at: np.ndarray, y: np.ndarray, terms: np.ndarray, linear: np.ndarray, epochs: int = 30, seed: int = 5) -> Model:
    """Logistic loss, AdaGrad over mini-batches of 256 documents. Terms outside ``linear`` have no weight of their
    own and only act in pairs: they are frequent, and thousands of small weights would outvote a few strong ones."""
    rng = np.random.Generator(np.random.Philox(seed))
    size = len(terms)
    w, v, bias = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), 0.0
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 256):
            rows = order[k : k + 256]
            count = at[rows + 1] - at[rows]
            local = np.concatenate([[0], np.cumsum(count)])
            idx = index[np.repeat(at[rows] - local[:-1], count) + np.arange(local[-1])]
            z, vi, s, n = _forward(w, v, bias, idx, local)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(g, count)
            dw = (np.bincount(idx, each, size) + 1e-6 * w) * linear
            scaled = each[:, None] * (np.repeat(s, count, axis=0) - vi) / np.repeat(n, count, axis=0)
            dv = np.stack([np.bincount(idx, scaled[:, f], size) for f in range(FACTORS)], axis=1) + 1e-6 * v
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= 0.2 * dw / np.sqrt(gw)
            v -= 0.02 * dv / np.sqrt(gv)
            bias -= 0.2 * g.sum() / np.sqrt(gb)
    return Model(terms, w, v, bias)


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Term hashes of runs of texts with the number of the text they belong to."""
    for first, last, data, offsets in tx.slices(texts):
        starts, ends, at = tx.spans(data, offsets, tx.NOT_ALNUM)
        sums = tx.prefix(data, lower=True)
        of = np.repeat(np.arange(last - first), np.diff(at))
        out, docs = [tx.span_hash(sums, starts, ends)], [of]
        for n in STEMS:
            long = np.flatnonzero(ends - starts > n)
            out.append(tx.span_hash(sums, starts[long], starts[long] + n) ^ tx._PLACE[50 + n])
            docs.append(of[long])
        yield first, last, np.concatenate(out), np.concatenate(docs)


def _distinct(terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, docs))
    terms, docs = terms[order], docs[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
    return terms[new], docs[new]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, docs, toxic) by run of documents: partial sums before the shuffle."""
    for b in batches:
        toxic = np.asarray(b.column(1))
        for first, _, terms, docs in _terms(b.column(0)):
            terms, docs = _distinct(terms, docs)
            unique, which = np.unique(terms, return_inverse=True)
            bad = np.bincount(which, toxic[docs + first], len(unique)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(np.bincount(which, minlength=len(unique))), pa.array(bad)], ["term", "docs", "toxic"])


def _known(texts: pa.Array, terms: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, indexes into ``terms``, offsets by document) of each run's distinct known terms."""
    for first, last, found, docs in _terms(texts):
        maybe = np.flatnonzero(tx.in_bitmap(bitmap, found))
        found, docs = found[maybe], docs[maybe]
        place = np.minimum(np.searchsorted(terms, found), max(len(terms) - 1, 0))
        sure = terms[place] == found if len(terms) else np.zeros(len(found), bool)
        index, docs = _distinct(place[sure], docs[sure])
        yield first, last, index, np.searchsorted(docs, np.arange(last - first + 1))


def _bitmap_of(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, np.uint64)
    spot = terms >> np.uint64(42)
    np.bitwise_or.at(out, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 40_000) -> Model | float:
    """Fit on labelled documents outside the held-out fifth, at most about ``max_train_rows`` of them, chosen
    by a hash of doc_id. Where a label of one kind is missing, the result is the constant (bad + 0.5) / (n + 1).

    Terms are counted by Spark over the sample; the STRONG terms with the largest z-score between toxic and
    other documents and the FREQUENT most frequent ones form the model. Only the sample's indexes into those
    terms reach the driver.
    """
    small_batches(docs.sparkSession)
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    y = y.where(~held_out("label_id"))
    n = y.count()
    y = y.where(F.pmod(F.xxhash64("label_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_train_rows / max(n, 1))))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    y = cut(y, "labels")
    text = may_be_in(text, F.col("doc_id"), y, "label_id")
    sample = cut(text.join(y, F.col("doc_id") == F.col("label_id")).select("text", "toxic"), "labelled")
    total, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if bad == 0 or bad == total:
        return (bad + 0.5) / (total + 1)
    counts = sample.mapInArrow(_term_counts, "term long, docs long, toxic long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    rate = bad / total
    counts = counts.where(F.col("docs") >= LEAST_DOCS).withColumn("z", F.abs(F.col("toxic") - F.col("docs") * rate) / F.sqrt(F.col("docs") * (rate * (1 - rate))))
    counts = cut(counts, "terms")
    strong = counts.where("z >= 4").orderBy(F.desc("z"), "term").limit(STRONG).withColumn("own", F.lit(True))
    frequent = counts.where("z < 4").orderBy(F.desc("docs"), "term").limit(FREQUENT).withColumn("own", F.lit(False))
    chosen = strong.union(frequent).select("term", "own").collect()
    terms = np.array([r.term for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(terms)
    terms, linear = terms[order], np.array([r.own for r in chosen], bool)[order]
    bitmap = _bitmap_of(terms)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, index, at in _known(b.column(0), terms, bitmap):
                lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(index.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, b.column(1).slice(first, last - first)], ["known", "toxic"])

    table = sample.mapInArrow(indexed, "known array<int>, toxic long").toArrow()
    discard(y, sample, counts)
    known = table.column("known").combine_chunks()
    at = np.concatenate([[0], np.cumsum(np.asarray(known.value_lengths()))])
    return train(np.asarray(known.flatten(), dtype=np.int64), at, np.asarray(table.column("toxic"), dtype=np.float64), terms, linear)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``docs`` plus ``__score`` (0 to 1) from the text alone; null text counts as empty."""
    small_batches(docs.sparkSession)
    if isinstance(model, float):
        return docs.withColumn("__score", F.lit(model))
    bitmap = _bitmap_of(model.terms)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for first, last, index, at in _known(b.column(at_text), model.terms, bitmap):
                out[first:last] = model.score(index, at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "__score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 40_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    score is a factorization machine's probability that ``labels.toxic`` is 1: an intercept, a weight for every
    known term and, for every pair of terms in the document, the product of their factors (divided by the
    number of terms), so a pair can count where neither term does alone. Terms are hashed words and word
    beginnings of 4 and 5 bytes. Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0
    (held_out is false there); the score reads nothing but the text.

    Null or empty texts get the score of no term. A null doc_id counts as the empty text in the remainder.
    Repeated rows get equal scores; of several labels of one doc_id the largest counts, null labels don't. With
    labels of one kind only the score is constant. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, fit(docs, labels, max_train_rows))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train_rows: int = 40_000) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns are kept."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text").cast("string").alias("text"))
    scored = score(plain, fit(docs, labels, max_train_rows)).where("__score < 0.5")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

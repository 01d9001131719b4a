"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import _text as tx
from fieldlens.llm._spark import held_out, small_batches

#: Components of a vector; symbols: 0 for anything between words, 1 to 26 for a to z, the rest for other letters.
WIDTH, SYMBOLS = 512, 40
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Symbol of every code point of the basic plane; code points beyond it share one entry per 64."""
    out = np.zeros(0x10000, np.int64)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()[0]
            out[i] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
    return out


@lru_cache(maxsize=1)
def gram_vectors() -> np.ndarray:
    """[SYMBOLS**3, WIDTH] of +-1: random letter vectors, permuted (rotated) by their place and bound (multiplied)."""
    letters = np.random.Generator(np.random.Philox(99)).choice(np.array([-1, 1], np.int8), (SYMBOLS, WIDTH))
    one, two = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    return (two[:, None, None, :] * one[None, :, None, :] * letters[None, None, :, :]).reshape(-1, WIDTH)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    lead, b, c, d = wide[at], wide[at + 1] & 63, wide[at + 2] & 63, wide[at + 3] & 63
    out = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | b, np.where(lead < 0xF0, (lead & 15) << 12 | b << 6 | c, (lead & 7) << 18 | b << 12 | c << 6 | d)))
    return out, at


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers, the text of each, and whether each text has a letter. Between words there is one gap symbol."""
    n = len(offsets) - 1
    points, at = _code_points(data)
    table = _symbol_table()
    symbol = table[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        c = chr(min(points[i], 0x10FFFF))
        symbol[i] = 27 + points[i] % (SYMBOLS - 27) if c.isalpha() else 0
    first = np.searchsorted(at, offsets)
    symbol = np.insert(symbol, first[1:], 0)
    of = np.repeat(np.arange(n), np.diff(first) + 1)
    letters = np.bincount(of[symbol > 0], minlength=n) > 0
    keep = symbol > 0
    keep[1:] |= (symbol[:-1] > 0) & (of[1:] == of[:-1])
    symbol, of = symbol[keep], of[keep]
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    gram = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
    inside = of[:-2] == of[2:]
    return gram[inside], of[:-2][inside], letters


def bundles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, [texts, WIDTH] sums of gram vectors, has a letter), run by run."""
    for first, last, data, offsets in tx.slices(texts):
        gram, of, letters = _grams(data, offsets)
        used, column = np.unique(gram, return_inverse=True) if len(gram) < 1000 else _dense_unique(gram)
        vectors = gram_vectors()[used].astype(np.float32)
        out = np.empty((last - first, WIDTH), np.float32)
        rows = max(1, 4_000_000 // max(len(used), 1))
        at = np.searchsorted(of, np.arange(last - first + 1))
        for k in range(0, last - first, rows):
            m = min(rows, last - first - k)
            part = slice(at[k], at[k + m])
            counts = np.bincount((of[part] - k) * len(used) + column[part], minlength=m * len(used)).reshape(m, len(used))
            out[k : k + m] = counts.astype(np.float32) @ vectors
        yield first, last, out, letters


def _dense_unique(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(SYMBOLS**3, bool)
    seen[gram] = True
    used = np.flatnonzero(seen)
    place = np.zeros(SYMBOLS**3, np.int64)
    place[used] = np.arange(len(used))
    return used, place[gram]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, sum of the unit bundles) of all a task has read: one row for each language."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(1).to_pylist()
        for first, last, v, letters in bundles(b.column(0)):
            unit = _unit(v)
            for i in np.flatnonzero(letters):
                lang = langs[first + i]
                sums[lang] = sums.get(lang, 0) + unit[i].astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([[float(x) for x in s] for s in sums.values()], pa.list_(pa.float64()))], ["lang", "total"]
        )


def fit(docs: DataFrame, max_train_rows: int = 20_000) -> dict[str, np.ndarray]:
    """Prototype of every language: the bundle of the unit profiles of its documents, over at most about
    ``max_train_rows`` documents outside the held-out fifth, chosen by a hash of doc_id. What reaches the driver
    is one vector for each language and task."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out())
    share = min(1.0, max_train_rows / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * share))
    parts = rows.select("text", "lang").mapInArrow(_profiles, "lang string, total array<double>")
    flat = parts.select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = flat.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("total")).collect()
    return {r.lang: _unit(np.array(r.total)) for r in sorted(found, key=lambda r: r.lang)}


def detect_language(docs: DataFrame, max_train_rows: int = 20_000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    A text's profile is the sum of the vectors of its letter trigrams (lower case; one gap symbol between
    words): three random +-1 letter vectors of WIDTH components, rotated by their place, multiplied. The prediction
    is the language whose prototype has the largest cosine with it, score that cosine (0 where negative). Languages
    are learned from the ``lang`` of rows whose crc32(doc_id as text) mod 5 is not 0; the prediction reads only the text.

    Null, empty and letterless texts: ``und`` with score 0, as are all where nothing could be learned. Texts with
    letters but fewer than two of them in any word have one trigram at least through the gap or, failing
    that, score 0 and the first language. A null doc_id counts as the empty text in the remainder, a null lang
    teaches nothing. Ties go to the language first by code point. Repeated rows get equal results; an empty
    table gives an empty result.
    """
    prototypes = fit(docs, max_train_rows)
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64) if names else np.zeros((0, WIDTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, v, letters in bundles(b.column(1)):
                if not names:
                    letters = np.zeros(last - first, bool)
                cosine = _unit(v.astype(np.float64)) @ matrix.T if names else np.zeros((last - first, 1))
                best = cosine.argmax(axis=1)
                pred = [names[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                value = np.where(letters, np.clip(cosine.max(axis=1), 0, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(pred, pa.string()), pa.array(value)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

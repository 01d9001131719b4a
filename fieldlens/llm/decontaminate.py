"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import _text as tx
from fieldlens.llm._spark import cut, may_be_in, small_batches

#: MinHash functions; shingles in the smallest window step; items of up to so many shingles are looked up by each of these.
FUNCTIONS = 64
STEP = 8
SHORT = 3
_SEED = 23


def _shingle_slices(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in tx.slices(texts):
        yield first, last, *tx.shingles(*tx.word_hashes(data, offsets, tx.NOT_ALNUM), words, short=False)


def _item_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, values, at in _shingle_slices(b.column(1), words):
                of = np.repeat(np.arange(first, last), np.diff(at))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(values.view(np.int64))], ["item_id", "shingle"])

    return run


def _token(least: np.ndarray, i: int, size: int) -> np.ndarray:
    """Band key of the i-th MinHash value in the partition of windows of one size."""
    return tx.mix((least + tx.salt(i + 1, 57)) ^ tx.salt(size, 56))


def _whole(shingles: np.ndarray) -> np.ndarray:
    """Keys by which short items are looked up: their shingles, apart from the keys of bands."""
    return tx.mix(shingles ^ tx.salt(1, 55))


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask, odd = tx.hash_family(FUNCTIONS, _SEED)
    for b in batches:
        ids, tokens = [], []
        for item, size, shingles in zip(*[c.to_pylist() for c in b.columns], strict=True):
            x = np.array(shingles, np.int64).view(np.uint64)
            if len(x) <= SHORT:
                own = _whole(x)
            else:
                least = np.array([((x ^ mask[i]) * odd[i]).min() for i in range(FUNCTIONS)], np.uint64)
                own = np.concatenate([_token(least[i : i + 1], i, size) for i in range(FUNCTIONS)])
            tokens += own.view(np.int64).tolist()
            ids += [item] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.int64())], ["item_id", "token"])


def _windows(words: int, sizes: list[int], short: bool, bitmap: np.ndarray):
    """mapInArrow function: (doc_id, token) for the window tokens that the bitmap of item tokens holds.

    In the partition of size s a document falls into windows of 2 s shingles that start every s shingles, so
    each passage of up to s shingles lies whole in a window at most twice its class's size. The minima of
    steps of 8 shingles are shared by all sizes."""
    mask, odd = tx.hash_family(FUNCTIONS, _SEED)

    def starts(count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """First positions of the steps of every document, and the number of steps by document."""
        n = -(-count // step)
        base = np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), n)
        return base + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, values, at in _shingle_slices(b.column(1), words):
                if not len(values):
                    continue
                fine, n = starts(np.diff(at), STEP)
                coarse = {s: starts(n, s // STEP) for s in sizes}
                buf = np.empty(len(values), np.uint64)
                docs, tokens = [], []
                if short:
                    whole = _whole(values)
                    hit = np.flatnonzero(tx.in_bitmap(bitmap, whole))
                    docs.append(np.searchsorted(at, hit, "right") - 1)
                    tokens.append(whole[hit])
                for i in range(FUNCTIONS if sizes else 0):
                    np.bitwise_xor(values, mask[i], out=buf)
                    np.multiply(buf, odd[i], out=buf)
                    least = np.minimum.reduceat(buf, fine)
                    for s, (begin, m) in coarse.items():
                        g = np.minimum.reduceat(least, begin)
                        window = g.copy()
                        window[:-1] = np.minimum(g[:-1], g[1:])
                        tail = np.cumsum(m)[m > 0] - 1
                        window[tail] = g[tail]
                        token = _token(window, i, s)
                        hit = np.flatnonzero(tx.in_bitmap(bitmap, token))
                        if len(hit):
                            docs.append(np.searchsorted(np.cumsum(m), hit, "right"))
                            tokens.append(token[hit])
                if docs:
                    both = np.unique(np.stack([np.concatenate(docs).astype(np.uint64), np.concatenate(tokens)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(both[:, 0].astype(np.int64) + first)), pa.array(both[:, 1].copy().view(np.int64))], ["doc_id", "token"]
                    )

    return run


def _matching(words: int, bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, values, at in _shingle_slices(b.column(1), words):
                hit = np.flatnonzero(tx.in_bitmap(bitmap, values))
                of = np.searchsorted(at, hit, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of + first)), pa.array(values[hit].view(np.int64))], ["doc_id", "shingle"])

    return run


def _bits(keys: DataFrame) -> int:
    """Size of a bitmap of ``keys``: 2 ** 22 bits for up to 262,144 keys, 2 ** 27 at most."""
    return min(27, max(22, (16 * max(1, keys.count()) - 1).bit_length()))


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Benchmark items that documents contain: ``doc_id, item_id, n_shared, n_item, containment``.

    A document contains an item where at least ``percent`` percent of the item's distinct ``words``-word
    shingles occur in it. Words are runs of letters and digits in lower case; punctuation separates them.

    Items fall into classes by size (powers of two from 8 shingles); for each class documents are searched in
    windows of twice that size, so a short item meets windows of its own scale, however long the document is:
    the similarity of a contained item of more than SHORT shingles and its window is at least 0.19, and 64 MinHash values, each a
    band of its own, miss that with a probability of 1 in 700,000. Items of up to SHORT shingles, all of which have to occur, are
    looked up by each of their shingles, so none of them is missed. Document keys pass a bitmap of item keys (512 KB, or 16 to 32 bits a
    key where there are many, 16 MB at most), then an exact join; every candidate is verified on the distinct shingles of the whole text.

    Items of fewer than ``words`` words, null or empty ones have no shingle and match nothing, as do such
    documents. Rows that share an item_id form one item, rows that share a doc_id one document; rows with a
    null id match nothing. Empty tables give an empty result. Only doc_id, text and item_id, text are read.
    """
    small_batches(docs.sparkSession)
    lower = F.lower(F.col("text").cast("string")).alias("text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), lower).where("item_id is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower).where("doc_id is not null")
    shingles = cut(items.mapInArrow(_item_shingles(words), "item_id long, shingle long").distinct(), "items")
    sized = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"), F.collect_list("shingle").alias("shingles"))
    size = F.greatest(F.lit(STEP), F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("int"))
    sized = sized.withColumn("size", size)
    kinds = sized.select(F.when(F.col("n_item") > SHORT, F.col("size")).alias("size")).distinct().collect()  # one for each power of two
    sizes, short = sorted(r.size for r in kinds if r.size), any(r.size is None for r in kinds)
    tokens = cut(sized.select("item_id", "size", "shingles").mapInArrow(_item_tokens, "item_id long, token long"), "tokens")
    found = texts.mapInArrow(_windows(words, sizes, short, tx.fixed_bitmap(tokens, "token", _bits(tokens))), "doc_id long, token long")
    candidates = cut(found.join(tokens, "token").select("doc_id", "item_id").distinct(), "candidates")

    maybe = may_be_in(texts, F.col("doc_id"), candidates, "doc_id")
    shared = maybe.mapInArrow(_matching(words, tx.fixed_bitmap(shingles, "shingle", _bits(shingles))), "doc_id long, shingle long").distinct()
    asked = candidates.join(shingles, "item_id")  # so a shingle of many items and documents meets the candidates' only
    counted = asked.join(shared, ["doc_id", "shingle"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    counted = counted.join(sized.select("item_id", "n_item"), "item_id").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return counted.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that contain an item; rows that share a contaminated document's doc_id go with it, rows
    with a null doc_id stay. Columns of any name pass through; an empty table of either kind leaves docs as they are."""
    gone = cut(contaminated(docs, items, words, percent).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")

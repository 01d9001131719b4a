"""Language-model scoring: an interpolated modified Kneser-Ney model over words.

Counting is a recursion over orders. Tasks pack the distinct n-grams of their documents, with counts, into one
compressed block per bucket; a bucket's blocks meet in one task, which adds them up, writes the bucket's sorted hash
array and passes on what the next lower order needs: the distinct (n-1)-grams that end its n-grams. Workers map the
arrays into memory from the shared folder and read only the pages that their documents touch.

A bucket is chosen by the hash of an n-gram's context, so that the sums of a context are made in one place; contexts
that are frequent in a sample of documents are dealt by the whole n-gram, and their sums meet afterwards. The sample
decides about places only: every count is over all documents.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm._blocks import pack, unpack
from fieldlens.llm._spark import cut, discard, shared_dir, small_batches
from fieldlens.llm._text import _PLACE, U64, mix, salt, slices, word_hashes

#: What stands before and after the words of a text.
BEGIN, END = U64(0x5BD1E9955BD1E995), U64(0x27D4EB2F165667C5)
#: Distinct n-grams that a counting task holds before it packs them.
HELD_ROWS = 1 << 20
#: Files that a worker keeps mapped.
OPEN_MAPS = 2_048
#: Documents looked at to find contexts too frequent for one bucket.
SAMPLE_DOCS = 20_000


def mounted(spark: SparkSession) -> str:
    """The shared folder as a path that workers can open and map."""
    parts = urlsplit(shared_dir(spark))
    if parts.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped from a mounted folder; spark.checkpoint.dir is a {parts.scheme} store")
    return parts.path.rstrip("/")


def joint(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams whose words are given by place; of one word, its own."""
    if len(words) == 1:
        return words[0]
    total = np.full(len(words[0]), salt(len(words), 40), U64)
    for j, w in enumerate(words):
        total += w * _PLACE[j]
    return mix(total)


def tokens(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words of every token's n-gram by place (order - 1 before it, then itself), and the offsets by text."""
    parts, sizes = [], []
    for first, last, data, offsets in slices(texts):
        words, at = word_hashes(data, offsets)
        count, pad = np.diff(at), order - 1
        start = np.concatenate([[0], np.cumsum(count + pad + 1)])
        line = np.full(start[-1], BEGIN, U64)
        doc = np.repeat(np.arange(last - first), count)
        line[start[doc] + pad + np.arange(len(words)) - at[doc]] = words
        line[start[1:] - 1] = END
        real = np.ones(len(line), bool)
        for j in range(pad):
            real[start[:-1] + j] = False
        own = np.flatnonzero(real)
        parts.append([line[own - pad + j] for j in range(order)])
        sizes.append(count + 1)
    if not parts:
        return [np.zeros(0, U64)] * order, np.zeros(1, np.int64)
    return [np.concatenate(p) for p in zip(*parts)], np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def added(words: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Hashes of the distinct n-grams in order, their words, and their summed counts."""
    keys = joint(words)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = [np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums]
    return keys[first], [w[order[first]] for w in words], total


@dataclass
class Level:
    """Where the n-grams of one order lie."""

    buckets: int
    hot: np.ndarray
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)

    def bucket(self, context: np.ndarray, gram: np.ndarray) -> np.ndarray:
        spread = self.hot[np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)] == context if len(self.hot) else np.zeros(len(context), bool)
        return (mix(np.where(spread, gram, context)) % U64(self.buckets)).astype(np.int32)


@dataclass
class Model:
    """What scoring needs besides the arrays: their folder and a few numbers."""

    folder: str
    order: int
    levels: dict[int, Level]
    word_shards: int = 1
    context_shards: dict[int, int] = field(default_factory=dict)
    tokens: int = 0
    words: int = 0
    continuations: int = 0
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    rest: float = 1.0


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4. Where one of these is 0, or a discount is not
    above 0 (so that nothing would be left for unseen words): 0.5, 1 and 1.5."""
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3))
    return d if min(d) > 0 else (0.5, 1.0, 1.5)


def _discount(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)]


# --- counting -------------------------------------------------------------------------------------------------------

_BLOCKS = "bucket int, block binary"


def _packed(level: Level, words: list[np.ndarray], sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One block for every bucket that has rows."""
    gram = joint(words)
    bucket = level.bucket(joint(words[:-1]), gram)
    order = np.lexsort((*words[::-1], bucket))
    bucket, columns = bucket[order], [c[order] for c in (*words, *sums)]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        block = pack(np.diff(columns[0][lo:hi], prepend=U64(0)), *[c[lo:hi] for c in columns[1:]])
        yield pa.RecordBatch.from_arrays([pa.array([bucket[lo]], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"])


def _count(level: Level, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def merged() -> tuple[list[np.ndarray], np.ndarray]:
            _, words, (count,) = added([np.concatenate(c) for c in zip(*(w for w, _ in held))], [np.concatenate([c for _, c in held])])
            return words, count

        for batch in batches:
            words, _ = tokens(batch.column(0), order)
            if not len(words[0]):
                continue
            _, words, (count,) = added(words, [np.ones(len(words[0]), U64)])
            held.append((words, count))
            size += len(count)
            if size >= HELD_ROWS:
                words, count = merged()
                held, size = [(words, count)], len(count)
                if size > HELD_ROWS // 2:
                    yield from _packed(level, words, [count, count])
                    held, size = [], 0
        if held:
            words, count = merged()
            yield from _packed(level, words, [count, count])

    return run


_FOUND = "kind int, h long, a long, b long, c long, d long, bucket int, block binary"
_CONTEXT, _LAST, _SPECTRUM, _LOWER = range(4)


def _found(kind: int, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(keys.view(np.int64))]
    columns += [pa.array(v.astype(np.int64)) for v in values] + [pa.array(np.zeros(n, np.int64))] * (4 - len(values))
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["kind", "h", "a", "b", "c", "d", "bucket", "block"])


def _write(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Files appear whole or not at all, and a repeated task writes the same again."""
    os.makedirs(folder, exist_ok=True)
    for kind, values in arrays.items():
        part = f"{folder}/{name}.{kind}.{uuid.uuid4().hex}"
        values.tofile(part)
        os.replace(part, f"{folder}/{name}.{kind}")


def _total(folder: str, k: int, levels: dict[int, Level]):
    """Adds up a bucket's blocks (of n-grams of order k, their counts, and how often they are said), writes its array, and returns the sums of
    contexts, how many n-grams have counts 1 to 4, and the last words or, above order 2, the shorter n-grams."""

    def unpacked(block: bytes) -> list[np.ndarray]:
        steps, *rest = unpack(block)
        return [np.cumsum(steps, dtype=U64), *rest]

    def bucket_done(bucket: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*map(unpacked, blocks))]
        keys, words, (count, said) = added(columns[:k], columns[k:])
        large = count > 254
        _write(folder, f"{k}-{bucket}", keys=keys, small=np.minimum(count, 255).astype(np.uint8), big_keys=keys[large], big=count[large])
        context, first, of = np.unique(joint(words[:-1]), return_index=True, return_inverse=True)
        size = len(context)
        yield _found(_CONTEXT, context, np.bincount(of, count, size), np.bincount(of, count == 1, size), np.bincount(of, count == 2, size), np.bincount(of, count > 2, size))
        yield _found(_SPECTRUM, np.zeros(1, U64), *[np.array([(count == i).sum()]) for i in (1, 2, 3, 4)])
        _, last, (lefts, said) = added(words[1:], [np.ones(len(keys), U64), said])
        if k == 2:
            yield _found(_LAST, last[0], lefts, said)
            return
        for part in _packed(levels[k - 1], last, [lefts, said]):
            row = pa.array([_LOWER], pa.int32())
            yield pa.RecordBatch.from_arrays([row, *[pa.nulls(1, pa.int64())] * 5, *part.columns], ["kind", "h", "a", "b", "c", "d", "bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and blocks:
                    yield from bucket_done(now, blocks)
                    blocks = []
                now = bucket
                blocks.append(block)
        if blocks:
            yield from bucket_done(now, blocks)

    return run


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h ^ U64(0xA5A5)) % U64(shards)).astype(np.int32)


def _write_shards(df: DataFrame, folder: str, name: str, shards: int) -> None:
    """Sorted arrays of the hashes h and of each other column (longs), in ``shards`` files."""
    columns = df.columns

    def placed(batches):
        for batch in batches:
            h = np.asarray(batch.column(0)).view(U64)
            yield pa.RecordBatch.from_arrays([pa.array(_shard(h, shards)), *batch.columns], ["shard", *columns])

    def write(batches):
        def done(shard, parts):
            table = pa.Table.from_batches(parts)
            keys = np.asarray(table.column("h").combine_chunks()).view(U64)
            order = np.argsort(keys)
            _write(folder, f"{name}-{shard}", keys=keys[order], **{c: np.asarray(table.column(c).combine_chunks())[order] for c in columns[1:]})
            return len(keys)

        now, parts, sizes = None, [], []
        for batch in batches:
            ids = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if ids[lo] != now and parts:
                    sizes.append(done(now, parts))
                    parts = []
                now = int(ids[lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            sizes.append(done(now, parts))
        yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)], pa.int64())], ["n"])

    schema = "shard int, " + ", ".join(f"{c} long" for c in columns)
    df.mapInArrow(placed, schema).repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _frequent(docs: DataFrame, share: float, order: int, buckets: int) -> dict[int, Level]:
    """The levels, with the contexts that a sample of documents shows to be too frequent for one bucket."""

    def contexts(batches):
        for batch in batches:
            words, _ = tokens(batch.column(0), order)
            for k in range(2, order + 1):
                h, n = np.unique(joint(words[order - k : order - 1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "h", "n"])

    seen = docs.sample(fraction=share, seed=1) if share < 1 else docs
    counts = seen.mapInArrow(contexts, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    total = {r.k: r.all for r in counts.groupBy("k").agg(F.sum("n").alias("all")).collect()}  # one for each order
    most = F.coalesce(*[F.when(F.col("k") == k, F.lit(n)) for k, n in total.items()], F.lit(0))
    rows = counts.where(F.col("n") * 4 * buckets > most).select("k", "h").collect()  # 4 * buckets rows a level at most
    out = {}
    for k in range(2, order + 1):
        out[k] = Level(buckets, np.sort(np.array([r.h for r in rows if r.k == k], np.int64).view(U64)))
    return out


def train(docs: DataFrame, order: int = 2, text: str = "text", bucket_bytes: int = 8 << 20) -> Model:
    """Model of all texts of ``docs`` (null: empty). A text's tokens are its words (A-Z as a-z; what separates them is 0x20 and 0x09 to 0x0D)
    and an end; ``order`` - 1 begins stand before it. The top order has the counts of its n-grams, each lower order the number of
    distinct words on their left. Order 1 is mixed with 1 / (words + 1), which is what an unknown word gets.

    ``bucket_bytes``: text for one bucket; a bucket's distinct n-grams are in one task's memory. No documents at all
    give a model in which every token has probability 1. Words and n-grams are the same where 64 bits of their hashes are.
    """
    if order < 2:
        raise ValueError("order is 2 at least")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    buckets = max(1, math.ceil(size.bytes / bucket_bytes))
    folder = f"{mounted(spark)}/fieldlens-ngrams-{uuid.uuid4().hex}"
    levels = _frequent(texts, min(1.0, SAMPLE_DOCS / max(1, size.n)), order, buckets)
    model = Model(folder, order, levels)
    blocks, spent = texts.mapInArrow(_count(levels[order], order), _BLOCKS), []
    for k in range(order, 1, -1):
        dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        found = cut(dealt.mapInArrow(_total(folder, k, levels), _FOUND), f"ngrams{k}")
        spent.append(found)
        n = found.where(F.col("kind") == _SPECTRUM).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcd"]).first()
        levels[k].discounts = discounts(list(n))
        of_context = [F.coalesce(F.sum(F.when(F.col("kind") == _CONTEXT, F.col(c))), F.lit(0)).alias(name) for c, name in zip("abcd", ("total", "ones", "twos", "more"))]
        of_last = [F.coalesce(F.sum(F.when(F.col("kind") == _LAST, F.col(c))), F.lit(0)).alias(name) for c, name in zip("ab", ("lefts", "said"))]
        by_hash = found.where(F.col("kind").isin(_CONTEXT, _LAST)).groupBy("h")
        if k > 2:
            shards = max(1, math.ceil(found.where(F.col("kind") == _CONTEXT).count() / 1_000_000))
            _write_shards(by_hash.agg(*of_context), folder, f"context{k}", shards)
            model.context_shards[k] = shards
            blocks = found.where(F.col("kind") == _LOWER).select("bucket", "block")
            continue
        words = cut(by_hash.agg(*of_context, *of_last), "ngram-words")
        spent.append(words)
        is_word = F.col("said") > 0
        sums = words.agg(
            F.count(F.when(is_word, 1)).alias("words"), F.coalesce(F.sum("said"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("lefts"), F.lit(0)).alias("lefts"),
            F.count("*").alias("rows"), *[F.count(F.when(F.col("lefts") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.when(F.col("lefts") > 2, 1)).alias("more"),
        ).first()
        model.tokens, model.words, model.continuations = sums.tokens, sums.words, sums.lefts
        model.discounts = discounts([sums.n1, sums.n2, sums.n3, sums.n4])
        if sums.lefts:
            model.rest = sum(d * n for d, n in zip(model.discounts, (sums.n1, sums.n2, sums.more))) / sums.lefts
        model.word_shards = max(1, math.ceil(sums.rows / 1_000_000))
        _write_shards(words, folder, "words", model.word_shards)
    discard(*spent)
    return model


# --- scoring --------------------------------------------------------------------------------------------------------

_maps: OrderedDict[str, np.ndarray] = OrderedDict()


def _map(path: str, kind: type) -> np.ndarray:
    if path in _maps:
        _maps.move_to_end(path)
        return _maps[path]
    there = os.path.exists(path) and os.path.getsize(path)
    _maps[path] = np.memmap(path, kind, "r") if there else np.zeros(0, kind)
    if len(_maps) > OPEN_MAPS:
        _maps.popitem(last=False)
    return _maps[path]


def _read(base: str, keys: np.ndarray, **columns: type) -> tuple[np.ndarray, ...]:
    """Values at ``keys`` (sorted) in the arrays of one file each; 0 where a key is missing."""
    there = _map(f"{base}.keys" if "big" not in columns else f"{base}.big_keys", U64)
    if not len(there):
        return tuple(np.zeros(len(keys), np.int64) for _ in columns)
    at = np.minimum(np.searchsorted(there, keys), len(there) - 1)
    hit = there[at] == keys
    return tuple(np.where(hit, _map(f"{base}.{c}", kind)[at], 0).astype(np.int64) for c, kind in columns.items())


def _grouped(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1], [True]])) if len(place) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(place[order[lo]]), order[lo:hi]


def _looked_up(model: Model, name: str, shards: int, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    out = [np.zeros(len(distinct), np.int64) for _ in columns]
    for shard, rows in _grouped(_shard(distinct, shards)):
        for o, got in zip(out, _read(f"{model.folder}/{name}-{shard}", distinct[rows], **{c: np.int64 for c in columns})):
            o[rows] = got
    return [o[back] for o in out]


def _gram_counts(model: Model, k: int, context: np.ndarray, gram: np.ndarray) -> np.ndarray:
    distinct, first, back = np.unique(gram, return_index=True, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    for bucket, rows in _grouped(model.levels[k].bucket(context[first], distinct)):
        base = f"{model.folder}/{k}-{bucket}"
        (out[rows],) = _read(base, distinct[rows], small=np.uint8)
        large = rows[out[rows] == 255]
        if len(large):
            (out[large],) = _read(base, distinct[large], big=np.uint64)
    return out[back]


def probabilities(model: Model, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token after its context, and how often the token itself was said in training."""
    last = words[-1]
    total, ones, twos, more = _looked_up(model, "words", model.word_shards, words[-2], ("total", "ones", "twos", "more"))
    lefts, said = _looked_up(model, "words", model.word_shards, last, ("lefts", "said"))
    p = np.maximum(lefts - _discount(lefts, model.discounts), 0.0) / max(1, model.continuations) + model.rest / (model.words + 1)
    for k in range(2, model.order + 1):
        own = words[model.order - k :]
        context = joint(own[:-1])
        if k > 2:
            total, ones, twos, more = _looked_up(model, f"context{k}", model.context_shards[k], context, ("total", "ones", "twos", "more"))
        count = _gram_counts(model, k, context, joint(own))
        d = model.levels[k].discounts
        seen = np.maximum(total, 1)
        q = np.maximum(count - _discount(count, d), 0.0) / seen + (d[0] * ones + d[1] * twos + d[2] * more) / seen * p
        p = np.where(total > 0, q, p)
    return p, said


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known (tokens that training has), base_score (smoothed single
    tokens), score (log10 probability by the model) and perplexity by token. Empty and null texts have one token, the end; repeated ids
    stay repeated; other columns are dropped. The model's folder must last until the result is written."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = T.StructType().add("doc_id", kind).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("perplexity", "double")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, at = tokens(batch.column(1), model.order)
            p, said = probabilities(model, words)
            base = np.log10((said + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            n, total = np.diff(at), np.add.reduceat(np.log10(p), at[:-1])
            known = np.add.reduceat((said > 0).astype(np.int64), at[:-1])
            values = [n, known, np.add.reduceat(base, at[:-1]), total, 10.0 ** (-total / n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values)], out.names)

    return own.mapInArrow(run, out)


def forget(spark: SparkSession, model: Model) -> None:
    """Delete the model's arrays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{model.folder}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold_scores(docs: DataFrame, order: int = 2, fold: int = 1) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text; null: empty) mod 5 is not ``fold``."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == fold
    model = train(docs.where(~held_out), order)
    scored = cut(score(docs, model), "ngram-scores")
    forget(docs.sparkSession, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")

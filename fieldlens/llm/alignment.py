"""Alignment of two tokenizers: which tokens end together, how often each pair does so in the corpus, and which partner
is a token's most frequent one.

Each text is encoded once, by both. Tasks gather (pair, document) records, sort them by radix of the B token, B token, A token
and document, and spill one zstd run for every radix. A radix is one unit of work, or several where it has very many
records; there a k-way heap merge of its runs counts every pair. The complete counts come back to the radix in order of B tokens,
which gives each B token's maximum in one pass, and the runs then stream past them once more: every record turns into what it
adds to its document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.llm._blocks import pack, runs, unpack
from fieldlens.llm._spark import cut, discard, small_batches

FOLDER = "/opt/tokenizers"
#: Links that a task gathers before it spills them as runs.
HELD_LINKS = 1 << 22
#: Radixes of the B token, and records of one unit of work. A document contributes to a row of each radix, so their number doesn't follow the
#: input: a radix with more records becomes several units.
RADIXES, UNIT_RECORDS = 32, 1 << 23
#: Pairs that a merge takes from a run at a time.
STEP = 1 << 15
#: Bits of a token id in a pair's key.
ID_BITS = 24


# Fixed value: how byte-level tokenizers of this kind split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def byte_level(path: str):
    """A: the encoding function of a tokenizer's JSON file, and each id's bytes.

    Where the file only splits and merges, with merges in the order of their results' ids, its own vocabulary is handed to an
    encoder that merges by id, which gives the same ids in a quarter of the time.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(vocabulary.values()) + 1)
    for entry, k in vocabulary.items():
        entries[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split, model = told["pre_tokenizer"] or {}, told["model"]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if told["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and merged == sorted(merged) and not model.get("ignore_merges"):
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {entries[k]: k for entry, k in model["vocab"].items() if entry not in special}
        encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return (lambda texts: [encode(t) for t in texts]), np.array(entries, object)
    return (lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), np.array(entries, object)


@cache
def pieces(path: str):
    """B: the tokenizer of a piece model, and each id's bytes."""
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for k in range(tokenizer.get_piece_size()):
        piece = tokenizer.id_to_piece(k)
        entries.append(bytes([int(piece[3:5], 16)]) if tokenizer.is_byte(k) else piece.replace("▁", " ").encode())
    return tokenizer, np.array(entries, object)


@cache
def _shown(path: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every id: how many bytes it has, its number before a comma, and before what ends its side of a group."""
    entries = (byte_level if kind == "a" else pieces)(path)[1]
    return np.array([len(e) for e in entries], np.int64), np.array([f"{k}," for k in range(len(entries))], object), np.array([f"{k}{'|' if kind == 'a' else ';'}" for k in range(len(entries))], object)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the offsets by text."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, at[-1]), at


def _encode(texts: list[str], path_a: str, path_b: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Rows that both tokenizers give back byte by byte, and their ids with the offsets by text."""
    (encode, bytes_a), (b, bytes_b) = byte_level(path_a), pieces(path_b)
    full = [k for k, t in enumerate(texts) if t]
    raw = [" " + texts[k] for k in full]
    both = []
    for ids, entries in ((encode(raw), bytes_a), (b.encode([texts[k] for k in full], num_threads=1) if full else [], bytes_b)):
        flat, at = _flat(ids)
        parts = entries[flat]
        both.append((flat, at, [b"".join(parts[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]))
    good = np.array([x == y == r.encode() for x, y, r in zip(both[0][2], both[1][2], raw)], bool)

    def kept(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(at)
        return flat[np.repeat(good, sizes)], np.concatenate([[0], np.cumsum(sizes[good])])

    return np.array(full, np.int64)[good], kept(*both[0][:2]), kept(*both[1][:2])


def _spill(radix: np.ndarray, keys: np.ndarray, docs: np.ndarray, row_of: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(radix, records, run) of the links held: pairs in order, the documents of each in order, and how often."""
    order = np.lexsort((docs, keys, radix))
    radix, keys, docs = radix[order], keys[order], docs[order]
    same = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])  # a key has one radix
    first = np.flatnonzero(same)
    times = np.diff(np.append(first, len(keys)))
    radix, keys, docs = radix[first], keys[first], docs[first]
    cuts = runs(radix)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        pair = runs(keys[lo:hi])
        distinct = keys[lo:hi][pair[:-1]]
        step = np.diff(docs[lo:hi], prepend=0)
        step[pair[:-1]] = docs[lo:hi][pair[:-1]]
        yield int(radix[lo]), int(hi - lo), pack(np.diff(distinct, prepend=0), np.diff(pair), step, times[lo:hi] - 1, np.diff(row_of, prepend=0))


def _run(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, where the records of each begin, and by record the document's place, how often; rows by place."""
    step, sizes, docs, times, rows = (c.astype(np.int64) for c in unpack(block))
    start = np.concatenate([[0], np.cumsum(sizes)])
    total = np.cumsum(docs)
    before = np.where(start[:-1] > 0, total[start[:-1] - 1], 0) if len(sizes) else sizes
    return np.cumsum(step), start, total - np.repeat(before, sizes), times + 1, np.cumsum(rows)


def _encoded(kind: pa.DataType, path_a: str, path_b: str, radixes: int, names: list[str]):
    """Rows of documents, and rows of runs."""
    types = [pa.int64(), kind, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def table(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)) for c, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, comma_a, last_a = _shown(path_a, "a")
        size_b, comma_b, last_b = _shown(path_b, "b")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows_held: list[np.ndarray] = []
        links = docs_held = 0

        def spilled():
            keys, docs = (np.concatenate(c) for c in zip(*held))
            radix = (((keys >> ID_BITS) * 0x9E3779B1) >> 7) % radixes
            for r, n, block in _spill(radix, keys, docs, np.concatenate(rows_held)):
                yield table(radix=[r], records=[n], block=[block])

        for batch in batches:
            n = batch.num_rows
            good, (a, at_a), (b, at_b) = _encode(batch.column(2).to_pylist(), path_a, path_b)
            n_a, n_b, n_groups, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            if len(good):
                n_a[good], n_b[good] = np.diff(at_a), np.diff(at_b)
                end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
                at = np.searchsorted(end_b, end_a)
                common = np.flatnonzero(end_b[at] == end_a)  # the texts' ends are among them
                link_a, link_b = a[common], b[at[common]]
                doc = np.repeat(good, n_a[good])[common]
                n_groups = np.bincount(doc, minlength=n)
                for k, own in zip(good, _groups(common, at[common], a, b, (comma_a, last_a, comma_b, last_b), n_groups[good])):
                    digest[k] = hashlib.sha256(own.encode()).hexdigest()
                held.append(((link_b << ID_BITS) | link_a, doc + docs_held))
                links += len(common)
            rows_held.append(np.asarray(batch.column(0)))
            docs_held += n
            yield table(row=batch.column(0), doc_id=batch.column(1), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_groups, groups_sha256=digest)
            if links >= HELD_LINKS:
                yield from spilled()
                held, rows_held, links, docs_held = [], [], 0, 0
        if links:
            yield from spilled()

    return run


def _groups(end_a: np.ndarray, end_b: np.ndarray, a: np.ndarray, b: np.ndarray, shown: tuple[np.ndarray, ...], sizes: np.ndarray) -> Iterator[str]:
    """The groups of each text as ``a1,a2|b1;...``: end_a and end_b hold the place of each group's last tokens, sizes the groups by text."""
    comma_a, last_a, comma_b, last_b = shown
    group_a, group_b = np.searchsorted(end_a, np.arange(len(a))), np.searchsorted(end_b, np.arange(len(b)))
    parts = np.empty(len(a) + len(b), object)
    text_a, text_b = comma_a[a], comma_b[b]
    text_a[end_a], text_b[end_b] = last_a[a[end_a]], last_b[b[end_b]]
    before = np.concatenate([[0], end_b[:-1] + 1])
    parts[np.arange(len(a)) + before[group_a]] = text_a
    parts[np.arange(len(b)) + end_a[group_b] + 1] = text_b
    ends = (end_a + end_b + 2)[np.cumsum(sizes) - 1]
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
        yield "".join(parts[lo:hi])[:-1]


def merged(sorted_runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys in order with their summed counts, in blocks, from runs of distinct keys in order: the heap names the run whose present
    block ends first, and all runs give what they have up to that key."""
    at = [0] * len(sorted_runs)
    last = lambda i: int(sorted_runs[i][0][min(at[i] + STEP, len(sorted_runs[i][0])) - 1])
    heap = [(last(i), i) for i, (keys, _) in enumerate(sorted_runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        bound, _ = heap[0]
        keys, counts = [], []
        for i, (k, c) in enumerate(sorted_runs):
            end = at[i] + int(np.searchsorted(k[at[i] : at[i] + STEP], bound, "right"))
            if end > at[i]:
                keys.append(k[at[i] : end])
                counts.append(c[at[i] : end])
                at[i] = end
        while heap and heap[0][0] <= bound:
            _, i = heapq.heappop(heap)
            if at[i] < len(sorted_runs[i][0]):
                heapq.heappush(heap, (last(i), i))
        if keys:
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            first = runs(key[order])[:-1]
            yield key[order][first], np.add.reduceat(count[order], first)


def _units(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list]]:
    """(unit, row) with the unit's columns first; rows of a unit follow each other."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = tuple(c[k].as_py() for c in batch.columns)
            yield row[:width], row[width:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the pairs of each unit."""

    def done(held):
        for keys, counts in merged(held):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    unit, held = None, []
    for now, (block,) in _units(batches, 2):
        if now != unit and held:
            yield from done(held)
            held = []
        unit = now
        keys, start, _, times, _ = _run(block)
        held.append((keys, np.add.reduceat(times, start[:-1])))
    yield from done(held)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of pair keys in order and their counts a radix."""

    def done(radix, held):
        keys, counts = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(keys)
        return pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([pack(np.diff(keys[order], prepend=0), counts[order])], pa.binary())], ["radix", "block"])

    now, held = None, []
    for batch in batches:
        radix = np.asarray(batch.column(0))
        cuts = runs(radix)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if radix[lo] != now and held:
                yield done(now, held)
                held = []
            now = int(radix[lo])
            held.append((np.asarray(batch.column(1))[lo:hi], np.asarray(batch.column(2))[lo:hi]))
    if held:
        yield done(now, held)


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the records of each run add to their documents. A unit's counts come first."""
    for _, (is_run, block) in _units(batches, 2):
        if not is_run:
            step, counts = (c.astype(np.int64) for c in unpack(block))
            known = np.cumsum(step)
            side = runs(known >> ID_BITS)
            most = np.repeat(np.maximum.reduceat(counts, side[:-1]), np.diff(side))
            continue
        keys, start, docs, times, rows = _run(block)
        at = np.searchsorted(known, keys)
        size = np.diff(start)
        best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        np.add.at(best, docs, times * np.repeat(counts[at] == most[at], size))
        np.add.at(total, docs, times * np.repeat(counts[at], size))
        touched = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rows[touched]), pa.array(best[touched]), pa.array(total[touched])], ["row", "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str = f"{FOLDER}/byte_bpe_50k.json", path_b: str = f"{FOLDER}/piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space itself; neither adds special tokens, and their strings in a
    text are text. Where tokens of both end at the same byte a group ends, and those two tokens are linked. A pair's count is its
    links over all documents; n_best counts the document's links whose count is the highest of their B token (ties
    included), count_sum adds the counts of all its links. Null and empty texts, and those that one of the tokenizers doesn't give back byte
    by byte, have zeros and ''. Rows that repeat an id, or have none, stay rows of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType().add("row", "long").add("doc_id", kind)
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        out = out.add(c, "long")
    out = out.add("groups_sha256", "string").add("radix", "integer").add("records", "long").add("block", "binary")
    arrow_kind = pa.schema(own.select("doc_id").limit(0).toArrow().schema).field(0).type
    encoded = cut(own.mapInArrow(_encoded(arrow_kind, path_a, path_b, RADIXES, out.names), out), "alignment")

    spilled = encoded.where(F.col("radix").isNotNull()).select("radix", "records", "block")
    parts = spilled.groupBy("radix").agg(F.ceil(F.sum("records") / UNIT_RECORDS).cast("int").alias("parts"))
    dealt = spilled.join(F.broadcast(parts), "radix").select("radix", F.pmod(F.xxhash64("block"), "parts").cast("int").alias("part"), "block")  # RADIXES rows
    in_units = dealt.repartition("radix", "part").sortWithinPartitions("radix", "part")
    counts = in_units.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    radix = F.pmod(F.shiftright(F.shiftright("key", ID_BITS) * F.lit(0x9E3779B1), 7), F.lit(RADIXES)).cast("int")
    answers = counts.select(radix.alias("radix"), "key", "n").repartition("radix").sortWithinPartitions("radix").mapInArrow(_answers, "radix int, block binary")
    answers = cut(answers, "alignment-counts")
    asked = answers.join(F.broadcast(parts), "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_run"), "block")
    work = asked.unionByName(dealt.withColumn("is_run", F.lit(True)).select("radix", "part", "is_run", "block")).repartition("radix", "part").sortWithinPartitions("radix", "part", "is_run")
    added = work.mapInArrow(_contributions, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = encoded.where(F.col("radix").isNull()).drop("radix", "records", "block").join(added, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    result = cut(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), "alignment-result")
    discard(encoded, answers)
    return result

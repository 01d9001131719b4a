"""Fuzzy line deduplication: MinHash bands over character shingles, exact verification, union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.scalars import let
from fieldlens.llm import _text as tx
from fieldlens.llm._graph import block_pairs, connected_components, whole_blocks
from fieldlens.llm._spark import cut, discard, maybe_in, may_be_in, small_batches

#: Characters in a shingle; bands of so many MinHash values: at similarity 0.8 all miss a pair in 2.5e-6 of cases.
CHARS = 8
BANDS, ROWS = 18, 3
#: Lines in a block of a band that is compared exhaustively, and pairs that are looked at together.
BLOCK, PAIRS = 1024, 1 << 16
#: Bits of the map of a line's shingles that rules out most pairs before their sets are compared.
MAP = 1024
#: Bits of a shingle's hash beside the number of a row or a pair in one 64-bit code.
HASH = 50
#: Band keys that are counted in one task before they are shuffled.
PACK = 1 << 20


def _key(doc_id: Column, text: Column) -> Column:
    """With the id, identifies a document row by its text, so that repeated rows are one document."""
    return F.xxhash64(doc_id, doc_id.isNull(), F.coalesce(text, F.lit("")))


def _split(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: first row, bytes, start and end of each line that isn't blank, its row and number, and a
    digest of 128 bits of the line (A-Z as a-z) as two longs."""
    for first, last, data, offsets in tx.slices(texts):
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        # a text that ends with a newline has an empty last line; its start equals the next text's first one
        ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        of = np.repeat(np.arange(last - first), np.diff(np.searchsorted(breaks, offsets)) + 1)
        number = np.arange(len(starts)) - np.searchsorted(of, of)
        solid = ends > starts
        for i in np.flatnonzero(solid)[tx.BLANK[data[starts[solid]]]]:  # few lines begin with a blank
            solid[i] = not tx.BLANK[data[starts[i] : ends[i]]].all()
        starts, ends, of, number = starts[solid], ends[solid], of[solid], number[solid]
        low = memoryview(data.tobytes().translate(tx.LOWER))
        digests = [hashlib.blake2b(low[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield first, data, starts, ends, of, number, np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lines, BANDS * ROWS] MinHash values and [lines, BANDS] band keys; a line of fewer than CHARS characters is its own shingle."""
    values, first, end = tx.char_windows(data, starts, ends, CHARS, np.uint32)
    signature = tx.minhash32(values, first, end, BANDS * ROWS, seed=11)
    short = np.flatnonzero(end == first)
    signature[short] = ids[short, :1].astype(np.uint32)
    bands = np.empty((len(starts), BANDS), np.uint64)
    for i in range(BANDS):
        part = signature[:, i * ROWS : (i + 1) * ROWS].astype(np.uint64)
        bands[:, i] = tx.mix((part * tx._PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + tx.salt(i + 1, 58))
    return signature, bands


def _packed(bits: int):
    """mapInArrow function over texts: the band keys of all lines with a print of each line, at most two prints a key, in
    one row (bucket, keys, prints) for each of 2**bits buckets of every PACK keys. Where a key has more, these two say that it is
    shared, and the prints between them are in rows of their own, without keys, in as many buckets again."""

    def pack(keys: list[np.ndarray], prints: list[np.ndarray]) -> pa.RecordBatch:
        key, seen = np.concatenate(keys), np.concatenate(prints)
        order = np.argsort(key)
        key, seen = key[order], seen[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low, high = np.minimum.reduceat(seen, at), np.maximum.reduceat(seen, at)
        size = np.diff(np.append(at, len(key)))
        between = tx.distinct(seen[(seen > np.repeat(low, size)) & (seen < np.repeat(high, size))])
        twice = high > low
        of = np.repeat(np.arange(len(at)), 1 + twice)
        second = np.concatenate([[False], of[1:] == of[:-1]])
        key, seen = key[at][of], np.where(second, high[of], low[of])
        bucket = np.concatenate([(key >> np.uint64(64 - bits)).astype(np.int32), (between >> np.uint32(32 - bits)).astype(np.int32) + (1 << bits)])
        rows, start = np.unique(bucket, return_index=True)
        edge = np.append(start, len(bucket))
        packed = [
            pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.minimum(edge, len(x)) * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            for x in (key, np.concatenate([seen, between]))
        ]
        return pa.RecordBatch.from_arrays([pa.array(rows), *packed], ["bucket", "keys", "prints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, waiting = [], [], 0
        for b in batches:
            for _, data, starts, ends, _, _, ids in _split(b.column(0)):
                first = np.sort(np.unique(ids[:, 0], return_index=True)[1])  # equal lines have the same bands
                starts, ends, ids = starts[first], ends[first], ids[first]
                if len(starts):
                    keys.append(_signatures(data, starts, ends, ids)[1].reshape(-1))
                    prints.append(np.repeat(ids[:, 0].astype(np.uint32), BANDS))
                    waiting += len(keys[-1])
                if waiting >= PACK:
                    yield pack(keys, prints)
                    keys, prints, waiting = [], [], 0
        if waiting:
            yield pack(keys, prints)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that have several prints as ``node``, and all prints of these as ``line``, from rows of _packed() sorted by bucket."""

    def found(keys: list[bytes], prints: list[bytes]) -> pa.RecordBatch:
        key, seen = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(prints), np.uint32)
        if len(key):
            order = np.argsort(key)
            key, seen = key[order], seen[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(seen, at) < np.maximum.reduceat(seen, at)
            seen = seen[np.repeat(several, np.diff(np.append(at, len(key))))]
            key = key[at][several]
        line = _spread(tx.distinct(seen))
        node, line = pa.array(key.view(np.int64)), pa.array(line.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([node, pa.nulls(len(line), pa.int64())]), pa.concat_arrays([pa.nulls(len(node), pa.int64()), line])], ["node", "line"])

    keys, prints, last = [], [], None
    for b in batches:
        for bucket, key, seen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if keys and bucket != last:
                yield found(keys, prints)
                keys, prints = [], []
            last = bucket
            keys.append(key)
            prints.append(seen)
    if keys:
        yield found(keys, prints)


def _spread(prints: np.ndarray) -> np.ndarray:
    """Prints of lines as evenly spread 64-bit numbers."""
    return tx.mix(prints.astype(np.uint64))


def _bloom(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter of ``nodes(node)``, three bits a key, of 16 bits a key but 32 MB at most, and the logarithm of its size.
    Beyond 16 million keys it lets more lines through; an exact join by node follows in any case."""
    bits = min(max(20, int(np.ceil(np.log2(16 * nodes.count() + 1)))), 28)
    spots = [F.shiftrightunsigned("node", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (64 - bits, (64 - bits) // 2, 0)]
    words = nodes.select(F.explode(F.array(*spots)).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    words = words.toArrow()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("bits"))
    return out.view(np.uint64), bits


def _in_bloom(bloom: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    out = np.ones(keys.shape, bool)
    for shift in (64 - bits, (64 - bits) // 2, 0):
        spot = (keys >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        out &= ((bloom[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def _line_rows(sent):
    """mapInArrow function over (key, doc_id, text): all lines, those that may share a band with these bands and their text. ``sent``:
    the filters of shared bands and of the prints of lines in them; only lines in the latter are signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, starts, ends, of, number, ids in _split(b.column(2)):
                nodes, prints = sent.value
                met = np.flatnonzero(_in_bloom(*prints, _spread(ids[:, 0].astype(np.uint32))))
                size, n = ends[met] - starts[met], np.zeros(len(starts), np.int64)
                own = np.concatenate([data[:0], *[data[starts[i] : ends[i]] for i in met]])
                bands = _signatures(own, np.cumsum(size) - size, np.cumsum(size), ids[met])[1]
                hit = _in_bloom(*nodes, bands)
                n[met] = hit.sum(axis=1)
                some = n > 0
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(bands[hit].view(np.int64)))
                texts = [data[s:e].tobytes().decode("utf-8", "replace") if m else None for s, e, m in zip(starts, ends, some, strict=True)]
                take = pa.array(of + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), lists, pa.array(texts, pa.string())],
                    ["key", "doc_id", "line_no", "id", "check", "bands", "line"],
                )

    return run


_LINES = "key long, doc_id long, line_no int, id long, check long, bands array<long>, line string"


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (HASH bits) of each text, sorted, and the offsets of each text's; a text of fewer than CHARS
    characters is its own shingle."""
    values, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for first, _, data, offsets in tx.slices(texts):
        x, begin, end = tx.char_windows(data, offsets[:-1], offsets[1:], CHARS, np.uint64)
        size = end - begin
        of = np.repeat(np.arange(len(size)), size)
        values.append(x[begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)])
        rows.append((of + first).astype(np.uint64))
        short = np.flatnonzero(size == 0)
        low = tx.lower_bytes(data)
        values.append(np.array([int.from_bytes(hashlib.blake2b(low[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64))
        rows.append((short + first).astype(np.uint64))
    code = tx.distinct((np.concatenate(rows) << np.uint64(HASH)) | (np.concatenate(values) >> np.uint64(64 - HASH)))
    return code & np.uint64((1 << HASH) - 1), np.searchsorted(code >> np.uint64(HASH), np.arange(len(texts) + 1, dtype=np.uint64))


def _similar_pairs(values: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (i, j) of the sets reach the similarity."""
    size, good = np.diff(at), np.zeros(len(i), bool)
    for lo in range(0, len(i), 4096):
        left, right = i[lo : lo + 4096], j[lo : lo + 4096]
        codes = []
        for side in (left, right):
            n = size[side]
            of = np.repeat(np.arange(len(side)), n)
            codes.append((of.astype(np.uint64) << np.uint64(HASH)) | values[np.repeat(at[side] - np.cumsum(n) + n, n) + np.arange(len(of))])
        both = np.sort(np.concatenate(codes))
        shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(HASH)).astype(np.int64), minlength=len(left))
        good[lo : lo + 4096] = shared * 100 >= (size[left] + size[right] - shared) * percent
    return good


def _maps(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[rows, MAP / 64] words: which of MAP classes the shingles of each row fall into."""
    bits = np.zeros((len(at) - 1, MAP), bool)
    bits[np.repeat(np.arange(len(at) - 1), np.diff(at)), (values % np.uint64(MAP)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _possible(maps: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows may reach the similarity. None that does is ruled out: each class that only one of two sets falls into
    holds a shingle that the other hasn't."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    good = np.flatnonzero(small * 100 >= large * percent)
    a, b = maps[i[good]], maps[j[good]]
    common = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
    most = np.minimum(size[i[good]] - np.bitwise_count(a).sum(axis=1, dtype=np.int64), size[j[good]] - np.bitwise_count(b).sum(axis=1, dtype=np.int64)) + common
    out = np.zeros(len(i), bool)
    out[good] = most * 100 >= (size[i[good]] + size[j[good]] - most) * percent
    return out


def _pairs(rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``rows`` within each of the groups that end at ``at``, about PAIRS at a time."""
    after = np.repeat(at[1:], np.diff(at)) - np.arange(len(rows)) - 1
    done = np.cumsum(after)
    lo = 0
    while lo < len(rows):
        hi = max(int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")), lo + 1)
        n = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield rows[i], rows[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        lo = hi


def spanning_links(comps: np.ndarray, values: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs of rows (i, j) similar ones, as few as join all that exact similarities and equal ``comps`` join. Each row is
    compared with one partner, then with two more, four and so on, as long as it has any that it isn't joined to."""
    label, out, take = np.unique(comps, return_inverse=True)[1], [], 1
    root = list(range(int(label.max()) + 1 if len(label) else 0))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    while True:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return out
        now = np.arange(len(j)) - np.searchsorted(j, j) < take
        left, right = i[now], j[now]
        good = _similar_pairs(values, at, left, right, percent)
        for a, b in zip(left[good].tolist(), right[good].tolist(), strict=True):
            x, y = top(label[a]), top(label[b])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        label = np.array([top(x) for x in range(len(root))])[label]
        i, j, take = i[~now], j[~now], take * 2


def _settled(percent: int):
    """mapInArrow function over rows (unit, p, q, id, comp, bands, line), sorted by the first three: verified links that join, within each
    band of such a group, all lines of different components that are similar enough or joined by those that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_blocks(batches):
            ids, bands = np.asarray(rows.column(3)), rows.column(5)
            values, spots = _sets(rows.column(6))
            size, maps = np.diff(spots), _maps(values, spots)
            comps = np.unique(np.asarray(rows.column(4)), return_inverse=True)[1]
            of = np.repeat(np.arange(len(ids)), np.diff(np.asarray(bands.offsets)))
            unit = np.repeat(np.arange(len(at) - 1), np.diff(at))[of]
            node = np.asarray(bands.flatten())
            order = np.lexsort((of, node, unit))
            of, unit, node = of[order], unit[order], node[order]
            edge = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (node[1:] != node[:-1]), [True]]))
            codes = [np.zeros(0, np.int64)]
            for i, j in _pairs(of, edge):
                apart = comps[i] != comps[j]
                i, j = i[apart], j[apart]
                good = _possible(maps, size, i, j, percent)
                codes.append(i[good] * len(ids) + j[good])
            code = tx.distinct(np.concatenate(codes))
            links = spanning_links(comps, values, spots, code // len(ids), code % len(ids), percent)
            a, b = (ids[np.array([x[k] for x in links], np.int64)] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _similar(percent: int):
    """mapInArrow function that keeps pairs (a, b, x, y) of lines whose shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            values, at = _sets(pa.concat_arrays([b.column(2), b.column(3)]))
            good = pa.array(_similar_pairs(values, at, np.arange(n), np.arange(n) + n, percent))
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in b.columns[:2]], ["a", "b"])

    return run


def _components(members: DataFrame, percent: int) -> DataFrame:
    """``(id, comp)`` of the lines that are linked; ``members``: (id, rank, bands, line), one row a line.

    Bands with the same members count once: lines that are alike share most of theirs. A band of up to BLOCK lines is
    compared whole in one task, and bands with the same least line meet there, so that a line comes once for all of them; where
    they hold more than BLOCK lines, each band is alone. Larger ones (templates, edited copies of one text) are first compared with their commonest line;
    what is still apart is then compared across components in pairs of blocks."""
    rows = members.select("id", "rank", F.explode("bands").alias("node"))
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min("id").alias("lead")).where("n > 1")
    nodes = nodes.groupBy("n", "x", "y").agg(F.min("node").alias("node"), F.min("lead").alias("lead"))
    unit = F.when(F.sum("n").over(Window.partitionBy("lead")) <= BLOCK, F.col("lead")).otherwise(F.col("node"))
    nodes = cut(nodes.select("node", "n", unit.alias("unit")), "nodes")
    met = cut(rows.join(nodes, "node"), "met")
    texts = members.select("id", "line")
    whole = met.where(F.col("n") <= BLOCK).groupBy("unit", "id").agg(F.collect_list("node").alias("bands")).join(texts, "id")
    whole = whole.select("unit", F.lit(0).alias("p"), F.lit(0).alias("q"), "id", F.col("id").alias("comp"), "bands", "line")
    whole = whole.repartition("unit").sortWithinPartitions("unit", "id")
    links = whole.mapInArrow(_settled(percent), "a long, b long")
    large = met.where(F.col("n") > BLOCK)
    hot = not large.isEmpty()
    if hot:
        pivots = large.groupBy("node").agg(F.min(F.struct("rank", "id"))["id"].alias("a"))
        stars = large.join(pivots, "node").where("id <> a").select("a", F.col("id").alias("b")).distinct()
        left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("x")), texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
        links = links.union(stars.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_similar(percent), "a long, b long"))
    links = cut(links.distinct(), "links")
    comps = cut(connected_components(links), "comps")
    if hot:
        held = large.join(comps, "id", "left").select("node", "id", F.coalesce("comp", "id").alias("comp"))
        mixed = held.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node")
        held = cut(held.join(mixed, "node"), "held")
        more = block_pairs(held, BLOCK, texts).select("node", "p", "q", "id", "comp", F.array("node").alias("bands"), "line").mapInArrow(_settled(percent), "a long, b long")
        more = cut(more.distinct(), "links")
        if not more.isEmpty():
            comps = cut(connected_components(links.union(more)), "comps")
        discard(held)
    discard(nodes, met)
    return comps


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``(key, doc_id, drops)``: for each document row that loses lines the sorted numbers (from 0) of those lines."""
    spark = docs.sparkSession
    small_batches(spark)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # Which bands hold several lines: most lines are alone in all of theirs, and keep neither text nor signature.
    bits = max(8, (16 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    packed = docs.select(text.alias("text")).mapInArrow(_packed(bits), "bucket int, keys binary, prints binary")
    nodes = cut(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "node long, line long"), "bands")
    prints = nodes.where("line is not null").select(F.col("line").alias("node")).distinct()
    sent = spark.sparkContext.broadcast((_bloom(nodes.where("node is not null").select("node")), _bloom(prints)))
    lines = docs.select(_key(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text")).mapInArrow(_line_rows(sent), _LINES)
    lines = cut(lines, "lines")
    counted = lines.groupBy("id").agg(F.count("*").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    several = cut(counted.where("n > 1 or lo < hi"), "copies")
    clash = several.where("lo < hi").select("id")
    if not clash.isEmpty():  # two lines of equal 64 bits: both take an id from all 128
        clash = clash.withColumn("clash", F.lit(True))
        lines, old = cut(lines.join(clash, "id", "left").withColumn("id", F.when(F.col("clash"), F.xxhash64("id", "check")).otherwise(F.col("id"))).drop("clash"), "lines"), lines
        several, spent = cut(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "copies"), several
        discard(old, spent)

    met = lines.where(F.size("bands") > 0)
    members = met.groupBy("id").agg((-F.count("*")).alias("rank"), F.first("bands").alias("bands"), F.first("line").alias("line"))
    members = cut(members, "members")
    comps = _components(members, percent)
    roots = several.select("id").union(comps.select("id")).distinct().join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("root"))
    roots = cut(roots, "roots")
    spot = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "line_no")
    places = cut(may_be_in(lines.select("key", "doc_id", "line_no", "id"), F.col("id"), roots, "id").join(roots, "id").select("root", spot.alias("spot")), "places")
    keep = cut(places.groupBy("root").agg(F.min("spot").alias("keep")), "keep")  # a table of its own, so that a hot root's join can be split
    drops = places.join(keep, "root").where("spot <> keep").groupBy("spot.key", "spot.doc_id").agg(F.array_sort(F.collect_set("spot.line_no")).alias("drops"))
    drops = cut(drops, "drops")
    discard(nodes, lines, several, members, roots, places, keep)
    sent.destroy()
    return drops


def counted_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(row struct of all other columns of ``docs``, text without repeated lines, lines, dropped), as dedup_lines() says."""
    drops = repeated_lines(docs, percent).withColumnsRenamed({"key": "k", "doc_id": "d"})
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), _key(doc_id, text).alias("key"), doc_id.alias("id"), text.alias("text"))
    touched, rest = maybe_in(rows, F.col("key"), drops, "k")  # texts that lose nothing are not shuffled
    touched = touched.join(drops, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")), "left").select("row", "text", "drops")
    out = touched.unionAll(rest.select("row", "text", F.lit(None).cast("array<int>").alias("drops")))

    def kept(parts: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drops"), lambda i: F.get(parts, i))

    left = F.array_join(let(F.split(F.col("text"), "\n", -1), kept), "\n")
    return out.select(
        "row",
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("dropped"),
    )


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, plus ``__lines`` and ``__dropped`` (numbers of lines).

    Two lines are linked where the Jaccard similarity of their sets of CHARS-character shingles (A-Z as a-z;
    a shorter line is its own single shingle) is at least ``percent`` / 100. Of each component the line
    that comes first (least doc_id, null last, then least line number) stays, all others go, wherever they
    are. Candidates meet in BANDS bands of ROWS MinHash values (at similarity 0.8 a pair is missed
    with probability 2.5e-6, at 0.9 with 6e-11). A first pass counts which bands hold several lines; only lines in
    such bands go on. Every two lines of a band are compared on their full sets, unless they are joined already; large
    bands first with their commonest line, then across components, block by block. Equal lines are one class from the start (by a digest of 128 bits), so a
    line in a third of all documents costs one entry; only its positions are joined to the decision, and a hot line's
    join can be split.

    Blank lines never go. Null text stays null with 0 lines. Rows with equal doc_id and text count as one
    document and lose the same lines. An empty table gives an empty result. Every other column is kept as it is, but
    columns named ``__lines`` or ``__dropped`` are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("__lines", "__dropped")]
    return counted_lines(docs, percent).select(
        *[F.col("text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept], F.col("lines").alias("__lines"), F.col("dropped").alias("__dropped")
    )

"""Near-duplicate documents by a chosen-path set similarity join over MinHash tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import _text as tx
from fieldlens.llm._graph import block_pairs, likely_links, likely_rows, similarity_components
from fieldlens.llm._spark import cut, discard, may_be_in, small_batches

#: MinHash functions; the first 128 also give a sketch of one bit each.
TOKENS = 512
TREES = 16
LEVELS = 3
#: Differing sketch bits beyond which a pair can't reach the threshold (5.4 standard deviations at 0.8).
MAX_BITS = 32
#: Agreeing tokens (of 512, by one byte each) below which a pair can't reach it (4.5 standard deviations).
LEAST_AGREE = 368
#: Members in a block of a node that is compared exhaustively.
BLOCK = 1024


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """Distinct shingles of each text, slice by slice, sorted."""
    for first, last, data, offsets in tx.slices(texts):
        values, at = tx.shingles(*tx.word_hashes(data, offsets), words)
        yield [tx.distinct(values[at[i] : at[i + 1]]) for i in range(last - first)], first


def _set_ids(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two independent hashes of each set, null for empty ones."""
    other = [tx.mix(s ^ tx._PLACE[57]) for s in sets]
    return [pa.array([int(tx.fold(s, place).view(np.int64)) if len(s) else None for s in those], pa.int64()) for those, place in ((sets, 61), (other, 56))]


def chosen_paths(signature: np.ndarray, trees: int, levels: int) -> np.ndarray:
    """[rows, trees, levels] node keys: at each node the path so far chooses which minwise token to branch on."""
    rows, tokens = signature.shape
    node = np.broadcast_to(tx.mix(np.arange(1, trees + 1, dtype=np.uint64) * tx._PLACE[60]), (rows, trees)).copy()
    out = np.empty((rows, trees, levels), np.uint64)
    for level in range(levels):
        choice = (node % np.uint64(tokens)).astype(np.int64)
        node = tx.mix(node * tx._PLACE[59] + tx.mix(np.take_along_axis(signature, choice, 1) + choice.astype(np.uint64)))
        out[:, :, level] = node
    return out


def sketch(signature: np.ndarray) -> np.ndarray:
    """[rows, 2] words of one bit of each of the first 128 tokens."""
    bits = ((signature[:, :128] >> np.uint32(8)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(signature), 2)


_TABLE = "doc_id long, text_hash long, set_id long, check long, n_shingles long, paths array<array<long>>, sk0 long, sk1 long, fine binary"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, set_id, check, n_shingles, paths, sk0, sk1, fine) of every document; set_id is null for an empty set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets, first in _sets(b.column(1), words):
                n = np.array([len(s) for s in sets], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
                sig = tx.minhash32(values, at[:-1], at[1:], TOKENS)
                paths = chosen_paths(sig.astype(np.uint64), TREES, LEVELS)
                inner = pa.ListArray.from_arrays(np.arange(len(n) * TREES + 1, dtype=np.int32) * LEVELS, pa.array(paths.reshape(-1).view(np.int64)))
                outer = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * TREES, inner)
                sk = sketch(sig)
                fine = (sig & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(n)), b.column(2).slice(first, len(n)), *_set_ids(sets), pa.array(n), outer,
                        pa.array(sk[:, 0].copy()), pa.array(sk[:, 1].copy()), pa.array([x.tobytes() for x in fine], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "set_id", "check", "n_shingles", "paths", "sk0", "sk1", "fine"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash()).mapInArrow(run, _TABLE)


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets, first in _sets(b.column(1), words):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(sets)), *_set_ids(sets), tx.long_list(np.concatenate(sets), np.array([len(s) for s in sets]))],
                    ["doc_id", "set_id", "check", "shingles"],
                )

    return docs.mapInArrow(run, "doc_id long, set_id long, check long, shingles array<long>")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, set bits by position) of the sketches of each node in a batch."""
    for b in batches:
        node, inverse = np.unique(np.asarray(b.column(0)), return_inverse=True)
        bits = np.unpackbits(np.stack([np.asarray(b.column(1)), np.asarray(b.column(2))], axis=1).view(np.uint8), axis=1)
        ones = np.zeros((len(node), 128), np.int64)
        np.add.at(ones, inverse, bits)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bincount(inverse)), tx.long_list(ones.reshape(-1), np.full(len(node), 128))], ["node", "n", "ones"])


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ones = np.asarray(b.column(2).flatten()).reshape(-1, 128)
        sk = np.packbits(2 * ones > np.asarray(b.column(1))[:, None], axis=1).view(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sk[:, 0].copy()), pa.array(sk[:, 1].copy())], ["node", "m0", "m1"])


def _centres(rows: DataFrame) -> DataFrame:
    """The member of each node whose sketch is nearest to the majority of its members' bits: with edited copies
    of one text that is the text itself. Bits are counted before they are shuffled."""
    parts = rows.select("node", "sk0", "sk1").mapInArrow(_bit_counts, "node long, n long, ones array<long>")
    flat = parts.select("node", "n", F.posexplode("ones").alias("i", "x")).groupBy("node", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    ones = flat.groupBy("node").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("ones"))
    major = ones.mapInArrow(_majorities, "node long, m0 long, m1 long")
    far = F.bit_count(F.col("sk0").bitwiseXOR(F.col("m0"))) + F.bit_count(F.col("sk1").bitwiseXOR(F.col("m1")))
    best = rows.join(major, "node").groupBy("node").agg(F.min(F.struct(far.alias("far"), "id", "n", "sk0", "sk1")).alias("c"))
    return best.select("node", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("id", "n", "sk0", "sk1")])


def classed(docs: DataFrame, words: int, percent: int, exact: bool) -> DataFrame:
    """One row (doc_id, text_hash, n_shingles, component_id, kept) per row of ``docs``, as near_duplicates() says."""
    table = cut(signatures(docs, words), "signatures")
    known = table.where("set_id is not null and doc_id is not null")
    clash = cut(known.groupBy("set_id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi").select("set_id", F.lit(True).alias("clash")), "clash")
    if clashing := not clash.isEmpty():  # two sets of equal 64 bits: both take an id from all 128
        known = _unclashed(known, clash)
    classes = known.groupBy("set_id").agg(
        F.min("doc_id").alias("rank"), F.first("n_shingles").alias("n"), F.first("sk0").alias("sk0"), F.first("sk1").alias("sk1"), F.first("paths").alias("paths"), F.first("fine").alias("fine")
    )
    classes = cut(classes.withColumnRenamed("set_id", "id"), "classes")
    max_bits, least_agree = (128, 0) if exact else (MAX_BITS, LEAST_AGREE)

    def plausible(a: str, b: str):
        bits = F.bit_count(F.col(f"{a}sk0").bitwiseXOR(F.col(f"{b}sk0"))) + F.bit_count(F.col(f"{a}sk1").bitwiseXOR(F.col(f"{b}sk1")))
        small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
        return (bits <= max_bits) & (small * 100 >= large * percent)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def chosen_sets(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, shingles) of the classes ``ids``, and the table of these to discard with it."""
        chosen = cut(classes.select("id", F.col("rank").alias("of")).join(ids, "id", "left_semi"), "chosen")
        sets = _shingle_sets(may_be_in(texts, F.col("doc_id"), chosen, "of"), words)
        if clashing:
            sets = _unclashed(sets, clash)
        sets = sets.join(chosen, (sets["set_id"] == chosen["id"]) & (sets["doc_id"] == chosen["of"]), "left_semi")
        return cut(sets.dropDuplicates(["set_id"]).select(F.col("set_id").alias("id"), "shingles"), "sets"), chosen

    def verify(pairs: DataFrame) -> DataFrame:
        sets, chosen = chosen_sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        sized = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
        links = cut(sized.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b").distinct(), "links")
        discard(sets, chosen)
        return links

    def settle(leaves: DataFrame) -> DataFrame:
        own = leaves.groupBy("id").agg(F.collect_list("node").alias("nodes"))  # one for each tree and level at most
        rows = block_pairs(leaves, BLOCK, classes.select("id", "fine").join(own, "id"))
        likely = cut(rows.mapInArrow(likely_rows(TOKENS, least_agree), rows.schema), "likely")
        sets, chosen = chosen_sets(likely.select("id").distinct())
        full = likely.join(sets, "id").select(*likely.columns, "shingles").repartition("node", "p", "q").sortWithinPartitions("node", "p", "q", "id")
        links = cut(full.mapInArrow(likely_links(TOKENS, least_agree, percent), "a long, b long").distinct(), "links")
        discard(likely, sets, chosen)
        return links

    _, comps = similarity_components(classes.drop("fine"), LEVELS, plausible, ["n", "sk0", "sk1"], verify, settle, _centres)
    root = classes.select("id", F.col("rank").alias("of")).join(comps, "id", "left").select("id", "of", F.coalesce("comp", "id").alias("comp"))
    least = root.groupBy("comp").agg(F.min("of").alias("root"))
    root = root.join(least, "comp").select(F.col("id").alias("set_id"), "root")
    ids = table.select("doc_id", "text_hash", "set_id", "check", "n_shingles")
    out = (_unclashed(ids, clash) if clashing else ids).join(root, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = cut(out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "components")
    discard(table, classes, clash)
    return out


def _unclashed(df: DataFrame, clash: DataFrame) -> DataFrame:
    return df.join(clash, "set_id", "left").withColumn("set_id", F.when(F.col("clash"), F.xxhash64("set_id", "check")).otherwise(F.col("set_id"))).drop("clash")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Link documents whose sets of ``words``-word shingles have Jaccard similarity >= ``percent`` / 100.

    Returns one row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``. component_id is the
    least doc_id reachable over links; kept is doc_id = component_id.

    Documents with equal sets (by two hashes of 64 bits) form a class. Each class walks TREES
    independent trees: a node's path chooses the minwise token on which its members branch. Nodes of up to
    64 members are compared exhaustively, larger ones branch again (LEVELS times), and what then still holds
    several components is compared across them, block by block, and what is likely confirmed where it meets. Sketches of the tokens discard pairs that can't reach the
    threshold (in fewer than 1 of 100,000 cases one that does; with ``exact`` none is discarded), the rest is confirmed
    on the full sets. Large nodes first try their central member, so the edited
    copies of one text are linked to it without comparing them with one another. At similarity 0.8 one tree of three levels brings a
    pair together with probability 0.51, sixteen trees miss it in 1 of 90,000 cases; at 0.9 never in practice.

    Null or empty texts: n_shingles 0, linked with nothing. A null doc_id: component_id null, kept true,
    linked with nothing. Repeated rows get equal results. Rows that share a doc_id but not the text each
    follow their own text: the doc_id names both, but joins no links. Only doc_id and text are read; other columns
    don't matter. An empty table gives an empty result.
    """
    return classed(docs, words, percent, exact).drop("text_hash")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """``docs`` without the documents that near_duplicates() doesn't keep. Of rows that repeat both doc_id and text one
    stays (any, where their other columns differ); rows that share only the doc_id each follow their own text; rows
    with a null doc_id all stay. Columns of any name pass through."""
    table = classed(docs, words, percent, exact)
    gone = table.where("not kept").select(F.col("doc_id").alias("g"), F.col("text_hash").alias("h")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("i"), _text_hash())
    left = rows.join(gone, (F.col("i") == F.col("g")) & (F.col("text_hash") == F.col("h")), "left_anti")
    again = table.where("kept and doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        again = again.select(F.col("doc_id").alias("g"), F.col("text_hash").alias("h"))
        twice = (F.col("i") == F.col("g")) & (F.col("text_hash") == F.col("h"))
        left = left.join(again, twice, "left_anti").unionAll(left.join(again, twice, "left_semi").dropDuplicates(["i", "text_hash"]))
    return left.select("row.*")

"""Connected components and candidate-node handling shared by the similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm._spark import cut, discard, may_be_in

#: Nodes of more rows than this are branched further (or swept once components are known).
SMALL_NODE = 64
#: Blocks of up to so many rows are compared many at a time; about so many pairs are looked at together.
VECTOR, PAIRS = 128, 1 << 16
#: Rows with their sets that are held together, but for larger blocks.
SET_ROWS = 1024


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, comp)``, comp the least id reachable, for every id with an edge.

    Alternating large-star and small-star rounds: each is a minimum by node, a join and a distinct, so no
    task sees more than rows of an edge table, and a hot node's rows can be split by the skew join.
    Self loops, repeated edges and nulls are ignored; an empty table gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = cut(e, "edges"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, cut(least.select("u", F.col("m").alias("v")).union(small).distinct(), "edges")
        discard(last)
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def block_pairs(held: DataFrame, size: int, payload: DataFrame) -> DataFrame:
    """The comparisons of mixed nodes, dealt out as pairs of blocks of about ``size`` members.

    ``held``: (node, id, comp), distinct in node and id; ``payload``: (id, ...), one row an id. Members outside the
    largest component of a node ask, in blocks p; all members answer, in blocks q. Returns (node, p, q, id, comp,
    asks, also, answers, ...), sorted by (node, p, q) with all rows of these in one task: every member that asks
    meets every member of the node in exactly one (p, q). ``also`` is true for members that ask in some pair.
    """
    parts = held.groupBy("node", "comp").agg(F.count("*").alias("n"))
    nodes = parts.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"))
    blocks = lambda n: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    nodes = nodes.select("node", F.col("main.comp").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("ps"), blocks(F.col("n")).alias("qs"))
    at = held.join(nodes, "node").withColumn("also", F.col("comp") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    at = at.withColumn("op", F.when(F.col("also"), own("ps"))).withColumn("oq", own("qs")).join(payload, "id")
    last = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda p, q, asks, answers: F.struct(p.alias("p"), q.alias("q"), asks.alias("asks"), answers.alias("answers"))
    asking = F.when(F.col("also"), F.transform(last("qs"), lambda q: spot(F.col("op"), q, F.lit(True), q == F.col("oq"))))
    answering = F.transform(F.filter(last("ps"), lambda p: ~F.col("also") | (p != F.col("op"))), lambda p: spot(p, F.col("oq"), F.lit(False), F.lit(True)))
    at = at.withColumn("spot", F.explode(F.concat(F.coalesce(asking, F.filter(answering, lambda x: F.lit(False))), answering)))
    rest = [c for c in payload.columns if c != "id"]
    out = at.select("node", "spot.p", "spot.q", "id", "comp", "spot.asks", "also", "spot.answers", *rest)
    return out.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q", "id")


def whole_blocks(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of whole pairs of blocks, of about ``rows`` rows, from batches sorted by (node, p, q), with the offsets of each pair."""
    held: list[pa.RecordBatch] = []
    waiting = 0

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        run = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = [np.asarray(run.column(i)) for i in range(3)]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return run, np.concatenate([[0], np.flatnonzero(new) + 1, [run.num_rows]])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        waiting += b.num_rows
        if waiting >= rows:
            run, at = joined()
            if len(at) > 2:
                yield run.slice(0, at[-2]), at[:-1]
                run = run.slice(at[-2])
            held, waiting = [run], run.num_rows
    if held:
        yield joined()


def _likely(rows: pa.RecordBatch, at: np.ndarray, tokens: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, agree), in batches of about PAIRS: places of rows of one pair of blocks and of different components, of which one asks and the other
    answers and ``least`` of the ``fine`` bytes agree. In large blocks each pair comes up in the least node that it shares only."""
    ids, comp = np.asarray(rows.column(3)), np.asarray(rows.column(4))
    asks, also, answers = (np.asarray(c.cast(pa.int8())) > 0 for c in rows.columns[5:8])
    fine = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint8).reshape(-1, tokens)
    size = np.diff(at)
    few = np.flatnonzero(np.repeat(size <= VECTOR, size))
    if len(few):  # all groups of few rows at once
        sizes = size[size <= VECTOR]
        after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(few)) - 1
        i = np.repeat(np.arange(len(few)), after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        i, j = few[i], few[j]
        far = (comp[i] != comp[j]) & ((asks[i] & answers[j]) | (asks[j] & answers[i]))
        i, j = i[far], j[far]
        agree = np.zeros(len(i), np.int64)
        for lo in range(0, len(i), 1 << 14):
            agree[lo : lo + (1 << 14)] = (fine[i[lo : lo + (1 << 14)]] == fine[j[lo : lo + (1 << 14)]]).sum(axis=1)
        good = agree >= least
        yield i[good], j[good], agree[good]
    for g in np.flatnonzero(size > VECTOR):
        own = np.arange(at[g], at[g + 1])
        node = rows.column(0)[int(at[g])].as_py()
        lists = [np.asarray(x.values) for x in rows.column(9)[at[g] : at[g + 1]]]
        lists = [x[x < node] for x in lists]
        lower = np.zeros((len(own), max(map(len, lists))), np.int64)
        for i, x in enumerate(lists):
            lower[i, : len(x)] = x
        filled = np.arange(lower.shape[1]) < np.array([len(x) for x in lists])[:, None]
        a, b, level, waiting = [], [], [], 0
        for i in np.flatnonzero(asks[own]):
            # of two that both ask only the lesser id does
            other = np.flatnonzero(answers[own] & (comp[own] != comp[own[i]]) & (~also[own] | (ids[own] > ids[own[i]])))
            agree = (fine[own[other]] == fine[own[i]]).sum(axis=1)
            good = agree >= least
            other, agree = other[good], agree[good]
            if len(lists[i]):
                earlier = ((lower[other][:, :, None] == lists[i]) & filled[other][:, :, None]).any(axis=(1, 2))
                other, agree = other[~earlier], agree[~earlier]
            a.append(np.full(len(other), own[i]))
            b.append(own[other])
            level.append(agree)
            waiting += len(other)
            if waiting >= PAIRS:
                yield np.concatenate(a), np.concatenate(b), np.concatenate(level)
                a, b, level, waiting = [], [], [], 0
        if waiting:
            yield np.concatenate(a), np.concatenate(b), np.concatenate(level)


def likely_rows(tokens: int, least: int):
    """mapInArrow function over the rows of block_pairs() with a payload ``fine`` (one byte of each of ``tokens`` MinHash
    values) and ``nodes`` (all nodes of the member): those that have a likely partner. So what it returns never exceeds what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_blocks(batches):
            keep = np.zeros(rows.num_rows, bool)
            for i, j, _ in _likely(rows, at, tokens, least):
                keep[i] = keep[j] = True
            if keep.any():
                yield rows.filter(pa.array(keep))

    return run


def likely_links(tokens: int, least: int, percent: int):
    """mapInArrow function over the rows of likely_rows() with their sorted ``shingles``, sorted by (node, p, q): links (a, b), confirmed on the
    sets, that join all that the links of all likely pairs join. The likeliest pairs come first, and pairs that are joined by then are left
    out, so a task returns fewer links than it has components, however many pairs it compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for rows, at in whole_blocks(batches, SET_ROWS):
            ids, comp = np.asarray(rows.column(3)), np.asarray(rows.column(4)).tolist()
            values, spots = np.asarray(rows.column(10).flatten()), np.asarray(rows.column(10).offsets)
            spots = spots - spots[0]
            sets = [values[lo:hi] for lo, hi in zip(spots[:-1], spots[1:], strict=True)]
            links = []
            for i, j, agree in _likely(rows, at, tokens, least):
                order = np.argsort(-agree, kind="stable")
                for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    if (left := find(comp[x])) == (right := find(comp[y])):
                        continue
                    n = len(sets[x]) + len(sets[y])
                    if 100 * min(len(sets[x]), len(sets[y])) < percent * max(len(sets[x]), len(sets[y])):
                        continue
                    both = np.sort(np.concatenate([sets[x], sets[y]]))
                    shared = np.count_nonzero(both[1:] == both[:-1])
                    if 100 * shared >= percent * (n - shared):
                        parent[left] = right
                        links.append((x, y))
            if links:
                a, b = ids[[x for x, _ in links]], ids[[y for _, y in links]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def similarity_components(
    members: DataFrame,
    levels: int,
    plausible: Callable[[str, str], Column],
    carried: list[str],
    verify: Callable[[DataFrame], DataFrame],
    settle: Callable[[DataFrame], DataFrame],
    centre: Callable[[DataFrame], DataFrame] | None = None,
    thin: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Verified links and components of members that meet in candidate nodes.

    ``members``: ``id`` long, ``rank`` (the least one of a node is its pivot), ``paths`` array<array<long>> (for
    each tree the node keys by level) and the ``carried`` columns, from which ``plausible(prefix_a, prefix_b)``
    makes a cheap necessary condition. ``verify`` takes distinct pairs ``(a, b)``, a < b, and returns those that
    are links. ``centre`` maps the rows of large nodes (node, id and carried columns) to one central member of
    each, as ``(node, c_id, c_<carried>)``. ``settle`` maps rows (node, id, comp) to verified links that join all that similar pairs of different
    components within a node join. Without ``thin`` the members' nodes are known
    to be shared, so that no count goes before.

    Nodes are branched level by level while they hold over SMALL_NODE members. Every node first yields
    links to its pivot, a large one also to its centre (as many pairs as members); once those are verified
    and joined to components, every node that still holds several components is compared exhaustively across
    them, in pairs of blocks (block_pairs()), so that no task holds a node. So a group of k copies costs about k verifications, not k squared, and no pair of different
    components that similar pairs join is left apart. Returns ``(links(a, b), components(id, comp))``; members without link are in neither.
    """
    keys = [f"k{i}" for i in range(levels)]
    rows = members.select("id", "rank", *carried, F.explode("paths").alias("p")).select(
        "id", "rank", *carried, *[F.get("p", F.lit(i)).alias(k) for i, k in enumerate(keys)]
    )
    final: list[DataFrame] = []
    written: list[DataFrame] = []
    pairs: DataFrame | None = None
    for level, key in enumerate(keys):
        rest = keys[level + 1 :]
        if level == 0 and thin:  # most rows are alone in their node and go before anything heavier than a count
            repeated = rows.groupBy(key).agg(F.count("*").alias("node_n")).where("node_n > 1").select(key)
            rows = may_be_in(rows, F.col(key), repeated, key)
        nodes = rows.groupBy(key).agg(F.count("*").alias("node_n"), F.min(F.struct("rank", "id", *carried)).alias("p")).where("node_n > 1")
        nodes = nodes.select(key, "node_n", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ["id", *carried]])
        met = rows.join(nodes, key)
        hit = (F.col("id") != F.col("p_id")) & plausible("", "p_")
        met = cut(met.select(F.col(key).alias("node"), "node_n", "id", "rank", *carried, *rest, F.when(hit, F.col("p_id")).alias("star")), "nodes")
        written.append(met)
        stars = met.where("star is not null").select(F.col("star").alias("a"), F.col("id").alias("b"))
        pairs = stars if pairs is None else pairs.union(stars)
        big = met.where(F.col("node_n") > SMALL_NODE)
        if centre is not None:
            middle = big.join(centre(big.select("node", "id", *carried)), "node")
            pairs = pairs.union(middle.where((F.col("id") != F.col("c_id")) & plausible("", "c_")).select(F.col("c_id").alias("a"), F.col("id").alias("b")))
        here = met if level == levels - 1 else met.where(F.col("node_n") <= SMALL_NODE)
        final.append(here.select("node", "id", *carried))
        rows = big.select("id", "rank", *carried, *rest)
    tried = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    written.append(tried)
    links = cut(verify(tried), "links")
    comps = cut(connected_components(links), "comps")

    leaves = final[0]
    for f in final[1:]:
        leaves = leaves.union(f)
    held = leaves.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = held.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node")
    held = cut(held.join(mixed, "node").select("node", "id", "comp").dropDuplicates(["node", "id"]), "leaves")
    more = cut(settle(held), "links")
    discard(held)
    if not more.isEmpty():
        links = links.union(more)
        comps = cut(connected_components(links), "comps")
    discard(*written)
    return links, comps

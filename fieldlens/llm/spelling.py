"""Spelling variants: words that differ by one letter, found in a trie of letter-group counts.

The alphabet is dealt into groups, and a word becomes the vector of how many letters of each group it has. One inserted letter
is a surplus of one in a group, one deleted letter a deficit, and one replaced letter both or neither. So all words near a word
lie on trie paths that leave its own counts by one up and one down at most; a depth-first search spends that budget, and
the words at its leaves are compared letter by letter.

The top levels of the trie are dealt over tasks: each node is a unit of work, which its neighbours within the budget send
their words to. Of two nodes the smaller one sends. A node with very many words is split into blocks, and so are the words
that are sent to it, so that no task holds more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm._spark import cut, discard, small_batches

#: Letter groups, which are the levels of the trie.
GROUPS = 12
#: Words of a node in one task, and words sent to it at a time.
NODE_WORDS, SENT_WORDS = 5_000, 20_000
#: Trie nodes that a search holds before it goes deeper with a part of them.
FRONTIER = 1 << 17
#: Letters compared at a time.
LETTERS = 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(docs: DataFrame, shortest: int = 7, least: int = 2, drop_every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``shortest`` letters (runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z) that are said at least
    ``least`` times. Where the crc32 of doc_id:word is a multiple of ``drop_every``, that word has lost the letter at crc32 % length in that
    document (None: no word loses one). Null texts have no words, null ids count as empty text."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{shortest},}})"), 1))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text")).select("doc", run.alias("run"))
    word = F.col("run")
    runs = runs.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each of 256 letters: the most frequent letters first, each into the group that has the fewest so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().where(F.col("c") != "")
    weight, group = np.zeros(GROUPS, np.int64), np.zeros(256, np.int64)
    for r in sorted(letters.collect(), key=lambda r: (-r["count"], r.c)):  # the alphabet has 90 letters
        to = int(np.argmin(weight))
        group[ord(r.c)] = to
        weight[to] += r["count"]
    return group


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, one byte each, and their offsets."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def vectors(words: list[str], group: np.ndarray) -> np.ndarray:
    """[words, groups] counts."""
    data, at = _letters(words)
    of = np.repeat(np.arange(len(words)), np.diff(at))
    return np.bincount(of * GROUPS + group[data], minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def within_one(words: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether word i and other j differ by exactly one inserted, deleted or replaced letter."""
    (data, at), (other, other_at) = words, others
    size, other_size = at[i + 1] - at[i], other_at[j + 1] - other_at[j]
    out = np.zeros(len(i), bool)
    close = np.flatnonzero(np.abs(size - other_size) <= 1)
    order = close[np.lexsort((other_size[close], size[close]))]
    kind = size[order] * 3 + other_size[order] - size[order]
    for lo, hi in _runs(kind):
        short = max(1, int(min(size[order[lo]], other_size[order[lo]])))
        same = size[order[lo]] == other_size[order[lo]]
        for k in range(lo, hi, max(1, LETTERS // short)):
            rows = order[k : min(hi, k + max(1, LETTERS // short))]
            a, b = at[i[rows]], other_at[j[rows]]
            step = np.arange(short)
            front = data[a[:, None] + step] == other[b[:, None] + step]
            if same:
                out[rows] = (~front).sum(1) == 1
                continue
            shift, other_shift = int(size[rows[0]]) - short, int(other_size[rows[0]]) - short
            back = data[a[:, None] + step + shift] == other[b[:, None] + step + other_shift]
            first = np.where(front.all(1), short, front.argmin(1))
            last = np.where(back.all(1), short, back[:, ::-1].argmin(1))
            out[rows] = first + last >= short
    return out


def _runs(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(ids):
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


class Trie:
    """The levels below ``top`` over the words of one node."""

    def __init__(self, words: list[str], group: np.ndarray, top: int) -> None:
        v = vectors(words, group)[:, top:]
        self.base = int(v.max(initial=0)) + 3
        order = np.lexsort(v.T[::-1]) if v.shape[1] else np.arange(len(v))
        self.words, self.letters, self.group, self.top = [words[k] for k in order], _letters([words[k] for k in order]), group, top
        node, self.children = np.zeros(len(v), np.int64), []
        for level in v[order].T:
            keys, node = np.unique(node * self.base + level, return_inverse=True)
            self.children.append(keys)
        self.leaf = np.searchsorted(node, np.arange(node.max(initial=0) + 2))

    def near(self, words: list[str], surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, member) of all pairs within one letter, with so much of the budget of each word left."""
        counts, letters = vectors(words, self.group)[:, self.top :], _letters(words)
        start = np.arange(len(words))
        stack = [(0, start, np.zeros(len(words), np.int64), surplus.astype(bool), deficit.astype(bool))]
        while stack:
            level, word, node, up, down = stack.pop()
            if len(word) > FRONTIER:
                half = len(word) // 2
                stack += [(level, word[half:], node[half:], up[half:], down[half:]), (level, word[:half], node[:half], up[:half], down[:half])]
                continue
            if level == len(self.children):
                yield from self._leaves(letters, word, node)
                continue
            own, keys, found = counts[word, level], self.children[level], []
            for step, may in ((0, np.ones(len(word), bool)), (1, up), (-1, down)):
                value = own + step
                may = may & (value >= 0) & (value < self.base)
                want = node[may] * self.base + value[may]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                rows = np.flatnonzero(may)[hit]
                found.append((word[rows], at[hit], up[rows] & (step != 1), down[rows] & (step != -1)))
            word, node, up, down = (np.concatenate(c) for c in zip(*found))
            if len(word):
                stack.append((level + 1, word, node, up, down))

    def _leaves(self, letters, word, node) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = self.leaf[node + 1] - self.leaf[node]
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(word):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FRONTIER, "right")))
            size = sizes[lo:hi]
            i = np.repeat(word[lo:hi], size)
            j = np.repeat(self.leaf[node[lo:hi]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            good = within_one(letters, self.letters, i, j)
            yield i[good], j[good]
            lo = hi


def _search(group: np.ndarray, top: int):
    """Rows come by unit, a unit's members first: one pair a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members, trie, size = None, {}, None, {}
        for batch in batches:
            units = np.asarray(batch.column("node").dictionary_encode().indices), np.asarray(batch.column("i")), np.asarray(batch.column("j")), np.asarray(batch.column("sent"))
            change = np.zeros(batch.num_rows, np.int64)
            for u in units:
                change[1:] |= u[1:] != u[:-1]
            for lo, hi in _runs(np.cumsum(change)):
                part = batch.slice(lo, hi - lo)
                here = (part.column("node")[0].as_py(), part.column("i")[0].as_py(), part.column("j")[0].as_py())
                if here != unit:
                    unit, members, trie = here, {}, None
                words, n = part.column("word").to_pylist(), part.column("n").to_pylist()
                if not part.column("sent")[0].as_py():
                    members.update(zip(words, n))
                    continue
                if not members:
                    continue
                trie = trie or Trie(list(members), group, top)
                own = np.asarray(part.column("own"))
                for i, j in trie.near(words, np.asarray(part.column("up")), np.asarray(part.column("down"))):
                    rows = [(a, b) for a, b in zip(i.tolist(), j.tolist()) if not own[a] or words[a] < trie.words[b]]
                    if rows:
                        pairs = [(words[a], n[a], trie.words[b], members[trie.words[b]]) for a, b in rows]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs)], ["a", "n_a", "b", "n_b"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two of the distinct ``words`` (word, n), of letters up to U+00FF, that differ by exactly one letter, once."""
    spark = words.sparkSession
    small_batches(spark)
    group = letter_groups(words)
    total = words.count()
    top = min(GROUPS, max(3, math.ceil(math.log(max(1, total / NODE_WORDS), 2.5))))

    def placed(batches):
        for batch in batches:
            v = vectors(batch.column(0).to_pylist(), group)[:, :top]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([",".join(map(str, r)) for r in v.tolist()], pa.string())], ["word", "n", "node"])

    def neighbours(batches):
        for batch in batches:
            for node, count in zip(*(c.to_pylist() for c in batch.columns)):
                own = list(map(int, node.split(",")))
                rows = [(node, count, node, 1, 1, True)]
                for i in [None, *range(top)]:
                    for j in [None, *range(top)]:
                        if i != j and (j is None or own[j]):
                            to = [c + (k == i) - (k == j) for k, c in enumerate(own)]
                            rows.append((node, count, ",".join(map(str, to)), int(i is None), int(j is None), False))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["from", "n_from", "node", "up", "down", "own"])

    held = cut(words.select("word", "n").mapInArrow(placed, "word string, n long, node string"), "spelling-words")
    nodes = held.groupBy("node").agg(F.count("*").alias("size"))
    links = nodes.mapInArrow(neighbours, "from string, n_from long, node string, up int, down int, own boolean").join(nodes, "node")
    links = cut(links.where(F.col("own") | (F.struct("n_from", "from") < F.struct("size", "node"))), "spelling-links")
    units = links.groupBy("node").agg(F.first("size").alias("size"), F.sum("n_from").alias("sent_to"))
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    units = units.select("node", parts("size", NODE_WORDS).alias("blocks"), parts("sent_to", SENT_WORDS).alias("turns"))
    spread = lambda seed, parts: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(parts)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = held.join(units, "node").select("node", spread(1, "blocks").alias("i"), "turns", "word", "n").select("node", "i", upto("turns").alias("j"), "word", "n")
    members = members.select("node", "i", "j", F.lit(False).alias("sent"), "word", "n", F.lit(0).alias("up"), F.lit(0).alias("down"), F.lit(False).alias("own"))
    way = links.join(units, "node").select("node", "from", "up", "down", "own", "blocks", "turns")
    sent = held.withColumnRenamed("node", "from").join(way, "from").select("node", spread(2, "turns").alias("j"), "blocks", "word", "n", "up", "down", "own")
    sent = sent.select("node", upto("blocks").alias("i"), "j", F.lit(True).alias("sent"), "word", "n", "up", "down", "own")
    work = members.unionByName(sent).repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "sent")
    pairs = cut(work.mapInArrow(_search(group, top), "a string, n_a long, b string, n_b long"), "spelling-pairs")
    discard(held, links)
    return pairs


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Every one of the distinct ``words`` (word, n) with: form, its near word of the largest n (ties: the smallest by code points) if that is at least
    ``times`` its own n, else null; form_n; n_near, how many words are near it; root, the word that its forms lead to.

    Words are near if they differ by exactly one inserted, deleted or replaced letter. No words give no rows. A form has ``times`` the
    word's n, so chains are short: each round of the loop doubles how far a word has come.
    """
    if times < 2:
        raise ValueError("times is 2 at least")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p"))
    best = both.select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has_form = -F.col("best.less") >= times * F.col("n")
    found = words.select("word", "n").join(best, "word", "left").select(
        "word", F.when(has_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.less")).alias("form_n")
    )
    found = cut(found, "spelling-forms")
    discard(pairs)
    far = cut(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(far.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(far)
        far = step.select("word", "root")
        far._fieldlens_path = step._fieldlens_path
        if not step.where("moved").limit(1).count():
            break
    return found.join(far, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants() of the words of all documents."""
    words = cut(words_of(docs), "spelling-vocabulary")
    return variants(words)

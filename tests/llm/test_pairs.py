"""Near-duplicates, line dedup and decontamination against brute force, with their edge cases."""

import random
import re
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import _graph, decontaminate, line_dedup, near_dedup
from fieldlens.llm._graph import block_pairs, connected_components

WORDS = [f"w{i}" for i in range(4000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def roots(n, links):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def shingles(text, k, short=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w and short else set()


def corpus():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(3, 200))) for _ in range(60)]
    base = rng.choices(WORDS, k=150)
    for n in range(90):  # one large group of edited copies: linked to the base, mostly not to one another
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    chain = rng.choices(WORDS, k=120)
    for _ in range(5):  # a chain whose ends aren't similar
        texts.append(" ".join(chain))
        chain = chain[8:] + rng.choices(WORDS, k=8)
    texts += [texts[0], texts[0].upper(), "one two", "one  two", "one", "", " \n "]
    return dict(enumerate(texts))


def test_near_duplicates_match_brute_force(spark):
    docs = corpus()
    sets = {i: shingles(t, 4) for i, t in docs.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(docs, links)
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in docs.items()], "doc_id long, text string, id int, n int, node int")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, 4, 80).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_block_pairs_bound_a_hot_node_and_lose_no_pair(spark):
    held = [(1, i, 0 if i % 3 else i) for i in range(300)] + [(2, i, 0 if i < 299 else 5) for i in range(300)] + [(3, i, i) for i in range(2)]
    df = spark.createDataFrame(held, "node long, id long, comp long")
    groups = {}
    for r in block_pairs(df, 20, spark.range(300)).collect():
        groups.setdefault((r.node, r.p, r.q), []).append(r)
    assert max(map(len, groups.values())) < 90  # before, a node was one group of 300
    met = [(k[0], a.id, b.id) for k, g in groups.items() for a in g if a.asks for b in g if b.answers and a.id != b.id]
    assert len(met) == len(set(met))
    assert {(n, frozenset(x)) for n, *x in met} >= {(n, frozenset((i, j))) for n, i, c in held for m, j, d in held if n == m and c != d}
    assert len([k for k in groups if k[0] == 2]) == 15  # one member that asks, not all against all


def test_small_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 30)
    monkeypatch.setattr(_graph, "PAIRS", 50)
    monkeypatch.setattr(_graph, "VECTOR", 8)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    test_near_duplicates_match_brute_force(spark)
    test_line_dedup_matches_brute_force(spark)


def test_near_duplicates_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F"), (7, "x " * 50_000)]
    got = sorted(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), key=str)
    by = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == 7
    assert by == {(1, 0, 1, True), (2, 0, 2, True), (None, 3, None, True), (4, 3, 4, True), (9, 3, 4, False), (7, 1, 7, True)}
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 4, 7]


def test_rows_that_share_a_doc_id_follow_their_own_text(spark):
    x = [f"x{i}" for i in range(60)]
    y = " ".join(f"y{i}" for i in range(60))
    rows = [(3, " ".join(x), 1), (5, " ".join([*x, "more"]), 2), (5, y, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, g int")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == {(3, 57, 3, True), (5, 58, 3, False), (5, 57, 5, True)}
    assert {r.g for r in near_dedup.keep_one(df, 4).collect()} == {1, 3}


def test_near_duplicates_without_sketches(spark):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got, exact = (sorted(near_dedup.near_duplicates(df, 4, exact=e).collect()) for e in (False, True))
    assert got == exact


def test_connected_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    want = roots({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.id: r.comp for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_set(line):
    s = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return {s[i : i + line_dedup.CHARS] for i in range(max(1, len(s) - line_dedup.CHARS + 1))}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 25))) for _ in range(40)]
    docs = []
    for i in range(30):
        lines = rng.choices(base, k=rng.randint(0, 6))
        for k, x in enumerate(lines):
            if rng.random() < 0.3 and len(x) > 60:
                at = rng.randrange(len(x))
                lines[k] = x[:at] + "é" + x[at + 1 :]
        docs.append((i, "\n".join(lines + [""] * (i % 3))))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (103, base[0].upper())]
    where = [(i is None, i or 0, k, x) for i, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip()]
    where.sort()
    sets = [line_set(x[3]) for x in where]
    links = [(a, b) for a, b in combinations(range(len(where)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(range(len(where)), links)
    gone = {(x[0], x[1], x[2]) for n, x in enumerate(where) if root[n] != n}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i is None, i or 0, k) not in gone) for i, t in docs}
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, key string, drops int, __key int")
    got = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: r["__lines"] for r in got} == {i: 0 if t is None else t.count("\n") + 1 for i, t in docs}
    assert all(r.key == "x" and r.drops == 1 for r in got)


def test_line_dedup_finds_isolated_pairs_at_the_threshold(spark):
    rng = random.Random(6)
    pairs = []
    while len(pairs) < 3000:
        x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80))
        at = rng.randrange(66, 70)
        y = x[:at] + "#" + x[at + 1 :]
        a, b = line_set(x), line_set(y)
        if 80 * len(a | b) <= 100 * len(a & b) < 81 * len(a | b):
            pairs.append((x, y))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).where("__dropped > 0").collect()}
    assert gone == set(range(1, 6000, 2))  # eight bands miss one pair in 300


def test_lines_that_meet_no_other_are_signed_once(monkeypatch):
    """The pass that counts bands signs each line once, equal ones together; the second signs lines in shared bands only, also where many prints share one."""
    signed, real = [], line_dedup._signatures
    monkeypatch.setattr(line_dedup, "_signatures", lambda data, starts, ends, ids: (signed.append(len(starts)), real(data, starts, ends, ids))[1])
    rng = random.Random(12)
    plain = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=120)) for _ in range(200)]
    near = ["x" * 5 + plain[0][:100] + str(i) for i in range(40)]
    texts = pa.array(["\n".join([*plain, *near, plain[3]])])
    packs = list(line_dedup._packed(9)([pa.RecordBatch.from_arrays([texts], ["text"])]))
    assert sum(signed) == 240
    found = pa.Table.from_batches(line_dedup._shared(pa.Table.from_batches(packs).sort_by("bucket").to_batches()))
    nodes, lines = (np.sort(found.column(c).drop_null().to_numpy()).view(np.uint64) for c in ("node", "line"))

    def bloom(keys):
        out = np.zeros(1 << 14, np.uint64)
        for k in keys.tolist():
            for shift in (44, 22, 0):
                spot = k >> shift & (1 << 20) - 1
                out[spot >> 6] |= np.uint64(1 << (spot & 63))
        return out, 20

    signed.clear()
    sent = SimpleNamespace(value=(bloom(nodes), bloom(lines)))
    rows = pa.Table.from_batches(line_dedup._line_rows(sent)([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), texts], ["key", "doc_id", "text"])])).to_pylist()
    assert 40 <= sum(signed) < 60 and len(rows) == 241
    assert all(r["line"] == near[r["line_no"] - 200] and len(r["bands"]) >= 10 for r in rows if 200 <= r["line_no"] < 240)


def test_pairs_of_lines_are_compared_once_and_ruled_out_only_if_unlike(monkeypatch):
    rng = random.Random(13)
    base = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.choice([9, 60, 300, 2000]))) for _ in range(60)]
    lines = base + [x[: (at := rng.randrange(len(x)))] + "#" * rng.randrange(3) + x[at + rng.randrange(4) :] for x in base for _ in range(3)]
    values, at = line_dedup._sets(pa.array(lines))
    i, j = (np.array(x) for x in zip(*combinations(range(len(lines)), 2), strict=True))
    good, may = line_dedup._similar_pairs(values, at, i, j, 80), line_dedup._possible(line_dedup._maps(values, at), np.diff(at), i, j, 80)
    short = np.diff(at) < 1000  # longer lines fill the map
    assert good.sum() > 100 and not (good & ~may).any() and (may & short[i]).sum() < 2 * good.sum()

    compared, real = [], line_dedup._similar_pairs
    monkeypatch.setattr(line_dedup, "_similar_pairs", lambda v, a, i, j, p: (compared.append(len(i)), real(v, a, i, j, p))[1])
    near = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200))] * 30
    near = [x + str(k) for k, x in enumerate(near)]
    rows = near + [x for x in base if len(x) == 300]
    n, zero = len(rows), pa.array([0] * len(rows), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n), zero, zero, pa.array(range(n)), pa.array(range(n)), pa.array([[1, 2, 3]] * n), pa.array(rows)], ["unit", "p", "q", "id", "comp", "bands", "line"])
    links = pa.Table.from_batches(line_dedup._settled(80)([batch])).to_pylist()
    root = roots(range(n), [(r["a"], r["b"]) for r in links])
    assert len({root[k] for k in range(30)}) == 1 and len(set(root.values())) == n - 29 and len(links) == 29 and sum(compared) < 2 * n


def test_line_dedup_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "same line here\nsame line here"), (1, "same line here\nsame line here"), (2, "same line here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == [(1, "same line here"), (1, "same line here"), (2, "")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def item_shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower(), re.A)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = {i: " ".join(rng.choices(WORDS, k=n)) for i, n in enumerate([4, 5, 9, 14, 30, 57, 57, 120, 700])}
    docs = {}
    for d in range(80):
        w = rng.choices(WORDS, k=rng.choice([0, 3, 50, 400, 6000]))
        for _ in range(rng.randint(0, 2)):
            passage = items[rng.randrange(len(items))].split()
            for _ in range(rng.choice([0, 0, 1, len(passage) // 20])):
                passage[rng.randrange(len(passage))] = "zzz"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in passage]
        docs[d] = " ".join(w)
    want = set()
    for d, t in docs.items():
        own = item_shingles(t)
        want |= {(d, i, len(own & s), len(s)) for i, x in items.items() if (s := item_shingles(x)) and 100 * len(own & s) >= 80 * len(s)}
    assert len(want) > 40
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(None, items[5], 1), (900, None, 1)], "doc_id long, text string, token int")
    bench = spark.createDataFrame([*items.items(), (50, None), (51, ""), (None, items[5])], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - len({w[0] for w in want})


@pytest.mark.parametrize("n_docs,n_items", [(0, 1), (1, 0), (0, 0)])
def test_decontamination_of_empty_tables(spark, n_docs, n_items):
    docs = spark.createDataFrame([(1, "a b c d e f")] * n_docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")] * n_items, "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0


def test_items_of_one_to_three_shingles_are_found_wherever_they_stand(spark):
    rng = random.Random(12)
    items = [(i, " ".join(rng.sample(WORDS, 5 + i % 3))) for i in range(400)]
    docs = []
    for i, text in items:
        filler = [rng.choice(WORDS) + "x" for _ in range(200)]
        at = (0, 100, 200)[i % 3]
        docs.append((i, " ".join([*filler[:at], text, *filler[at:]])))
    docs += [(1000 + i, " ".join(text.split()[:-1])) for i, text in items]  # all but the last word
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id < 1000} == {(i, i) for i, _ in items}
    assert not [r for r in found if r.doc_id >= 1000]


def test_likely_pairs_are_confirmed_where_they_meet():
    """A group of copies that all look alike, of which few are links, gives no more rows than it has members, and joins what links join."""
    rng, n = random.Random(14), 300
    sets = [sorted(rng.sample(range(1000 * (i % 3), 1000 * (i % 3) + 114), 100)) for i in range(n)]  # within a third, similarities about 0.78
    fine = [bytes(64)] * n
    columns = [[5] * n, [0] * n, [0] * n, list(range(n)), list(range(n)), [True] * n, [True] * n, [True] * n, fine, [[5]] * n]
    names = ["node", "p", "q", "id", "comp", "asks", "also", "answers", "fine", "nodes"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.bool_()] * 3, pa.binary(), pa.list_(pa.int64())]
    rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
    likely = list(_graph.likely_rows(64, 60)(iter([rows])))
    assert sum(b.num_rows for b in likely) == n  # 44,850 pairs before
    full = pa.RecordBatch.from_arrays([*likely[0].columns, pa.array(sets, pa.list_(pa.int64()))], [*names, "shingles"])
    found = [(a, b) for x in _graph.likely_links(64, 60, 80)(iter([full])) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    own = [set(s) for s in sets]
    links = [(a, b) for a, b in combinations(range(n), 2) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    assert len(links) > len(found) > 0 and set(found) <= set(links) and roots(range(n), found) == roots(range(n), links)

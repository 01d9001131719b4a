"""Language-model scores, spelling variants and tokenizer alignment against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldlens.llm import alignment, ngrams, spelling

SCHEMA = "doc_id long, text string, row string, word string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


def corpus(n=80, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("Ba", "ko", "le") for b in ("ri", "mu") for c in ("n", "st", "tä", "")]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))) for i in range(n)]


# --- language model -------------------------------------------------------------------------------------------------


def kneser_ney(train, order):
    """Log10 probability function of an interpolated modified Kneser-Ney model, by its definition."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end>"]
    top = Counter()
    for t in train:
        line = ["<begin>"] * (order - 1) + split(t)
        top.update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if 0 in n:
            return [0, 0.5, 1, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *d] if min(d) > 0 else [0, 0.5, 1, 1.5]

    d = {k: discounts(c) for k, c in counts.items()}
    by = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by[k][g[:-1]].append(n)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        follow = by[k][gram[:-1]] if gram[:-1] in by[k] else []
        if not follow:
            return lower
        n = counts[k][gram] if gram in counts[k] else 0
        rest = sum(d[k][min(m, 3)] for m in follow)
        return (max(n - d[k][min(n, 3)], 0) + rest * lower) / sum(follow)

    def score(t):
        line = ["<begin>"] * (order - 1) + split(t)
        return sum(math.log10(p(tuple(line[i : i + order]))) for i in range(len(line) - order + 1))

    return score, p, counts


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_those_of_the_definition(spark, order):
    docs = corpus() + [(100, None), (101, ""), (102, " \n"), (103, "unknown Words only"), (104, "BARIN barin"), (7, "repeated id"), (None, "no id")]
    train = [t for i, t in docs if i is None or i % 3]
    score, _, _ = kneser_ney(train, order)
    model = ngrams.train(frame(spark, [(i, t) for i, t in docs if i is None or i % 3]), order, bucket_bytes=4_000)
    got = Counter((r.doc_id, round(r.score, 8)) for r in ngrams.score(frame(spark, docs), model).collect())
    assert got == Counter((i, round(score(t), 8)) for i, t in docs)
    ngrams.forget(spark, model)


def test_probabilities_of_all_words_add_up_to_one(spark):
    docs = corpus(40)
    _, p, counts = kneser_ney([t for _, t in docs], 2)
    for context in ("bari", "<begin>", "never"):
        assert abs(sum(p((context, g[0])) for g in counts[1]) + p((context, "<unknown>")) - 1) < 1e-12


def test_fold_scores_and_smoothed_words(spark):
    docs = corpus(60, 9) + [(200, None), (201, "zzz")]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    split = lambda t: re.findall(r"\S+", (t or "").lower()) + ["<end>"]
    said = Counter(w for i, t in docs if not fold(i) for w in split(t))
    total = sum(said.values())
    for r in ngrams.fold_scores(frame(spark, docs)).collect():
        words = split(dict(docs)[r.doc_id])
        base = sum(math.log10((said[w] + 0.5) / (total + 0.5 * (len(said) + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id), len(words), sum(w in said for w in words), total)
        assert abs(r.base_score - base) < 1e-9


def test_model_of_nothing_and_very_long_texts(spark):
    empty = frame(spark, [])
    model = ngrams.train(empty)
    assert [(r.n_tokens, r.n_known, r.score) for r in ngrams.score(frame(spark, [(1, "a b")]), model).collect()] == [(3, 0, 0.0)]
    assert ngrams.score(empty, model).count() == 0
    long = "one two three " * 60_000
    model = ngrams.train(frame(spark, [(1, long), (2, "one")]))
    r = {r.doc_id: r for r in ngrams.score(frame(spark, [(1, long), (2, "one")]), model).collect()}
    score, _, _ = kneser_ney([long, "one"], 2)
    assert r[1].n_tokens == 180_001 and abs(r[1].score - score(long)) < 1e-6


def test_a_context_with_most_rows_is_dealt_over_buckets(spark):
    docs = [(i, " ".join(f"the w{i * 50 + k}" for k in range(50))) for i in range(100)]
    model = ngrams.train(frame(spark, docs), bucket_bytes=4_000)
    assert len(model.levels[2].hot) == 1
    score, _, _ = kneser_ney([t for _, t in docs], 2)
    assert all(abs(r.score - score(docs[r.doc_id][1])) < 1e-8 for r in ngrams.score(frame(spark, docs), model).collect())


def test_counts_above_one_byte(spark):
    docs = [(i, "a b " * 200) for i in range(5)] + [(9, "a c")]
    score, _, _ = kneser_ney([t for _, t in docs], 2)
    model = ngrams.train(frame(spark, docs))
    assert all(abs(r.score - score(dict(docs)[r.doc_id])) < 1e-8 for r in ngrams.score(frame(spark, docs), model).collect())


# --- spelling -------------------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms(words, times=10):
    out = {}
    for w, n in words.items():
        around = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        form = around[0][1] if around and -around[0][0] >= times * n else None
        out[w] = [form, w, n, len(around), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def vocabulary(seed=2, n=150):
    rng = random.Random(seed)
    letters = "abcdeflmnorstuéÀÿ"
    words = {}
    for _ in range(n):
        w = "".join(rng.choices(letters, k=rng.randint(7, 11)))
        words[w] = rng.choice([2, 3, 40, 500, 9000])
        for _ in range(6):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k] + w[k:]])
            words.setdefault(w, rng.choice([2, 3, 40, 500, 9000]))
    return words


def found(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}


def test_variants_are_those_of_all_pairs(spark):
    words = vocabulary() | {"aaaaaaa": 20_000, "aaaaaab": 2_000, "aaaaabb": 200, "aaaabbb": 20, "aaabbbb": 2, "x" * 3_000: 5, "x" * 3_001: 50}
    assert found(spark, words) == forms(words)


def test_blocks_of_crowded_nodes_find_the_same(spark, monkeypatch):
    words = vocabulary(7, 60)
    for k in range(300):  # one node of anagrams
        w = list("abcdefl")
        random.Random(k).shuffle(w)
        words["".join(w)] = k + 2
    monkeypatch.setattr(spelling, "NODE_WORDS", 40)
    monkeypatch.setattr(spelling, "SENT_WORDS", 60)
    monkeypatch.setattr(spelling, "FRONTIER", 64)
    assert found(spark, words) == forms(words)


def test_words_of_documents(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["Transport", "transport9carrier", "ÉLÉGANT-elegantly", "short", "Ünderstand", "x" * 500], k=40))) for i in range(60)] + [(70, None), (71, ""), (None, "Transport transport")]
    expect = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            expect[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    got = {r.word: r.n for r in spelling.words_of(frame(spark, docs)).collect()}
    assert got == {w: n for w, n in expect.items() if n >= 2 and len(w) >= 7}
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


# --- alignment ------------------------------------------------------------------------------------------------------


def aligned(docs):
    """Plain version, from each token's own bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/piece_bpe_32k.model")
    own, pairs = [], Counter()
    for i, t in docs:
        links, groups, ids = [], [], ([], [])
        if t:
            raw = (" " + t).encode()
            enc = a.encode(" " + t, add_special_tokens=False)
            ids = (enc.ids, b.encode(t))
            # character offsets give the bytes of A's tokens that hold whole characters; others are counted from the entry itself
            size_a = [len(e) for e in enc.tokens]  # an entry has one character for each byte
            piece = [b.id_to_piece(k) for k in ids[1]]
            size_b = [1 if re.fullmatch("<0x[0-9A-F]{2}>", p) else len(p.replace("▁", " ").encode()) for p in piece]
            back = b"".join(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in piece)
            if back != raw:
                ids = ([], [])
            else:
                ends_a, ends_b = np.cumsum(size_a).tolist(), np.cumsum(size_b).tolist()
                at = [0, 0]
                for e in sorted(set(ends_a) & set(ends_b)):
                    x, y = ends_a.index(e, at[0]) + 1, ends_b.index(e, at[1]) + 1
                    groups.append(",".join(map(str, ids[0][at[0] : x])) + "|" + ",".join(map(str, ids[1][at[1] : y])))
                    links.append((ids[0][x - 1], ids[1][y - 1]))
                    at = [x, y]
        pairs.update(links)
        own.append((i, len(ids[0]), len(ids[1]), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (x, y), n in pairs.items():
        most[y] = max(most[y], n)
    return Counter((i, n_a, n_b, len(ls), len(ls), sum(pairs[p] == most[p[1]] for p in ls), sum(pairs[p] for p in ls), sha) for i, n_a, n_b, ls, sha in own)


def texts(n=120):
    rng = random.Random(8)
    words = ["hello", "world,", "Überstraße", "naïve", "日本語", "🙂", "<s>", "<|endoftext|>", "x\ty", "a\nb", "  ", "12345", "don't", "é", "\u0000"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(n)] + [(200, None), (201, ""), (202, " "), (203, "▁x"), (5, "hello again"), (None, "hello world,")]


def counted(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_is_that_of_the_plain_version(spark):
    docs = texts() + [(300, "hello world, " * 20_000)]
    assert counted(alignment.align(frame(spark, docs))) == aligned(docs)
    assert alignment.align(frame(spark, [])).count() == 0


def test_alignment_by_many_radixes_runs_and_units(spark, monkeypatch):
    docs = texts(300)
    monkeypatch.setattr(alignment, "RADIXES", 7)
    monkeypatch.setattr(alignment, "UNIT_RECORDS", 50)
    monkeypatch.setattr(alignment, "HELD_LINKS", 300)
    monkeypatch.setattr(alignment, "STEP", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    assert counted(alignment.align(frame(spark, docs))) == aligned(docs)


def test_merge_of_runs():
    rng = np.random.default_rng(1)
    parts = [(k := np.unique(rng.integers(0, 400, rng.integers(0, 200))), rng.integers(1, 9, len(k))) for _ in range(9)]
    total = Counter()
    for k, c in parts:
        for x, n in zip(k.tolist(), c.tolist()):
            total[x] += n
    old, alignment.STEP = alignment.STEP, 7
    got = [(x, n) for k, c in alignment.merged(parts) for x, n in zip(k.tolist(), c.tolist())]
    alignment.STEP = old
    assert got == sorted(total.items())

"""Toxicity, language identification and exact search."""

import math
import random
from fractions import Fraction

import numpy as np

from fieldlens.llm import langid, topk, toxicity
from fieldlens.llm._spark import held_out


def toxic_corpus():
    """Insults alone and group mentions alone are harmless; together they are toxic. Some words are toxic alone."""
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    docs, labels = [], []
    for i in range(3000):
        text = rng.choices(words, k=rng.randint(5, 60))
        insult, group, bad = rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.1
        for flag, word in ((insult, "insultword"), (group, "groupword"), (bad, "Scumbag!")):
            if flag:
                text.insert(rng.randrange(len(text)), word)
        docs.append((i, " ".join(text)))
        labels.append((i, 0, int(bad or (insult and group))))
    return docs, labels


def test_pairs_are_learned_and_hold_out(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame([*docs, (9001, None), (9002, ""), (None, "groupword")], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(d, y).toPandas()
    assert len(out) == len(docs) + 3 and out.score.between(0, 1).all() and out.score.notna().all()
    assert ((out.score >= 0.5).astype(int) == out.predicted).all()
    m = out[out.doc_id.notna()].merge(y.toPandas().dropna(), on="doc_id")
    held = m[m.held_out]
    assert 400 < len(held) < 800
    assert (held.predicted == held.toxic).mean() > 0.97
    truth = {i: int("Scumbag" not in t and "insultword" in t and "groupword" in t) for i, t in docs}
    pairs = held[held.doc_id.map(truth) == 1]
    assert len(pairs) > 20 and pairs.predicted.mean() > 0.9  # no term of these is toxic by itself


def test_toxicity_without_two_kinds_of_labels(spark):
    d = spark.createDataFrame([(1, "a b", 7), (2, None, 7)], "doc_id long, text string, __x int")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(d, y).collect()] == [0.5, 0.5]
    assert toxicity.drop_toxic(d, spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")).columns == d.columns
    assert toxicity.toxicity(d.limit(0), y).count() == 0


def test_languages_hold_out(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "er", "ou", "sh"], "fr": ["eau", "tion", "é", "ç", "ment", "ou"], "ru": ["про", "ста", "ния", "ов", "ко", "ть"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 60))), lang))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 ...", "fr"), (1003, "thering shou", None), (None, "про ста ния", "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.detect_language(docs).toPandas()
    truth = {i: x for i, _, x in rows}
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    by = out.set_index("doc_id").lang_pred
    assert [by[i] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    held = out[out.held_out & (out.doc_id < 1000)]
    assert len(held) > 80 and (held.lang_pred == held.doc_id.map(truth)).mean() > 0.98
    assert set(langid.detect_language(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).toPandas().lang_pred) == {"und"}
    assert langid.detect_language(docs.limit(0)).count() == 0


def test_gram_vectors_bind_permuted_letters():
    v = langid.gram_vectors()
    letters = np.random.Generator(np.random.Philox(99)).choice(np.array([-1, 1], np.int8), (langid.SYMBOLS, langid.WIDTH))
    a, b, c = 3, 17, 30
    assert (v[(a * langid.SYMBOLS + b) * langid.SYMBOLS + c] == np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]).all()


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (700, 24)))]
    rows += [(700 + k, rows[3][1]) for k in range(8)]  # ties
    rows += [(650, [-9.0, None] + [0.5] * 22)]  # not usable, and less than the vector that asks
    rows += [(800, None), (801, []), (802, [1.0, None] * 12), (803, [float("nan")] * 24), (None, rows[4][1]), (850, [0.5, 0.25]), (900, [1.0, 1.0]), (10, rows[9][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    usable = [(i, np.floor(256 * np.array(np.float32(v), np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, q in usable:
        if i % 50 == 0:
            s = sorted((-int(q @ x), j) for j, x in usable if j != i and len(x) == len(q))[:5]
            want |= {(i, r, j, -v) for r, (v, j) in enumerate(s, 1)}
    got = topk.top_k(df).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(i, [float(i), -1.0]) for i in range(8)] + [(50, [3e5, 1.0]), (51, [1e30, 2.0]), (52, [-1e30, 0.0]), (53, [2.0**20, 5e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for i in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[i], v, strict=True)), j) for j, v in whole.items() if j != i)[:5]
        want += [(i, r, j, -s if s > -(1 << 63) else None) for r, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want


def test_segment_bounds_hold():
    rng = np.random.default_rng(4)
    q, c = rng.integers(-200, 200, (20, 50)), rng.integers(-200, 200, (300, 50))
    exact = q @ c.T
    last = None
    for m in topk.RESOLUTIONS:
        bound = topk.segment_statistics(q, m) @ topk.segment_statistics(c, m).T
        assert (bound >= exact - 1e-6 * np.abs(exact) - 1e-6).all()
        assert last is None or bound.mean() < last
        last = bound.mean()

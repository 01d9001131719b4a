"""The factorization machine and the hyperdimensional profiles against plain Python versions."""

import math
import random
import re
import zlib

import numpy as np

from fieldlens.llm import langid, toxicity


def machine(w, v, bias, terms):
    """Intercept, weights, and the factors' products of all pairs over the number of terms, term by term."""
    z = bias + sum(w[i] for i in terms)
    for a in range(len(terms)):
        for b in range(a + 1, len(terms)):
            z += sum(x * y for x, y in zip(v[terms[a]], v[terms[b]])) / len(terms)
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    w, v = rng.normal(0, 1, 40), rng.normal(0, 0.7, (40, toxicity.FACTORS))
    docs = [sorted(rng.choice(40, n, replace=False).tolist()) for n in (0, 1, 2, 5, 40, 17)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    model = toxicity.Model(np.arange(40, dtype=np.uint64), w, v, 0.3)
    got = model.score(np.array([i for d in docs for i in d], np.int64), at)
    assert np.allclose(got, [machine(w, v, 0.3, d) for d in docs], atol=1e-10)


def test_training_steps_are_those_of_the_gradient():
    """One epoch over one batch against numerical derivatives of the loss, with AdaGrad's first step."""
    rng = np.random.default_rng(5)
    docs = [sorted(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(60)]
    y = np.array([float(0 in d and 1 in d) for d in docs])
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = np.array([i for d in docs for i in d], np.int64)
    linear = np.arange(12) != 3
    model = toxicity.train(index, at, y, np.arange(12, dtype=np.uint64), linear, epochs=1, seed=5)
    v0 = np.random.Generator(np.random.Philox(5)).normal(0, 0.02, (12, toxicity.FACTORS))

    def loss(w, v, bias):
        p = np.array([machine(w, v, bias, d) for d in docs])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    def slope(change):
        return (loss(*change(1e-5)) - loss(*change(-1e-5))) / 2e-5

    for i in range(12):
        g = slope(lambda e, i=i: (np.eye(12)[i] * e, v0, 0.0))
        step = -0.2 * g / math.sqrt(g * g + 1e-6) if linear[i] else 0.0
        assert abs(model.weights[i] - step) < 1e-3
    for i, f in ((0, 0), (1, 3), (7, 5)):
        def moved(e, i=i, f=f):
            v = v0.copy()
            v[i, f] += e
            return np.zeros(12), v, 0.0

        g = slope(moved)
        assert abs(model.factors[i, f] - (v0[i, f] - 0.02 * g / math.sqrt(g * g + 1e-6))) < 1e-3


def profile(text, letters):
    """Sum of the bound letter trigrams of a text, gram by gram."""
    words = ["".join(c for c in w) for w in re.split("|".join(map(re.escape, sorted({c for c in text if not c.isalpha()}) or ["\0"])), text) if w]
    line = []
    for w in words:
        line += [symbol(c) for c in w] + [0]
    total = np.zeros(langid.WIDTH)
    for a, b, c in zip(line, line[1:], line[2:]):
        total += np.roll(letters[a], 2).astype(float) * np.roll(letters[b], 1) * letters[c]
    return total


def symbol(c):
    low = c.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (langid.SYMBOLS - 27)


def unit(v):
    return v / max(np.linalg.norm(v), 1e-9)


def test_languages_are_those_of_plain_profiles(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "sh", "er"], "de": ["sch", "ung", "ü", "ei"], "el": ["και", "ος", "ία", "το"]}
    rows = [(i, lang, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 12))) + rng.choice(["", "!", " 12"])) for i in range(150) for lang in [rng.choice(list(parts))]]
    rows += [(200, "en", "the " * 30_000), (201, None, None), (202, "de", "12 !"), (203, None, "the\nsher"), (None, "en", "shing"), (7, "el", "το")]
    letters = np.random.Generator(np.random.Philox(99)).choice(np.array([-1, 1], np.int8), (langid.SYMBOLS, langid.WIDTH))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    has = lambda t: any(c.isalpha() for c in t or "")
    two, three = profile("the " * 2, letters), profile("the " * 3, letters)  # each further word adds the same
    own = {(i, t): profile(t, letters) if len(t) < 50_000 else two + 29_998 * (three - two) for i, _, t in rows if has(t)}
    sums = {}
    for i, lang, t in rows:
        if lang and has(t) and not held(i):
            sums[lang] = sums.get(lang, 0) + unit(own[i, t])
    prototypes = {k: unit(sums[k]) for k in sorted(sums)}
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    text = {}
    for i, _, t in rows:
        text.setdefault(i, []).append(t)
    got = langid.detect_language(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id)
        options = []
        for t in text[r.doc_id]:
            cosines = {k: float(unit(own[r.doc_id, t]) @ p) for k, p in prototypes.items()} if has(t) else {"und": 0.0}
            best = max(cosines, key=lambda k: (cosines[k], [-ord(c) for c in k]))
            options.append((best, max(cosines[best], 0.0)))
        assert any(r.lang_pred == k and abs(r.score - s) < 1e-5 for k, s in options), (r, options)

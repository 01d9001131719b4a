"""The corpus pipeline on a small corpus with planted cases, stage by stage and as a whole."""

import random
import re

import pytest

import corpus_pipeline
from fieldlens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst" for d in ["", "ba", "ke", "lo"]]
    line = lambda n: " ".join(rng.choices(words, k=n))
    bench = {i: line(40) for i in range(5)}
    docs, labels, kind = {}, {}, {}
    for i in range(700):
        toxic = i % 9 == 0
        lines = [line(rng.randint(6, 30)) for _ in range(rng.randint(1, 5))]
        if toxic:
            w = lines[0].split()
            w[2:2] = rng.sample(["scumbag", "moronic", "trashy"], 2)
            lines[0] = " ".join(w)
        docs[i], kind[i] = "\n".join(lines), "toxic" if toxic else "clean"
        if i % 4:
            labels[i] = int(toxic)
    for k in range(10):
        docs[1000 + k], kind[1000 + k] = docs[1 + k * 9 + 1], "copy"
        w = line(120).split()
        w[50:50] = bench[k % 5].split()
        docs[1100 + k], kind[1100 + k] = " ".join(w), "leak"
        base = line(150).split()
        docs[1200 + 2 * k], kind[1200 + 2 * k] = " ".join(base), "clean"
        base[70] = "edited"
        docs[1201 + 2 * k], kind[1201 + 2 * k] = " ".join(base), "near"
    docs |= {1500: None, 1501: "", 1502: " \n "}
    kind |= {1500: "clean", 1501: "clean", 1502: "clean"}
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, kind


def test_stages_keep_columns_and_do_their_part(spark, corpus):
    path, _, kind = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {"start": {r.doc_id for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, path), name)
        assert docs.columns == columns + (["copies", "taken"] if name == "mixing" else [])
        seen[name] = {r.doc_id for r in docs.collect()}
    of = lambda k: {i for i, x in kind.items() if x == k}
    assert not seen["toxicity"] & of("toxic") and len(of("clean") - seen["toxicity"]) <= 2
    assert not seen["line_dedup"] & (of("copy") | of("near")) and of("clean") & seen["toxicity"] <= seen["line_dedup"]
    assert seen["near_dedup"] == seen["line_dedup"]
    assert seen["near_dedup"] - seen["decontamination"] == of("leak")
    assert seen["mixing"] <= seen["decontamination"]


def test_run_equals_brute_force_after_the_learned_stage(spark, corpus):
    path, docs, kind = corpus
    learned = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    left = {i: t for i, t in docs.items() if i in learned and kind[i] not in ("copy", "near", "leak")}  # what the planted cases ask for
    df = spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in left.items()], SCHEMA)
    want = {r.doc_id: (r.copies, r.taken) for r in mixing.mix_sources(df).collect() if r.copies}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: (r.copies, r.taken) for r in got} == want and len(got) == len(want)
    assert all(r.text == left[r.doc_id] and r.taken == r.copies * len(re.findall(r"\S+", r.text or "")) for r in got)


def test_near_duplicates_stay_once(spark, corpus):
    path, _, kind = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, path).collect()}
    assert {i for i in kind} - kept == {i for i, k in kind.items() if k in ("copy", "near")}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_cope_with_clashing_names_nulls_and_repeats(spark, tmp_path):
    names = ["__text", "__gone", "__key", "__spot", "__bits", "row", "key", "drops", "set_id", "__score", "copies"]
    line = "one line that several documents share, of some length"
    texts = [line, line, None, "", "x" * 30_000 + " " + line, "\n".join([line, "another line of a fair length, told once"]), line]
    rows = [(i, t, "en", None if i % 3 else "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)] + [(None, "text of no document id", None, "s", 1, *names)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` string" for n in names))
    spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these words is in any document at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        for r in out.collect():
            assert all(r[n] == (n if r.doc_id is None else f"{n}{r.doc_id}") for n in names), name

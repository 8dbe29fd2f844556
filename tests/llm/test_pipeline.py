from __future__ import annotations

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    kept = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/substring_dedup").collect()}
    assert all(r.n_chars == len(r.text) for r in kept.values())
    pieces = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in pieces} == set(kept) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_run_gives_the_rows_of_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_odd_rows(spark, sf_dir):
    rows = [(None, "text of no id", "en", "s", 1, "x", 7), (1, None, None, None, None, None, 7), (1, "", "en", "s", 0, "x", 7), (2, "a b c", "en", "s", 5, "y", 7), (2, "a b c", "en", "s", 5, "y", 8)]
    columns = ["doc_id", "text", "lang", "source", "n_chars", "kept", "_text"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, _text long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id = 2").count() == (2 if name == "toxicity" else 1)
        assert docs.where("_text not in (7, 8)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and {r.doc_id for r in pieces} == {None, 1, 2}


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out if name != "packing" else docs


def test_stages_against_brute_force(spark):
    """Planted documents through the three filtering stages: what goes, what stays, and what is cut."""
    import random

    chance = random.Random(4)
    fresh = lambda n: " ".join(f"w{chance.randrange(10**6)}" for _ in range(n))
    base, passage = fresh(200), fresh(60)
    near = base.split()
    near[100] = "other"
    texts = {1: base, 2: base, 3: " ".join(near), 4: f"{fresh(30)} {passage} {fresh(30)}", 5: f"{fresh(20)} {passage} {fresh(20)}", 6: fresh(80), 7: "", 8: None}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], schema)
    stages = dict(corpus_pipeline.STAGES)
    deduped = stages["near_dedup"](spark, docs, "").cache()
    assert {r.doc_id for r in deduped.collect()} == {1, 4, 5, 6, 7}
    out = {r.doc_id: r.text for r in stages["substring_dedup"](spark, deduped, "").collect()}
    words = {i: (texts[i] or "").split() for i in out}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for at in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][at : at + 13]), i)
    for i, w in words.items():
        gone = {j for at in range(len(w) - 12) if first[tuple(w[at : at + 13])] < i for j in range(at, at + 13)}
        assert out[i] == (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else texts[i])
    assert len(out[5].split()) == 40

"""The corpus pipeline: every stage and run() against plain versions, and stages on odd, empty and repeated rows."""

import numpy as np
import pandas as pd
import plain
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables():
    return {name: pd.read_parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels", "benchmark")}


def plain_quality(docs, tables):
    from arbora.llm import quality_gam

    x = {d: plain.features(t) for d, t in zip(docs.doc_id, docs.text)}
    labels = tables["labels"]
    y = {d: q for d, q in zip(labels.doc_id, labels.quality) if d in x}
    model = quality_gam.fit(np.array([x[d] for d in sorted(y)]), np.array([y[d] for d in sorted(y)], float))
    return docs[[plain.additive_score(model, x[d]) >= 0.5 for d in docs.doc_id]]


def plain_near(docs, tables):
    found = plain.components(list(zip(docs.doc_id, docs.text)))
    return docs[[found[d][1] == d for d in docs.doc_id]]


def plain_clean(docs, tables):
    bench = tables["benchmark"]
    hit = {d for d, _ in plain.leaks(list(zip(docs.doc_id, docs.text)), list(zip(bench.item_id, bench.text)))}
    return docs[~docs.doc_id.isin(hit)]


def plain_masked(docs, tables):
    def mask(text):
        hidden, out = plain.secret_positions(text), []
        for p, c in enumerate(text):
            if p not in hidden:
                out.append(c)
            elif p - 1 not in hidden:
                out.append("[SECRET]")
        return "".join(out)

    out = docs.assign(text=[mask(t) for t in docs.text])
    return out.assign(n_chars=[len(t) for t in out.text])


def plain_tokens(docs, tables):
    encoder = plain.tokenizer()
    ids = [tuple(encoder.encode_ordinary(t)) for t in docs.text]
    return docs[["doc_id", "lang", "source"]].assign(ids=ids, n_tokens=[len(i) for i in ids])


PLAIN = [plain_quality, plain_near, plain_clean, plain_masked, plain_tokens]


def rows(frame):
    return sorted(tuple(tuple(v) if isinstance(v, (list, np.ndarray)) else v for v in r) for r in frame.itertuples(index=False))


def test_every_stage_and_run(spark, tables):
    import corpus_pipeline

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    docs, left = tables["documents"], []
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, PLAIN):
        source = spark.createDataFrame(docs)
        got, want = stage(spark, source, SF).toPandas(), by_hand(docs, tables)
        assert list(got.columns) == list(want.columns), name
        assert rows(got) == rows(want), name
        left.append(len(want))
        docs = want
    assert len(tables["documents"]) > left[0] > left[1] > left[2] == left[4]
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert rows(whole) == rows(docs)


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = "the cat and the dog of the house are in a garden with an apple and a pear tree near the old wall by the sea"
    data = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, good, "en", "s", 9), (3, good, "en", "s", 9), (3, good + " again", "en", "s", 9), (None, good, "en", "s", 9), (4, good + " password: hunter2hunter2", "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(3, 1, 0), (99, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is a question of forty. an answer"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (data, []):
        docs = spark.createDataFrame(some, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, str(tmp_path)).collect()
            if k < 4:
                assert stage(spark, docs, str(tmp_path)).columns == COLUMNS, name
            if not some:
                assert got == [], name
    docs = spark.createDataFrame(data, schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, good), (1, ""), (2, ""), (3, good)]
    masked = corpus_pipeline.secrets(spark, docs, str(tmp_path)).collect()
    assert {r.text for r in masked if r.doc_id == 4} == {good + " [SECRET]"} and {r.n_chars for r in masked if r.doc_id == 4} == {len(good) + 9}
    assert {r.n_tokens for r in corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect() if r.doc_id in (1, 2)} == {0}
    clash = docs.withColumn("id", docs.text).withColumn("shingles", docs.text).withColumn("k", docs.text)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        assert stage(spark, clash, str(tmp_path)).columns == [*COLUMNS, "id", "shingles", "k"], name

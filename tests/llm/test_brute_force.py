"""Each query without an SQL twin against a plain version of its contract, on whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import plain
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def run(spark, name, sf=SF):
    from arbora.llm import queries

    return queries.queries()[name](spark, sf).toPandas()


def test_quality_rules(spark, docs):
    got = run(spark, "op2_quality_rules").set_index("doc_id")
    assert len(got) == len(docs)
    for d, t in zip(docs.doc_id, docs.text):
        r, want = got.loc[d], plain.rules(t)
        assert tuple(r[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want, d
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed
        assert not (failed and r.kept)


def test_quality_ratio(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    got = run(spark, "op2_quality_rules", "/root/testdata/sf0.001").set_index("doc_id")
    llr = plain.ratios(list(docs.text))
    for d, t in zip(docs.doc_id, docs.text):
        want, r = llr(t), got.loc[d]
        assert r.llr == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and round(want, 9) >= -0.3)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_quality_rules_part_labels(spark, sf):
    got = run(spark, "op2_quality_rules", sf).merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    judged = got[~got.base_failed]
    good, junk = judged[judged.quality == 1], judged[judged.quality == 0]
    assert len(good) and len(junk)
    assert good.kept.mean() >= 0.99  # recall
    assert judged[judged.kept].quality.mean() >= 0.99  # precision
    assert junk.kept.mean() <= 0.1


def test_near_dedup(spark, docs):
    got = run(spark, "op3_near_dedup").set_index("doc_id")
    want = plain.components(list(zip(docs.doc_id, docs.text)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.iterrows()} == want
    assert (got.kept == (got.index == got.component_id)).all()
    assert got.kept.sum() < len(got)


def test_quality_gam_held_out(spark, docs):
    got = run(spark, "op4_quality_gam")
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]
    both = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert got.score.between(0, 1).all() and len(got) == len(docs)


def test_quality_gam_scores(spark):
    from arbora.llm import quality_gam

    sf = "/root/testdata/sf0.001"
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    x = {d: plain.features(t) for d, t in zip(docs.doc_id, docs.text)}
    y = {d: q for d, q in zip(labels.doc_id, labels.quality) if zlib.crc32(str(d).encode()) % 3 != 1 and d in x}
    model = quality_gam.fit(np.array([x[d] for d in sorted(y)]), np.array([y[d] for d in sorted(y)], float))
    got = run(spark, "op4_quality_gam", sf).set_index("doc_id")
    for d in x:
        want = plain.additive_score(model, x[d])
        assert got.loc[d].score == pytest.approx(want, abs=1e-6)
        assert got.loc[d].predicted == (got.loc[d].score >= 0.5)


def test_trees_against_every_cut():
    from arbora.llm import quality_gam

    rng = np.random.default_rng(4)
    gain_of = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(40):
        k = int(rng.integers(2, 9))
        g, h, n = rng.normal(0, 3, k), rng.uniform(0.5, 3, k), rng.integers(0, 12, k)
        ok = [c for c in range(1, k) if n[:c].sum() >= quality_gam.LEAST and n[c:].sum() >= quality_gam.LEAST]
        want = max(((gain_of(g[:c], h[:c]) + gain_of(g[c:], h[c:]) - gain_of(g, h), c) for c in ok), default=(0.0, -1))
        got = quality_gam._split(g, h, n)
        assert got[1] == want[1] and got[0] == pytest.approx(want[0])


def plain_article(page):
    import html

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_html_extract(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = run(spark, "op5_html_extract").set_index("page_id")
    for p, h in zip(pages.page_id, pages.html):
        assert got.loc[p].text == plain_article(h)
        assert got.loc[p].n_chars == len(got.loc[p].text)


def test_byte_bpe(spark, docs):
    encoder = plain.tokenizer()
    got = run(spark, "op7_byte_bpe").set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        ids = encoder.encode_ordinary(t or "")
        r = got.loc[d]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_lang_id_held_out(spark, docs):
    got = run(spark, "op8_lang_id").merge(docs, on="doc_id")
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]
    held = got[got.held_out & got.text.str.len().gt(40)]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_lang_id_scores(spark):
    from arbora.llm import lang_id

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    model = lang_id.train(docs, "doc_id", "text", "lang")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").where("doc_id % 10 = 0").collect()}
    for r in lang_id.predict_language(docs.where("doc_id % 10 = 0"), model).collect():
        if r.lang_pred == "und":
            continue
        want = plain.language_probabilities(model, texts[r.doc_id])
        assert r.score == pytest.approx(want.max(), abs=1e-4)
        assert want[model.languages.index(r.lang_pred)] >= want.max() - 1e-4


def test_secret_scan(spark, docs):
    got = run(spark, "op9_secret_scan").set_index("doc_id")
    total = 0
    for d, t in zip(docs.doc_id, docs.text):
        want, r = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in plain.base_secrets(t or "")], got.loc[d]
        total += len(want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {p for _, a, b in spans for p in range(int(a), int(b))} == plain.secret_positions(t or ""), d
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == want
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
    assert total


def test_decontaminate(spark, docs):
    norm = lambda s: " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", s.lower()))
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    items = [(i, f" {norm(t)} ") for i, t in zip(bench.item_id, bench.text)]
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for n in [f" {norm(t)} "] for i, x in items if x in n}
    got = run(spark, "op10_decontaminate")
    assert want and want == set(zip(got.doc_id, got.item_id))
    every = plain.leaks(list(zip(docs.doc_id, docs.text)), list(zip(bench.item_id, bench.text)))
    for r in got.itertuples():
        assert (r.score, r.question_overlap, r.answer_overlap) == pytest.approx(every.pop((r.doc_id, r.item_id)), abs=1e-8)
    assert not every

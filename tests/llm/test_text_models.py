"""Language spans, quality rules and toxicity."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from isoreach.llm import langid, quality, toxicity
from isoreach.llm.queries import op2_viterbi_spans, op3_divergence, op4_factorization_machine

SF = "/root/testdata/sf0.01"


def naive_path(scores, penalty):
    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, k] for i, k in enumerate(best)) - penalty * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    n = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(0, 2, (int(n.sum()), 3)).astype(np.float32)
    label = langid.viterbi(scores, n, 1.5)
    for a, b in zip(np.cumsum(n) - n, np.cumsum(n)):
        own = label[a:b]
        got = sum(scores[a + i, k] for i, k in enumerate(own)) - 1.5 * int((np.diff(own) != 0).sum())
        assert b == a or got == pytest.approx(naive_path(scores[a:b], 1.5), abs=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    words = {"en": ["the", "house", "with", "water", "three", "night"], "de": ["und", "nicht", "straße", "über", "zwischen", "schön"], "ru": ["вода", "ночь", "дом", "между", "красиво"]}
    rows = [(" ".join(rng.choice(words[k]) for _ in range(60)), k) for k in words for _ in range(20)] + [(None, "en"), ("no label", None)]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_mixed_text_gets_spans(spark, model):
    text = "the night with water three house. und nicht zwischen über schön straße! дом между вода"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "123 %% 456", "x"), (5, "日本語", "x"), (5, "日本語", "x"), (None, "the", "x")], "doc_id long, text string, lang string")
    out = langid.identify(docs, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and sum(r.doc_id == 5 for r in out) == 2
    assert [(text[s.start : s.end], s.lang) for s in by[1].spans] == [("the night with water three house", "en"), ("und nicht zwischen über schön straße", "de"), ("дом между вода", "ru")]
    assert [(by[k].lang, by[k].score, by[k].spans) for k in (2, 3, 4)] == [("und", 0.0, [])] * 3
    assert by[5].lang in ("en", "de", "ru") and by[None].lang == "en"
    assert langid.identify(docs.limit(0), model).collect() == []


def test_without_labels_nothing_is_known(spark):
    none = langid.fit(spark.createDataFrame([("a", None)], "text string, lang string"))
    assert [r.lang for r in langid.identify(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()] == ["und"]


def test_op2_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_viterbi_spans(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


def naive_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, k in Counter(windows).items() if k > 1}
    hit = {i + d for i, w in enumerate(windows) if w in often for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_counts():
    rng = random.Random(4)
    cases = [None, "", " \n\t", "a b c a b c", "x x x x", "l\nl\n\n\nl \nl", "a b \x1c c", "é# <|>\r\nq"] + ["".join(rng.choice("ab\n #é\t") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for text in cases:
        assert quality.base_counts(text) == naive_base(text), repr(text)


def test_op3_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    refs = quality.references(spark.read.parquet(f"{SF}/documents.parquet"))
    for k, lang in enumerate(refs.languages):
        count, classes = Counter(), np.zeros(len(quality.CLASSES))
        for d in docs:
            if d.lang == lang:
                count.update(map(quality.plain, d.text.encode().split()))
                classes += quality.class_counts(d.text.encode())
        total = sum(count.values())
        del count[b""]
        want = dict(sorted(count.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON])
        got = {w: refs.word_share[k, i] for w, i in refs.index.items() if refs.common[k, i]}
        assert got.keys() == want.keys() and all(got[w] == pytest.approx(n / total) for w, n in want.items())
        assert refs.classes[k] == pytest.approx(classes / classes.sum())
    rows = {r.doc_id: r for r in op3_divergence(spark, SF).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for d in docs:
        r = rows[d.doc_id]
        base = naive_base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        lang, by_class, by_word = refs.distances(d.text.encode())
        assert r.kept == (not r.base_failed and not (len(d.text) >= 200 and by_class > quality.CLASS_LIMIT) and not by_word > quality.WORD_LIMIT + quality.WORD_SLACK / base[0] ** 0.5)
    good = [k for k, q in label.items() if q == 1 and not rows[k].base_failed]
    bad = [k for k, q in label.items() if q == 0 and not rows[k].base_failed]
    assert sum(rows[k].kept for k in good) >= 0.98 * len(good)
    assert sum(not rows[k].kept for k in bad) >= 0.8 * len(bad)


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 3), (2, "", "en", 3), (2, "", None, 3), (None, "a " * 80, "en", 3), (4, "%" * 5000, "en", 3)], "doc_id long, text string, lang string, kept int")
    refs = quality.references(docs)
    out = quality.judge(docs, refs).collect()
    assert len(out) == 5 and not any(r.kept for r in out)
    assert quality.judge(docs.limit(0), refs).collect() == []
    none = quality.references(docs.limit(0))
    plain = " ".join(f"w{i}" for i in range(60))
    assert [r.kept for r in quality.judge(spark.createDataFrame([(1, plain)], "doc_id long, text string"), none).collect()] == [True]


def test_js_distance_is_a_metric_of_histograms():
    p, q = np.array([[0.5, 0.5, 0]]), np.array([[0, 0, 1.0]])
    assert quality.js_distance(p, q)[0] == pytest.approx(1) and quality.js_distance(p, p)[0] == 0


def test_pairs_of_terms_are_learned():
    rng = random.Random(0)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        filler = [f"w{rng.randint(0, 400)}" for _ in range(12)]
        rows.append((" ".join(filler + ["grudge"] * a + ["people"] * b), int(a and b)))
    doc, bins = toxicity.terms([t for t, _ in rows])
    m = toxicity.fit_machine(doc, bins, np.array([y for _, y in rows], float))
    s = m.score(["grudge people w1 w2", "grudge w1 w2", "people w1 w2", "w1 w2"])
    assert s[0] > 0.5 > max(s[1:])


def test_raw_scores_are_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(40), 0.3, rng.normal(size=40), rng.normal(size=(40, toxicity.RANK)))
    lists = [sorted(rng.choice(40, n, replace=False).tolist()) for n in (0, 1, 2, 7, 40)]
    doc, at = np.repeat(np.arange(5), [len(x) for x in lists]), np.concatenate(lists).astype(int)
    want = [0.3 + sum(m.w[i] for i in x) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(x, 2)) for x in lists]
    assert m.raw(doc, at, 5) == pytest.approx(want)


def test_op4_scores_by_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels, terms_a_row=50)
    rows = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    for r in docs.limit(60).collect():
        doc, bins = toxicity.terms([r.text])
        at = [int(m.place[b]) for b in bins if m.place[b] >= 0]
        z = m.w0 + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(at, 2))
        assert rows[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_op4_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = op4_factorization_machine(spark, "/root/testdata/sf0.1").collect()
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ranks = {i: k + 1 for k, (i, _) in enumerate(sorted(enumerate(held), key=lambda x: x[1][0]))}
    n1 = sum(y for _, y in held)
    auc = (sum(ranks[i] for i, (_, y) in enumerate(held) if y) - n1 * (n1 + 1) / 2) / (n1 * (len(held) - n1))
    assert auc >= 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "x", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    out = toxicity.score(docs, m).collect()
    assert len(out) == 4 and all(0 < r.score < 0.5 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []

"""Texts that a shortcut of a search would lose, against brute force."""

import random
import re
import time
from itertools import accumulate

from isoreach.llm import decontaminate, langid, pii
from pyspark.sql import functions as F
from test_matching import base_by_force, edits_within


def test_repeated_phrases_of_an_item_are_found():
    item = "red fox ran by red fox ran on over the cold hill at dawn yes"
    text = "a long day bad fox ran my red fox ran on over the cold hill at dawn yes and more"
    assert [(i, e) for i, e, _ in decontaminate.Finder([item]).find(text)] == [(0, 3)] and edits_within(item, text) == 3
    rng = random.Random(5)
    for _ in range(300):
        phrases = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5))) for _ in range(4)) for _ in range(2)]
        item = decontaminate.normal(" ".join(rng.choice(phrases) for _ in range(rng.randint(3, 6))))
        k, _ = decontaminate.pieces_of(item)
        t = list(item)
        for _ in range(rng.randint(0, k)):
            t[rng.randrange(len(t) // 2)] = rng.choice("hijk")
        text = "words before " + "".join(t) + " words after"
        least = edits_within(item, text)
        assert least <= k and [(i, e) for i, e, _ in decontaminate.Finder([item]).find(text)] == [(0, least)]


def test_all_items_against_all_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 30, 40)]
    piece = "abca bcad dcba "
    texts += [piece + " ".join(word() for _ in range(12)) + " " + piece, "x" * 23, "x" * 24, "y" * 100, "z " * 75]
    items = [(None if i % 7 == 3 else i % 5, t) for i, t in enumerate(texts)] + [(0, texts[0]), (3, "?!"), (4, None)]
    docs = []
    for d in range(80):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, max(1, int(len(t) * 0.11)))):
            k = rng.randrange(len(t))
            t[k] = rng.choice(["", "q", t[k] + "b"])
        docs.append((d, " ".join([word() for _ in range(3)] + ["".join(t)] + [word() for _ in range(3)])))
    docs += [(90, None), (91, ""), (None, texts[9]), (92, "y" * 92 + "q" * 8), (92, "y" * 92 + "q" * 8), (93, "y" * 91 + "q" * 9), (94, "a" + "x" * 23)]
    want = []
    for d, text in docs:
        doc = decontaminate.normal(text)
        for i, t in set(items):
            item = decontaminate.normal(t)
            if 0 < len(item) < decontaminate.LEAST_CHARS:
                want += [(d, i, 0)] * (f" {item} " in f" {doc} ")
            elif item and (e := edits_within(item, doc)) <= int(len(item) * decontaminate.ERROR_RATE):
                want.append((d, i, e))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(frame, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 50
    kept = [r.doc_id for r in decontaminate.without_contaminated(frame, bench, least_chars=0).collect()]
    assert sorted(map(str, kept)) == sorted(str(d) for d, _ in docs if d not in {x[0] for x in want})
    named = spark.createDataFrame([("b", texts[11]), ("a", texts[10])], "item_id string, text string")
    assert {r.item_id for r in decontaminate.contaminated(frame, named).collect()} <= {"a", "b"}


def test_an_unlearned_script_has_no_language(spark):
    words = {"de": "und nicht straße über zwischen schön", "en": "the house with water three night"}
    model = langid.fit(spark.createDataFrame([(w, k) for k, w in words.items() for _ in range(20)], "text string, lang string"))
    rows = [(1, "вода ночь дом между красиво", "ru"), (2, "house вода ночь дом между", None), (3, "the house with water дом", None), (4, words["de"], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert (by[1].score, [s.lang for s in by[1].spans]) == (0.0, ["und"])
    assert (by[2].lang, by[2].score) == ("en", 5 / 21) and (by[3].lang, by[3].score) == ("en", 17 / 20)
    assert [(s.start, s.end, s.lang) for s in by[3].spans] == [(0, 20, "en"), (21, 24, "und")]
    assert {r.doc_id: r.lang for r in langid.keep_identified(docs, model).collect()} == {3: "en", 4: "de"}


def test_running_folds(spark):
    rng = random.Random(2)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 4096, 4097, 9000)]
    got = spark.createDataFrame([(x,) for x in rows], "xs array<int>").select(pii.running_sum(F.col("xs")), pii.running_max(F.col("xs"))).collect()
    assert [r[0] for r in got] == [[0, *accumulate(x)][: len(x)] for x in rows]
    assert [r[1] for r in got] == [[0, *accumulate(x, max)][: len(x)] for x in rows]


def test_dense_texts_take_linear_time(spark):
    rng = random.Random(3)
    dense = " ".join(rng.choice(["4111111111111111", "a@b.co", "10.0.0.1", "é"]) for _ in range(100_000))
    tokens = " ".join(f"w{rng.randint(10000, 99999)}" for _ in range(100_000))
    docs = spark.createDataFrame([(1, dense), (2, tokens), (3, "é " * 400_000 + "a@b.co")], "doc_id long, text string")
    began = time.time()
    out = pii.find(docs).select("doc_id", pii.as_text(F.col("base")).alias("base"), pii.redacted(F.col("row.text"), F.col("spans")).alias("t")).collect()
    assert time.time() - began < 150
    for r in out:
        text = {1: dense, 2: tokens}.get(r.doc_id, "é " * 400_000 + "a@b.co")
        want = base_by_force(text)
        assert r.base == ",".join(want) and len(want) == {1: len(want), 2: 0, 3: 1}[r.doc_id]
    assert next(r.t for r in out if r.doc_id == 3) == "é " * 400_000 + "<email>"


def ids_by_force(texts):
    """The discovered (row, value) by the docstring's rules, with sets and dicts."""
    edges, tokens = {}, []
    for i, text in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in base_by_force(text)]
        found = [(a, text[a:b].lower(), 1) for a, b in base]
        for m in re.finditer(pii.TOKEN, text):
            value = re.sub(r"[._+@-]+$", "", m[0])
            a, b = m.start(), m.start() + len(value)
            if len(value) >= 6 and sum(c.isdigit() for c in value) >= 4 and not any(x < b and y > a for x, y in base):
                found.append((a, value.lower(), 0))
                tokens.append((i, value))
        for a, value, seed in found:
            words = re.sub("[0-9]", "0", text[max(0, a - pii.CONTEXT_CHARS) : a]).lower().split()
            for n in range(1, min(3, len(words)) + 1):
                key = " ".join(words[-n:]), value
                edges[key] = max(seed, edges.get(key, 0))
    seed_of = {}
    for (_, v), s in edges.items():
        seed_of[v] = max(s, seed_of.get(v, 0))
    score = {v: float(s) for v, s in seed_of.items()}
    for _ in range(pii.ROUNDS):
        confidence = {}
        for p in {p for p, _ in edges}:
            own = [v for q, v in edges if q == p]
            if sum(edges[p, v] for v in own) >= pii.LEAST_SEEDS:
                confidence[p] = sum(score[v] for v in own) / (len(own) + 1)
        score = {v: max([float(seed_of[v]), *(confidence.get(p, 0.0) for p, w in edges if w == v)]) for v in score}
    return {(i, v) for i, v in tokens if not seed_of.get(v.lower(), 0) and score.get(v.lower(), 0) >= pii.ACCEPT}


def test_scores_on_random_graphs(spark):
    rng = random.Random(11)
    words = ["my", "id", "contact", "order", "no", "ref"]
    value = lambda: rng.choice([f"u{rng.randint(0, 30)}@m.com", f"10.1.{rng.randint(0, 9)}.7", f"AB-{rng.randint(1000, 1012)}-X", f"zx{rng.randint(10000, 10008)}"])
    texts = [" ".join(x for _ in range(rng.randint(1, 4)) for x in (*rng.choices(words[: 2 + k % 5], k=rng.randint(1, 3)), value())) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for accept in (pii.ACCEPT, 0.7):
        old, pii.ACCEPT = pii.ACCEPT, accept
        try:
            want = ids_by_force(texts)
        finally:
            pii.ACCEPT = old
        got = {(r.doc_id, s.value) for r in pii.find(docs, accept=accept).collect() for s in r.spans if s.kind == len(pii.KINDS)}
        assert got == want and (want or accept > 0.7)

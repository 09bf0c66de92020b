"""Benchmark passages, near duplicates and personal data."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from isoreach.llm import decontaminate, minhash, pii
from isoreach.llm.queries import op1_pigeonhole_myers, op5_bootstrapped_context, op10_dart_minhash

SF = "/root/testdata/sf0.01"


def edits_within(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, e in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != e)))
        prev = cur
    return min(prev)


def test_myers_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(1500):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        want = edits_within(p, t)
        got = decontaminate.myers(p, t, want)
        assert got and got[0] == want and (want == 0 or decontaminate.myers(p, t, want - 1) is None)


def test_edited_passages_are_found_and_others_not(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(30)] + [(99, None), (98, "too short"), (None, "xyz" * 70)]
    docs, want = [], set()
    for d in range(60):
        body = [word() for _ in range(200)]
        if d % 2 == 0:
            i = rng.randrange(30)
            t = list(items[i][1])
            for _ in range(int(len(decontaminate.normal(items[i][1])) * 0.05)):
                k = rng.randrange(len(t))
                t[k] = rng.choice(["", "q", t[k] + "z"])
            body[100:100] = ["".join(t).upper() if d % 4 else "".join(t).replace(" ", ",  ")]
            want.add((d, i))
        docs.append((d, " ".join(body), "k"))
    frame = spark.createDataFrame([*docs, (900, None, "k"), (901, "", "k"), (None, items[3][1], "k"), (902, items[3][1], "k"), (902, items[3][1], "k")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None and r.doc_id < 900} == want
    assert sum(r.doc_id == 902 for r in got) == 2 and [r.edits for r in got if r.doc_id is None] == [0]
    for r in got:  # brute force: the edits are the least
        if r.doc_id is not None and r.doc_id < 900:
            assert r.edits == edits_within(decontaminate.normal(items[r.item_id][1]), decontaminate.normal(docs[r.doc_id][1]))
    assert decontaminate.contaminated(frame, bench.limit(0)).collect() == decontaminate.contaminated(frame.limit(0), bench).collect() == []


def test_item_blocks_cover_all_items(spark):
    bench = spark.createDataFrame([(i, "a" * 50) for i in range(20)] * 2 + [(7, "?"), (8, None), (None, "b" * 30)], "item_id long, text string")
    held = list(decontaminate.item_blocks(bench, limit=120))
    assert len(held) > 5 and sorted(i for b in held for i, _ in b if i is not None) == list(range(20)) and held[0][0] == (None, "b" * 30)


def test_op1_finds_all_whole_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    norm = {d.doc_id: decontaminate.normal(d.text) for d in docs}
    want = {(d, b.item_id) for b in items for d, t in norm.items() if decontaminate.normal(b.text) in t}
    got = {(r.doc_id, r.item_id): r.edits for r in op1_pigeonhole_myers(spark, SF).collect()}
    assert want <= got.keys() and all(got[k] == 0 for k in want) and all(got[k] > 0 for k in got.keys() - want)


def shingle_bag(text):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes_by_force(texts):
    bags = {i: shingle_bag(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bags[i] and bags[j] and not bags[i].keys().isdisjoint(bags[j]) and similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for change in (0.1, 0.4):
        n, t = 400, 2048
        e, w = rng.integers(1, 2**62, n).astype(np.uint64), rng.integers(1, 9, n) * rng.choice([1, 0.7], n)
        e2, w2 = e.copy(), w.copy()
        m = rng.random(n) < change
        e2[m] = rng.integers(1, 2**62, int(m.sum())).astype(np.uint64)
        w2[rng.random(n) < 0.2] += 1
        a, b = dict(zip(e.tolist(), w)), dict(zip(e2.tolist(), w2))
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        s = minhash.dart_signatures(np.repeat([0, 1], n), np.concatenate([e, e2]), np.concatenate([w, w2]), 2, t)
        assert not np.isinf(s).any() and (s[0] == s[1]).mean() == pytest.approx(want, abs=4 * (want * (1 - want) / t) ** 0.5)


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, n = {}, 0
    for g in range(25):
        base = [word() for _ in range(rng.choice([8, 60, 300]))]
        for c in range(rng.choice([1, 2, 5, 40])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                t[rng.randrange(len(t))] = word()
            texts[n] = " ".join(t) if c % 3 else " ".join(t).upper() + "!"
            n += 1
    common = [word() for _ in range(60)]
    for _ in range(60):  # a passage that many share, under the threshold
        texts[n] = " ".join(common + [word() for _ in range(40)])
        n += 1
    texts |= {n: None, n + 1: "", n + 2: "?!", n + 3: "two words", n + 4: "Two words.", n + 5: "two word"}
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in texts.items()] + [(0, texts[0], 5, "x"), (None, "a b c d e f", 5, "x")], "doc_id long, text string, class_id int, sig string")
    rows = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == classes_by_force(texts) and len(rows) == len(texts) + 2
    sizes = Counter(r.class_id for r in rows if r.doc_id is not None)
    assert all(r.class_size == sizes[r.class_id] for r in rows if r.doc_id is not None)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(4)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b), (None, c), (None, c + "!"), (5, "?"), (5, "?"), (6, c.upper()), (7, a), (7, a)]
    docs = spark.createDataFrame([(i, t, {"k": 1}, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, tags map<string,int>, `a.b` string, _th int")
    got = Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, 5 - 1, 0), (1, 1, 3, 0), (2, 1, 4, 0), (3, 1, 3, 0), (4, 1, 3, 0), (None, 6, 3, 0), (None, 6, 3, 0), (5, 5, 1, 0), (5, 5, 1, 0), (6, 6, 3, 0), (7, 1, 4, 0), (7, 1, 4, 0)])
    by_text = {}
    for r, key in ((r, r.class_key) for r in minhash.near_duplicates(docs).where("doc_id in (1, 2, 3, 4, 7)").collect()):
        by_text.setdefault(key, []).append(r.doc_id)
    assert sorted(map(sorted, by_text.values())) == [[1, 2, 7, 7], [1, 3, 4]]
    one = minhash.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in one.collect()) == sorted([(1, a), (1, b), (5, "?"), (5, "?"), (6, c.upper())])
    names = spark.createDataFrame([("b", a), ("a", a), ("a", a)], "doc_id string, text string")
    assert {(r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(names).collect()} == {("a", "a", 3), ("b", "a", 3)}
    assert [(r.doc_id, r.text) for r in minhash.one_of_each(names).collect()] == [("a", a)]
    assert minhash.one_of_each(docs.limit(0)).collect() == []


def test_op10_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in op10_dart_minhash(spark, "/root/testdata/sf0.001").collect()} == classes_by_force(texts)


FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_by_force(text):
    out = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [f"{FORMS[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


CASES = [
    None, "", "a.b@c.de, é x@y.zz_c@d.com a@b.c._x@y.z", "1.2.3.4 001.002.003.0255 256.1.1.1 1.2.3.4.5 0000.0.0.0", "card 4111 1111-1111 1111 and 4111111111111112, 12 4111111111111111",
    "+1 (017) 555-7713 +12 +1234567890123456 +1 2.3-4(5)6 789", "🙂 me@x.org 4111111111111111", "9" * 5000, "a" * 20000 + "@", "1." * 3000, "+" + "1" * 3000, "5500005555555559 " * 200, "a@b", "@x.y", "x@-.-",
]


def test_base_spans_equal_the_forms(spark):
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choice("a1.@+ -()9é%_") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(["4111111111111111", "a@b.co", "+1 555 123 4567", "10.0.0.1", " ", ".", "-", "_", "x"]) for _ in range(8)) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    rows = {r.doc_id: r for r in pii.find(docs).withColumn("listed", pii.as_text(pii.F.col("base"))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].listed == ",".join(base_by_force(t)), repr(t)
        kept = {(s.start, s.end, s.kind) for s in rows[i].base}
        assert kept <= {(s.start, s.end, s.kind) for s in rows[i].spans} and all(t[s.start : s.end] == s.value for s in rows[i].spans)
    assert pii.find(docs.limit(0)).collect() == []


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rng = random.Random(4)
    rows = [(i, f"hello there my contact id {'u%d@mail.com' % i if i % 2 else '10.1.%d.7' % i} bye") for i in range(12)]
    rows += [(100, "my contact id AB-99817-X bye"), (101, "elsewhere AB-99817-X again"), (102, "order number QX-55512-R"), (103, None), (104, "my contact id AB-99817-X bye")]
    rows += [(200 + i, f"version build{rng.randint(10000, 99999)} of the tool") for i in range(20)]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {(i, s.value) for i, r in out.items() for s in r.spans if s.kind == len(pii.KINDS)}
    assert found == {(100, "AB-99817-X"), (101, "AB-99817-X"), (104, "AB-99817-X")}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.co or +1 555 123 4567."), (2, None), (3, "clean"), (4, "+1 10.0.0.10 22 333")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in pii.find(docs).select("doc_id", pii.redacted(pii.F.col("row.text"), pii.F.col("spans")).alias("t")).collect()}
    assert got[1] == "é mail <email> or <phone>." and got[2] is None and got[3] == "clean" and "10.0.0.10" not in got[4]


def test_op5_digests(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in op5_bootstrapped_context(spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        want = base_by_force(d.text)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k, _ in FORMS)
        assert set(want) <= set(r.spans.split(","))

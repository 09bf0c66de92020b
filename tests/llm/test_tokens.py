"""BPE by pieces and by table, length histogram, grammar-compressed ids."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isoreach.llm import bpe_table, repair, token_counts
from isoreach.llm.bpe import Codec
from isoreach.llm.queries import op8_repair_ids, op9_distinct_word_bpe, tokenizer_path

ODD = [
    None, "", " ", "  a", "a  b ", "a\n\n b", "a \n b", "x <|endoftext|> y", "  <|endoftext|>  z", "it's 's 'll  've", "a\x1c b \x1cb", "a \x85b", "日本 語 ",
    "é ́x", "\n", "\n\n", "a\nb", "\nb", "a.\n.b,c, d", "x" * 5000, "word " * 3000, "same text", "same text", "a  b 　c", "🙂 é,é. É",
]


@pytest.fixture(scope="module")
def codec():
    return Codec.of(tokenizer_path())


def expected(codec, text):
    return codec.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab B'sé1.,!\n\t  \x1c日", max_size=30), max_size=6))
def test_pieces_encode_like_the_whole_text(texts):
    codec = Codec.of(tokenizer_path())
    ids, n = codec.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [expected(codec, t) for t in texts]


def test_a_full_table_starts_anew(codec, monkeypatch):
    monkeypatch.setattr("isoreach.llm.bpe.TABLE_PIECES", 50)
    rng = random.Random(3)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)) for _ in range(3)]
        ids, n = codec.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [expected(codec, t) for t in texts]


def test_long_words_keep_their_order(codec):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096, "日" * 1400 + "本" * 1400, "本" * 1400 + "日" * 1400]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (10_000, 1 << 20)] + ["語" * 5000 + "学" * 5000]
    texts += [" x " + t[len(t) // 2 :] + t[: len(t) // 2] for t in texts]
    ids, n = codec.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [expected(codec, t) for t in texts]


def test_equal_hashes_change_nothing(spark, codec, monkeypatch):
    few = lambda buf, starts, size: (buf[starts].astype(np.uint64) % np.uint64(5)) + np.uint64(1)
    monkeypatch.setattr("isoreach.llm.bpe.piece_hashes", few)
    monkeypatch.setattr("isoreach.llm.bpe_table.piece_hashes", few)
    held = Codec(tokenizer_path())
    for texts in (["one two three two", "four, one. two"], ["two one", "seven eight", "", "one"]):
        ids, n = held.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [expected(codec, t) for t in texts]
    p = bpe_table._Pieces(held, [b"one two three two", b"four two one"], 3)
    words = [p.raw[a : a + k] for a, k in zip(p.at.tolist(), p.n.tolist())]
    assert sorted(words) == [b" one", b" three", b" two", b"four", b"one"] and b"".join(words[i] for i in p.which) == p.raw


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        Codec(public_tokenizers.path("word_bpe_49k.json"))


def docs_of(spark, texts):
    return spark.createDataFrame([(None if i == 5 else i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, chunk int")


def test_table_encodes_and_decodes_every_row(spark, codec):
    out = bpe_table.encode_decode(docs_of(spark, ODD), tokenizer_path(), chunk_bytes=4000).collect()
    want = sorted((str(None if i == 5 else i), expected(codec, t), codec.library.decode(expected(codec, t), skip_special_tokens=False)) for i, t in enumerate(ODD))
    twice = docs_of(spark, ODD).unionByName(docs_of(spark, ODD))
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in bpe_table.encode_decode(twice.coalesce(1), tokenizer_path(), chunk_bytes=4000).collect()) == sorted(want + want)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in out) == want
    empty = docs_of(spark, ODD).limit(0)
    assert bpe_table.encode_decode(empty, tokenizer_path()).collect() == []


def test_op9_digests(spark, codec):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op9_distinct_word_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = expected(codec, r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(codec.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def uses_by_force(symbols, pair):
    n = i = 0
    while i + 1 < len(symbols):
        hit = (symbols[i], symbols[i + 1]) == pair
        n, i = n + hit, i + 1 + hit
    return n


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(2, 5))
def test_grammar_round_trip_and_any_range(ids, least):
    data = np.array(ids, np.uint32)
    rules, symbols = repair.compress(data, 7, least)
    s = symbols.tolist()
    assert all(uses_by_force(s, p) < least for p in set(zip(s, s[1:])))  # no frequent pair is left
    expand = lambda x: [x] if x < 7 else [y for k in rules[x - 7].tolist() for y in expand(k)]
    assert [y for x in s for y in expand(x)] == ids
    assert repair.expansion_lengths(rules, 7).tolist() == [len(expand(7 + k)) for k in range(len(rules))]
    g = repair.Grammar(repair.to_payload(data, 7, least))
    assert g.ids().tolist() == ids
    for a, b in ((0, len(ids) // 2), (len(ids) // 3, len(ids)), (len(ids) // 2, len(ids) // 2)):
        assert g.ids(a, b).tolist() == ids[a:b]


def test_repeated_pairs_become_rules():
    rules, symbols = repair.compress(np.tile(np.array([1, 2, 3, 4], np.uint32), 500), 10)
    assert len(rules) and len(symbols) < 20


def test_pairs_that_overlap_themselves_hide_no_others():
    a, b, apart = 0x9E3779B1, 0x85EBCA6B, iter(range(1 << 20, 1 << 21))
    data = [x for _ in range(5) for x in (0, 0, 0, next(apart))]  # ten uses of (0, 0), five that do not overlap
    low = np.arange(1 << 14, dtype=np.uint64)
    for left in range(1, 41):  # pairs of eight uses at one place of a table of 18 bits
        right = (left * a % 2**32 ^ (77 << 14 | low)) * np.uint64(pow(b, -1, 2**32)) % np.uint64(2**32)
        right = int(right[(right > 1000) & (right < 1 << 20)][0])
        data += [x for _ in range(8) for x in (left, right, next(apart))]
    data = np.array(data, np.uint32)
    live = repair.frequent_pairs(data, 8, np.arange(len(data) - 1))[3].tolist()
    assert set(live) >= set(range(20, len(data), 3)) and not any(data[k] == data[k + 1] for k in live)
    rules, symbols = repair.compress(data, 1 << 21, 8)
    assert len(rules) == 40
    s = symbols.tolist()
    assert all(uses_by_force(s, p) < 8 for p in set(zip(s, s[1:])))


def test_rounds_look_at_few_places(monkeypatch):
    data = np.minimum(np.random.default_rng(5).zipf(1.3, 100_000), 49_999)
    inner, seen = repair.frequent_pairs, []

    def counted(s, least, *places):
        seen.append(len(places[0]) if places else len(s) - 1)
        return inner(s, least, *places)

    monkeypatch.setattr(repair, "frequent_pairs", counted)
    g = repair.Grammar(repair.to_payload(data, 50_000))
    assert g.ids().tolist() == data.tolist()
    assert sum(seen) < 2.5 * len(data)


def test_files_hold_every_document_in_order(spark, codec):
    path = repair.write_ids(docs_of(spark, ODD), tokenizer_path(), partitions=3)
    got = sorted(repair.read_ids(spark, path).collect(), key=lambda r: r.start)
    order = [5] + [i for i in range(len(ODD)) if i != 5]  # a null id is first
    at = 0
    for r, i in zip(got, order, strict=True):
        ids = [*expected(codec, ODD[i]), 0]
        assert (r.doc_id, r.start, r.n_tokens) == (None if i == 5 else i, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    some = repair.read_ids(spark, path, spark.createDataFrame([(3,), (20,), (999,)], "doc_id long")).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in some} == {i: [*expected(codec, ODD[i]), 0] for i in (3, 20)}
    empty = repair.write_ids(docs_of(spark, ODD).limit(0), tokenizer_path())
    assert repair.read_ids(spark, empty).collect() == []


def test_op8_against_the_library(spark, codec):
    rows = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in op8_repair_ids(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in rows:
        ids = [*expected(codec, r.text), 0]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_histogram_answers_every_limit(spark, codec):
    lengths = [len(expected(codec, t)) for t in ODD]
    h = token_counts.length_histogram(token_counts.token_lengths(docs_of(spark, ODD), tokenizer_path()))
    for r in h.collect():
        x = r.n_tokens
        assert r.n_docs == lengths.count(x)
        assert r.docs_upto == sum(n <= x for n in lengths) and r.docs_over == sum(n > x for n in lengths)
        assert r.tokens_over == sum(n for n in lengths if n > x) and r.total_tokens == sum(lengths)
        assert r.truncated_total == sum(min(n, x) for n in lengths)
        assert r.quantile == pytest.approx(sum(n <= x for n in lengths) / len(lengths))
    limits = {r.limit: (r.docs_over, r.truncated_total) for r in token_counts.at_limit(h, [0, 7, 100, 10**6]).collect()}
    assert limits == {k: (sum(n > k for n in lengths), sum(min(n, k) for n in lengths)) for k in (0, 7, 100, 10**6)}
    assert token_counts.length_quantile(h, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    none = token_counts.token_lengths(docs_of(spark, ODD).limit(0), tokenizer_path())
    assert token_counts.length_histogram(none).collect() == []

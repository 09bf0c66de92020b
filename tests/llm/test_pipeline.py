"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib

import corpus_pipeline
from isoreach.llm import decontaminate, langid
from isoreach.llm.bpe import Codec
from isoreach.llm.queries import tokenizer_path
from test_matching import base_by_force, classes_by_force

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in base_by_force(text)):
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind}>"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", None, "s", 0), (9003, "123 %%", "en", "s", 6), (None, "the of and to in that for was with", None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r for r in docs.collect()}

    one = corpus_pipeline.language(spark, docs, SF)
    assert one.schema.names == docs.schema.names
    model = langid.fit(docs)
    held = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    want = {i for i, r in held.items() if r.lang != "und" and r.score >= langid.LEAST_SCORE}
    kept = {r.doc_id: r for r in one.collect()}
    assert kept.keys() == want and not want & {9001, 9002, 9003}
    assert all(r.lang == held[i].lang and r.text == rows[i].text and r.source == rows[i].source for i, r in kept.items())

    two = corpus_pipeline.near_duplicates(spark, one, SF)
    assert two.schema.names == docs.schema.names
    classes = classes_by_force({i: r.text for i, r in kept.items() if i is not None})
    kept2 = {r.doc_id: r for r in two.collect()}
    assert kept2.keys() == {c for c in classes.values()} | {None} and two.count() == len(kept2)

    three = corpus_pipeline.decontamination(spark, two, SF)
    finder = decontaminate.Finder([b.text for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    kept3 = {r.doc_id: r for r in three.collect()}
    assert kept3.keys() == {i for i, r in kept2.items() if not finder.find(decontaminate.normal(r.text))} and three.schema.names == docs.schema.names

    four = corpus_pipeline.personal_data(spark, three, SF)
    kept4 = {r.doc_id: r for r in four.collect()}
    assert four.schema == three.schema and kept4.keys() == kept3.keys()
    assert all(r.text == redacted(kept3[i].text) and r.n_chars == len(r.text) for i, r in kept4.items())

    codec = Codec.of(tokenizer_path())
    five = {r.doc_id: r for r in corpus_pipeline.tokens(spark, four, SF).collect()}
    assert five.keys() == kept4.keys()
    for i, r in five.items():
        ids = codec.library.encode(kept4[i].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(kept4[i].text.encode()).hexdigest()


def test_run_is_the_stages(spark):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert got == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_any_columns_and_repeated_ids(spark):
    a, b = "the of and to in that for was with on as at by from " * 3, "one or two of the other words that were not in it " * 3
    rows = [(1, a), (1, b), (2, a + "!"), (None, b + " mail x@y.org and more of the same to be read"), (3, None), (4, ""), (5, "of the " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, {"k": n}, "v", n, "r") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, m map<string,int>, _text string, `a.b` int, row string")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, SF)
        assert out.columns == docs.columns and out.schema["m"].dataType == docs.schema["m"].dataType and before.columns == docs.columns
        out = corpus_pipeline.through_table(out, "stage")
    got = sorted((r["a.b"], r.doc_id, r.m["k"], "<email>" in r.text, r.n_chars == len(r.text)) for r in out.collect())
    assert got == [(0, 1, 0, False, True), (1, 1, 1, False, True), (3, None, 3, True, True), (6, 5, 6, False, True)]
    last = corpus_pipeline.tokens(spark, out, SF)
    assert last.count() == 4
    loose = spark.createDataFrame([(7, None, {"k": 1}), (7, "call +1 555 123 4567", {"k": 2}), (8, None, {"k": 3})], "doc_id long, text string, m map<string,int>")
    assert sorted((r.doc_id, str(r.text)) for r in corpus_pipeline.personal_data(spark, loose, SF).collect()) == [(7, "None"), (7, "call <phone>"), (8, "None")]
    assert corpus_pipeline.near_duplicates(spark, loose, SF).count() == 3

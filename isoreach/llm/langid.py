"""Language spans by script candidates and Viterbi over word scores.

A word is a run of letters. Its script (by code point range) narrows the languages to those that used
the script in at least SCRIPT_SHARE of their training letters; a word in a script of no learned language
says nothing. Each candidate scores the word by the log-probabilities of its hashed character 1- to
3-grams with word ends. Viterbi with a fixed penalty for a change of language labels every word, and
runs of equal labels are the spans of a mixed text. The prediction is the language with most letters and
the score its share of all letters; letters of words in a script of no learned language count for none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.blocks import blocks, map_rows, tidy

BINS = 1 << 16
SCRIPT_SHARE = 0.01
SWITCH = 12.0
#: Labelled rows of one language that a model is fitted on, about.
FIT_ROWS = 4000
NOT = -1e4
#: The share of a text's letters that a known language has at least, for a text to be kept.
LEAST_SCORE = 0.5
GROUP_SCORES = 3 << 20
BLOCK = 1 << 20

# First code point, end and name of the scripts that are told apart; letters elsewhere are "other".
SCRIPTS = [
    (0x0041, 0x0250, "latin"), (0x0250, 0x02B0, "latin"), (0x0370, 0x0400, "greek"), (0x0400, 0x0530, "cyrillic"), (0x0530, 0x0590, "armenian"),
    (0x0590, 0x0600, "hebrew"), (0x0600, 0x0780, "arabic"), (0x0900, 0x0980, "devanagari"), (0x0980, 0x0A00, "bengali"), (0x0A00, 0x0A80, "gurmukhi"),
    (0x0A80, 0x0B00, "gujarati"), (0x0B80, 0x0C00, "tamil"), (0x0C00, 0x0C80, "telugu"), (0x0C80, 0x0D00, "kannada"), (0x0D00, 0x0D80, "malayalam"),
    (0x0E00, 0x0E80, "thai"), (0x0E80, 0x0F00, "lao"), (0x0F00, 0x1000, "tibetan"), (0x1000, 0x10A0, "myanmar"), (0x10A0, 0x1100, "georgian"),
    (0x1100, 0x1200, "hangul"), (0x1200, 0x1380, "ethiopic"), (0x1780, 0x1800, "khmer"), (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"),
    (0x3040, 0x30A0, "kana"), (0x30A0, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"), (0xF900, 0xFB00, "han"), (0x20000, 0x32000, "han"),
]
SCRIPT_NAMES = sorted({s for *_, s in SCRIPTS}) + ["other"]
_tables: dict = {}


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script's number (-1: no letter) and the lower case of one code point."""
    if not _tables:
        script = np.full(0x110000, -1, np.int8)
        lower = np.arange(0x110000, dtype=np.uint32)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        script[letters] = len(SCRIPT_NAMES) - 1
        for a, b, name in SCRIPTS:
            own = script[a:b]
            own[own >= 0] = SCRIPT_NAMES.index(name)
        for c in letters:
            if len(x := chr(c).lower()) == 1:
                lower[c] = ord(x)
        _tables["t"] = script, lower
    return _tables["t"]


def _hash(a, b, c, kind: int) -> np.ndarray:
    x = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B) + np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)) ^ (c * np.uint32(0xC2B2AE35))
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(16)).astype(np.int32)


class Words:
    """The words of some texts: text, first and last code point, letters, script; and hashed grams of each letter."""

    def __init__(self, texts: list):
        script_of, lower = _letter_tables()
        raw = [(t or "").encode("utf-32-le", "replace") for t in texts]
        cps = np.frombuffer((b"\n\0\0\0").join(raw) + b"\n\0\0\0", np.uint32)
        size = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw)) + 1
        begin = np.cumsum(size) - size
        kind = script_of[cps]
        inside = (kind >= 0).astype(np.int8)
        step = np.diff(inside, prepend=np.int8(0))
        self.start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.text = np.searchsorted(begin, self.start, side="right") - 1
        self.letters = end - self.start
        self.script = kind[self.start]
        self.begin = self.start - begin[self.text]
        self.end = end - begin[self.text]
        at = np.flatnonzero(inside)
        self.c = lower[cps[at]]
        self.offset = np.cumsum(self.letters) - self.letters
        self.n_texts = len(texts)

    def grams(self):
        """Four arrays of bins, one entry a letter, and word-end bins, one entry a word."""
        c = self.c
        one = np.uint32(1)
        p1 = np.concatenate([[one], c[:-1]]).astype(np.uint32)
        p2 = np.concatenate([[one, one], c[:-2]]).astype(np.uint32)[: len(c)]
        first = self.offset
        p1[first] = one
        p2[first] = one
        second = first[self.letters > 1] + 1
        p2[second] = one
        zero = np.uint32(0)
        last = first + self.letters - 1
        return [_hash(c, zero + 0 * c, zero + 0 * c, 1), _hash(c, p1, zero + 0 * c, 2), _hash(c, p1, p2, 3)], _hash(np.full(len(last), 2, np.uint32), c[last], p1[last], 3)


class Model:
    """Languages in ascending order, log-probabilities by bin, and the languages that each script admits."""

    def __init__(self, languages: list[str], counts: np.ndarray, by_script: np.ndarray):
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.logp = np.ascontiguousarray(np.log((counts + 0.05) / (total + 0.05 * BINS)).T.astype(np.float32)) if languages else np.zeros((BINS, 0), np.float32)
        share = by_script / np.maximum(by_script.sum(1, keepdims=True), 1)
        self.admits = (share >= SCRIPT_SHARE).T  # script, language

    def scores(self, words: Words) -> np.ndarray:
        """A row for each word, a column for each language."""
        out = np.zeros((len(words.start), len(self.languages)), np.float32)
        if not len(out):
            return out
        per_letter, ends = words.grams()
        for k in range(len(self.languages)):
            p = self.logp[:, k]
            own = p[per_letter[0]] + p[per_letter[1]] + p[per_letter[2]]
            out[:, k] = np.add.reduceat(own, words.offset) + p[ends]
        admits = self.admits[words.script]
        out[~admits] = NOT
        out[~admits.any(1)] = 0.0
        return out


def viterbi(scores: np.ndarray, n_words: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The label of each word of texts that lie end to end; ties go to the earlier language and to no change."""
    order = np.argsort(-n_words, kind="stable")
    n = n_words[order]
    offset = (np.cumsum(n_words) - n_words)[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more words than t
    label = np.zeros(len(scores), np.int16)
    if not steps or scores.shape[1] == 1:
        return label
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)  # the label before
    own = np.arange(scores.shape[1], dtype=came.dtype)
    v = np.zeros((len(n), scores.shape[1]), np.float32)
    for t in range(steps):
        k = active[t]
        at = offset[:k] + t
        if t:
            x = v[:k]
            best = x.argmax(1)
            top = x[np.arange(k), best] - penalty
            change = top[:, None] > x
            came[at] = np.where(change, best[:, None], own)
            v[:k] = np.where(change, top[:, None], x) + scores[at]
        else:
            v[:k] = scores[at]
    state = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = offset[:k] + t
        label[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return label


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """A model from rows with a language, about ``rows`` of each by a hash of the text; null languages are left out.

    Counts are summed by Spark; the driver gets at most BINS numbers a language. No rows: no languages.
    """
    all_rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r["n"] for r in all_rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BINS)), np.zeros((0, len(SCRIPT_NAMES))))
    chance = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows / sizes[k])))])
    some = all_rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < chance[F.col("lang")] * (1 << 20))

    def counted(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in blocks(batch, limit=BLOCK):
                langs = part.column(1).to_pylist()
                w = Words(part.column(0).to_pylist())
                if not len(w.start):
                    continue
                per_letter, ends = w.grams()
                of_word = np.array([languages.index(x) for x in langs])[w.text]
                of_letter = np.repeat(of_word, w.letters)
                for k in np.unique(of_word).tolist():
                    own = held.setdefault(languages[k], np.zeros(BINS + len(SCRIPT_NAMES), np.int64))
                    for bins, who in ((per_letter[0], of_letter), (per_letter[1], of_letter), (per_letter[2], of_letter), (ends, of_word)):
                        own[:BINS] += np.bincount(bins[who == k], minlength=BINS)
                    own[BINS:] += np.bincount(w.script[of_word == k], w.letters[of_word == k], len(SCRIPT_NAMES)).astype(np.int64)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bin", "n"])

    counts = np.zeros((len(languages), BINS + len(SCRIPT_NAMES)))
    got = some.mapInArrow(tidy(counted), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts[[languages.index(x) for x in got.column("lang").to_pylist()], got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts[:, :BINS], counts[:, BINS:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang (``und`` without a letter or a model), score, spans (start, end in code points, lang) for every row.

    Spans run from their first word's first letter to their last word's last letter; words in a script of
    no learned language are ``und`` there, and a text of such words alone has the score 0. Null and empty texts
    have no span and the score 0. Only the text decides; other columns are ignored. Repeated rows stay.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    held = spark.sparkContext.broadcast(model)  # BINS numbers a language

    def labelled(batches):
        m = held.value
        for batch in batches:
            group: list = []
            size = 0
            for part in blocks(batch, limit=BLOCK):
                words = Words(part.column(1).to_pylist())
                group.append((part, words, m.scores(words)))
                words.c = None
                size += group[-1][2].size
                if size >= GROUP_SCORES:
                    yield _spans(m, group, penalty)
                    group, size = [], 0
            if group:
                yield _spans(m, group, penalty)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(labelled), f"doc_id {kind}, lang string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE, penalty: float = SWITCH) -> DataFrame:
    """The rows whose language is known and has at least ``least`` of the letters, with ``lang_col`` set to it.

    Rows without a letter (null and empty texts too) go. The other columns stay as they are, whatever
    their names; a missing ``lang_col`` is added. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers a language
    names = docs.columns if lang_col in docs.columns else [*docs.columns, lang_col]
    plain = docs if lang_col in docs.columns else docs.withColumn(lang_col, F.lit(None).cast("string"))
    plain = plain.withColumn(lang_col, F.col(f"`{lang_col}`").cast("string"))
    at_text, at_lang = names.index(text_col), names.index(lang_col)

    def kept(batches):
        m = held.value
        for batch in batches:
            group, size = [], 0
            parts = list(blocks(batch, f"c{at_text}", BLOCK))
            for i, part in enumerate(parts):
                words = Words(part.column(at_text).to_pylist())
                group.append((part, words, m.scores(words)))
                words.c = None
                size += group[-1][2].size
                if size >= GROUP_SCORES or i == len(parts) - 1:
                    found = _spans(m, group, penalty)
                    rows = pa.Table.from_batches([g[0] for g in group])
                    rows = rows.set_column(at_lang, f"c{at_lang}", found.column(1))
                    known = np.array([x != "und" for x in found.column(1).to_pylist()]) & (found.column(2).to_numpy() >= least)
                    yield from rows.filter(pa.array(known)).to_batches()
                    group, size = [], 0

    return map_rows(plain, tidy(kept), plain.schema)


def _spans(m: Model, group: list, penalty: float) -> pa.RecordBatch:
    """The result rows of some blocks that are scored; the first column of a block is handed on as doc_id."""
    ids = pa.concat_arrays([part.column(0) for part, *_ in group])
    n_texts = len(ids)
    base = np.cumsum([0] + [w.n_texts for _, w, _ in group])
    text = np.concatenate([w.text + b for (_, w, _), b in zip(group, base)])
    letters, begin, end = (np.concatenate([getattr(w, a) for _, w, _ in group]) for a in ("letters", "begin", "end"))
    L = max(1, len(m.languages))
    if m.languages:
        label = viterbi(np.concatenate([s for *_, s in group]), np.bincount(text, minlength=n_texts), penalty).astype(np.int64)
    else:
        label, text = np.zeros(0, np.int64), text[:0]
    told = np.concatenate([m.admits[w.script].any(1) for _, w, _ in group])[: len(text)]  # words in a script of some learned language
    share = np.bincount(text * L + label, letters[: len(text)] * told, n_texts * L).reshape(n_texts, L)
    total = np.bincount(text, letters[: len(text)], n_texts)
    best = share.argmax(1)
    names = np.array([*m.languages, "und"], object)
    lang = np.where(total > 0, best, len(m.languages))
    score = np.where(total > 0, share[np.arange(n_texts), best] / np.maximum(total, 1), 0.0)
    label = np.where(told, label, len(m.languages))
    new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    last = np.append(new[1:], len(text))[: len(new)] - 1
    spans = pa.StructArray.from_arrays([pa.array(begin[new].astype(np.int32)), pa.array(end[last].astype(np.int32)), pa.array(names[label[new]], pa.string())], names=["start", "end", "lang"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=n_texts))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.array(names[lang], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["doc_id", "lang", "score", "spans"])

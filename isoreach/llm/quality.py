"""Counts of words and lines, and divergence from the histograms of a language.

Every language of the corpus has two reference histograms, over all its rows: character classes, and
its COMMON most frequent words with one place for the rest. A document is compared with each language
by Jensen-Shannon distance (base 2, so 0 to 1), and the nearest language counts. The limit on the word
distance falls with the number of words, since a short text cannot show the whole histogram; texts
under the minimum lengths are not judged by divergence at all.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.llm.blocks import blocks, tidy

COMMON = 100
CLASS_LIMIT, CLASS_CHARS = 0.28, 200
WORD_LIMIT, WORD_SLACK, WORD_LEAST = 0.42, 0.6, 50
#: Distinct words that a task holds before it hands its counts on.
HOLD = 200_000
SLICES = 2048
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line end", "symbol", "other sign", "beyond ASCII")
_SPACE = " \t\n\v\f\r"


def _class_of() -> np.ndarray:
    out = np.full(256, 6, np.int8)
    for at, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", SYMBOLS)):
        out[list(chars)] = at
    out[128:192] = -1  # within a code point
    out[192:] = 7
    return out


_CLASS = _class_of()


def class_counts(raw: bytes) -> np.ndarray:
    """Code points of a UTF-8 text by class."""
    if not raw:
        return np.zeros(len(CLASSES))
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)] + 1, minlength=len(CLASSES) + 1)[1:].astype(float)


def plain(word: bytes) -> bytes:
    """A word for the histograms: without the signs around it, ASCII in lower case."""
    return word.strip(b".,;:!?\"'()[]").lower()


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); null has none.

    Words are runs without the six ASCII white-space characters. A line counts as a copy if it holds a
    word and equals an earlier line. Words count as repeated in windows of three that the text holds
    twice or more, the first window included.
    """
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACE))
    n_symbols = sum(raw.count(s) for s in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            seen.add(line)
    repeat = 0
    if n > 3 and (len(dup3 := set(zip(words, words[1:], words[2:]))) < n - 2):
        windows = list(zip(words, words[1:], words[2:]))
        del dup3
        often = {w for w, k in Counter(windows).items() if k > 1}
        hit = np.zeros(n + 2, bool)
        at = np.flatnonzero(np.fromiter((w in often for w in windows), bool, n - 2))
        hit[at] = hit[at + 1] = hit[at + 2] = True
        repeat = int(hit.sum())
    return n, word_chars, n_symbols, dup, repeat


class References:
    """Histograms by language, in ascending order of the languages."""

    def __init__(self, languages: list[str], classes: np.ndarray, words: list[list[tuple[bytes, int]]], totals: list[int]):
        self.languages = languages
        self.classes = classes / np.maximum(classes.sum(1, keepdims=True), 1) if languages else classes
        self.index: dict[bytes, int] = {}
        for own in words:
            for w, _ in own:
                self.index.setdefault(w, len(self.index))
        width = len(self.index) + 1
        self.word_share = np.zeros((len(languages), width))
        self.common = np.zeros((len(languages), width), bool)
        for k, own in enumerate(words):
            for w, c in own:
                self.word_share[k, self.index[w]] = c / max(totals[k], 1)
                self.common[k, self.index[w]] = True
        self.common[:, -1] = True
        self.word_share[:, -1] = 1 - self.word_share.sum(1)

    def distances(self, raw: bytes) -> tuple[str | None, float, float]:
        """(nearest language, its class distance, its word distance) of a text with a word; the least sum of both, ties to the earlier language."""
        if not self.languages:
            return None, 0.0, 0.0
        c = class_counts(raw)
        by_class = js_distance(c[None, :] / max(c.sum(), 1), self.classes)
        get = self.index.get
        rest = len(self.index)
        at = np.fromiter((get(plain(w), rest) for w in raw.split()), np.int64)
        h = np.bincount(at, minlength=rest + 1) / max(len(at), 1)
        own = np.where(self.common, h[None, :], 0.0)
        own[:, -1] += 1 - own.sum(1)  # words common only elsewhere belong to the rest
        by_word = js_distance(own, self.word_share)
        k = int((by_class + by_word).argmin())
        return self.languages[k], float(by_class[k]), float(by_word[k])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The root of the Jensen-Shannon divergence in bits, by row."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> References:
    """References over all rows that have a text and a language; none of either gives no reference.

    Tasks count words by language and hand on sums; Spark adds them up and keeps the ``common`` most
    frequent of each language (ties: the lesser word), so the driver gets ``common`` rows a language.
    """

    def counted(batches):
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def flush():
            for lang, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for part in blocks(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = text.encode("utf-8", "replace")
                    held.setdefault(lang, Counter()).update(raw.split())
                    classes[lang] = classes.get(lang, 0) + class_counts(raw)
                if sum(map(len, held.values())) > HOLD:
                    # spellings of one word meet here already
                    for lang, own in held.items():
                        merged: Counter = Counter()
                        for w, n in own.items():
                            merged[plain(w)] += n
                        held[lang] = merged
                    yield from flush()
        for lang, own in held.items():
            merged = Counter()
            for w, n in own.items():
                merged[plain(w)] += n
            held[lang] = merged
        yield from flush()
        for lang, own in classes.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([b"\n%d" % k for k in range(len(own))], pa.binary()), pa.array(own.astype(np.int64))], names=["lang", "word", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(tidy(counted), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The most frequent of a language without one window over its words: the best of each slice, then the best of these.
    sums = sums.withColumn("class", F.col("word").startswith(F.lit(b"\n"))).withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(SLICES)))
    slices, whole = Window.partitionBy("lang", "class", "slice"), Window.partitionBy("lang", "class")
    top = sums.withColumn("r", F.row_number().over(slices.orderBy(F.desc("n"), "word"))).withColumn("of_slice", F.sum("n").over(slices)).where(F.col("r") <= common)
    top = top.withColumn("total", F.sum(F.when(F.col("r") == 1, F.col("of_slice"))).over(whole)).where("class or word <> X''").withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), "word")))
    got = top.where((F.col("r") <= common) | F.col("class")).select("lang", "word", "n", "class", "total").toArrow().to_pylist()
    languages = sorted({r["lang"] for r in got})
    classes = np.zeros((len(languages), len(CLASSES)))
    words: list[list[tuple[bytes, int]]] = []
    totals: list[int] = []
    for k, lang in enumerate(languages):
        own = [r for r in got if r["lang"] == lang]
        for r in own:
            if r["class"]:
                classes[k, int(r["word"][1:])] = r["n"]
        totals.append(max((r["total"] for r in own if not r["class"]), default=0))
        words.append(sorted(((r["word"], r["n"]) for r in own if not r["class"]), key=lambda x: (-x[1], x[0])))
    return References(languages, classes, words, totals)


def judge(docs: DataFrame, refs: References, id_col: str = "doc_id", text_col: str = "text", class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, language, class_distance, word_distance, kept for every row.

    ``base_failed``: under 50 words, or over half of them repeated. ``kept`` is false then and where a
    distance is over its limit. Null and empty texts have zero counts and null distances and are not
    kept. Without references only the base decides. Repeated rows stay; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(refs)  # some hundred words a language
    kind = docs.schema[id_col].dataType.simpleString()

    def judged(batches):
        r = held.value
        for batch in batches:
            for part in blocks(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    n, chars, signs, dup, repeat = base_counts(text)
                    failed = n < 50 or 100 * repeat > 50 * n
                    lang, by_class, by_word = r.distances(text.encode("utf-8", "replace")) if n else (None, None, None)
                    kept = not failed
                    if kept and lang is not None:
                        kept = not (len(text) >= CLASS_CHARS and by_class > class_limit or n >= WORD_LEAST and by_word > word_limit + WORD_SLACK / n**0.5)
                    rows.append((n, chars, signs, dup, repeat, failed, lang, by_class, by_word, kept))
                cols = list(zip(*rows))
                types = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "language", "class_distance", "word_distance", "kept"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, language string, class_distance double, word_distance double, kept boolean"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(judged), schema)

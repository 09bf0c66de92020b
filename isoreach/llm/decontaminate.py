"""Benchmark passages in documents, by pieces that must survive a few edits.

Texts are compared as lower-case words with single spaces. A test item of length n may differ by a
budget of k = floor(n * ERROR_RATE) edits; cut into k + 1 pieces, at least one piece of any such
occurrence is untouched (pigeonhole). An Aho-Corasick automaton over all pieces finds piece hits in one
pass over a document, and each hit's window is verified with Myers' bit-parallel distance. Items under
LEAST_CHARS characters have no budget and must stand as whole words. Documents stay where they are:
nothing is shuffled, and a passage that a third of all documents hold costs each of them only its own
verification. Items go out in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from isoreach.llm.blocks import blocks, map_rows, tidy

ERROR_RATE = 0.08
#: Shorter items are phrases of everyday text.
LEAST_CHARS = 24
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    """Lower-case runs of letters and digits, parted by single spaces."""
    return " ".join(_WORD.findall((text or "").lower()))


def pieces_of(item: str, rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """(budget, (offset, piece) by offset): budget + 1 pieces of nearly equal length, no more than there are characters."""
    k = min(int(len(item) * rate), len(item) - 1) if len(item) >= LEAST_CHARS else 0
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def masks(pattern: str) -> dict[str, int]:
    """Bit i of a character's mask: the pattern has it at i."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: str, text: str, limit: int, peq: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(least edits of the pattern against any part of the text, end of the first such part); None over ``limit``.

    Myers' bit-vector recurrence with the pattern in one Python integer of any length.
    """
    m = len(pattern)
    if not m:
        return (0, 0)
    peq = masks(pattern) if peq is None else peq
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # a match may begin anywhere in the text
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if best <= limit else None


class Finder:
    """An automaton over the pieces of some items; an item goes by its place among them."""

    def __init__(self, items: list[str | None], rate: float = ERROR_RATE):
        import ahocorasick

        self.items, owners = {}, {}
        for i, text in enumerate(items):
            t = normal(text)
            if not t:
                continue
            k, parts = pieces_of(t, rate)
            self.items[i] = (t, k, masks(t))
            if len(t) < LEAST_CHARS:
                parts = [(-1, f" {t} ")]  # whole words
            for at, p in parts:
                owners.setdefault(p, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for p, who in owners.items():
            self.automaton.add_word(p, (len(p), who))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, edits, end in the normal text) of each item that the text holds, its best place, by item."""
        if not len(self.automaton):
            return []
        found: dict[int, tuple[int, int]] = {}
        done: dict[int, set[int]] = {}  # the begins of the windows that are verified; all windows of an item are equally long
        for end, (n, who) in self.automaton.iter(f" {text} "):  # places are one more than in the text, so ``end`` is exclusive there
            for item, at in who:
                pattern, k, peq = self.items[item]
                if found.get(item, (1, 0))[0] == 0:
                    continue
                whole = end - n - at  # where the item begins if nothing before the piece is edited
                if whole >= 0 and text.startswith(pattern, whole) and len(pattern) >= LEAST_CHARS or at < 0:
                    found[item] = (0, whole + len(pattern))
                    continue
                tried = done.setdefault(item, set())
                if whole in tried:
                    continue
                tried.add(whole)
                lo = max(0, whole - k)
                hit = myers(pattern, text[lo : max(0, whole + len(pattern) + k)], k, peq)
                if hit and hit[0] < found.get(item, (k + 1, 0))[0]:
                    found[item] = (hit[0], lo + hit[1])
        return [(i, *found[i]) for i in sorted(found)]


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES, least_chars: int = 0):
    """The distinct items (id, text) in lists of about ``limit`` bytes; without null texts and normal texts under ``least_chars`` characters or without a word."""
    held, size = [], 0
    for r in items.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null").distinct().orderBy("i", "t").toLocalIterator():
        if len(normal(r.t)) < max(1, least_chars):
            continue
        held.append((r.i, r.t))
        size += len(r.t.encode())
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE, item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, edits, end for each item that a row's text holds within its budget; ``end`` counts characters of the normal text.

    Rows whose text is null, empty or clean give nothing; repeated rows give their hits again; rows with
    a null id keep it. An empty table on either side gives no rows. Each distinct (id, text) of the items
    is searched for by itself, so an id that repeats with several texts or is null may give several rows,
    and item rows that repeat give one. Items without a word are nowhere. Other columns are ignored.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, edits int, end int"
    item_type = to_arrow_type(item_kind)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    out = None
    for held in item_blocks(items, item_col):
        sent = docs.sparkSession.sparkContext.broadcast((held, rate))  # BLOCK_BYTES at most, and one item

        def searched(batches, sent=sent):
            items, rate = sent.value
            finder = Finder([t for _, t in items], rate)
            for batch in batches:
                for part in blocks(batch):
                    at, hits = [], []
                    for i, text in enumerate(part.column(1).to_pylist()):
                        for h in finder.find(normal(text)):
                            at.append(i)
                            hits.append(h)
                    who, edits, ends = list(zip(*hits)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([items[k][0] for k in who], item_type), pa.array(edits, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "item_id", "edits", "end"])

        own = rows.mapInArrow(tidy(searched), schema)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows whose text holds no item within its budget; null and empty texts stay, all columns as they are. Nothing is shuffled.

    Items under ``least_chars`` characters remove nothing, since a clean text may hold so short a phrase;
    ``contaminated`` reports them. Ids of the items, null or repeated, play no part. Repeated rows are
    judged alike, an empty table of items removes nothing.
    """
    out = docs
    at_text = docs.columns.index(text_col)
    for held in item_blocks(items, least_chars=least_chars):
        sent = docs.sparkSession.sparkContext.broadcast(([t for _, t in held], rate))  # BLOCK_BYTES at most, and one item
        out = map_rows(out, tidy(_cleaning(sent, f"c{at_text}", at_text)), docs.schema)
    return out


def _cleaning(sent, text_col: str, at_text: int):
    def clean(batches):
        finder = Finder(*sent.value)
        for batch in batches:
            for part in blocks(batch, text_col):
                yield part.filter(pa.array([not finder.find(normal(t)) for t in part.column(at_text).to_pylist()], pa.bool_()))

    return clean

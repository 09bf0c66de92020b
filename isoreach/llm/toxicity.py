"""Toxicity by a factorization machine over hashed terms.

Terms are words in lower case and their first PREFIXES bytes, once for being there and again for each
RATES share of the words they reach, hashed to BINS. Of the bins, those that differ between the labels
in the fitting rows stay (the largest chi-square values); the machine learns a weight and RANK factors
for each, so two terms that mean little alone, such as an insult and the mention of a group, score
together. Scores are probabilities, shifted so that 0.5 parts the labels best in the fitting rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.blocks import blocks, lowered, mix, tidy, word_hashes, words_of

BINS = 1 << 20
PREFIXES = (5, 6, 7, 8, 9)
RATES = (0.01, 0.025)
CHOSEN = 2048
LEAST_CHI = 12.0
RANK = 4
EPOCHS = 12
#: Labelled rows that the machine is fitted on, about, of each label.
FIT_ROWS = 6000
#: Terms of a fitting row that the driver gets at most, those of the least hash; all terms count in a score.
FIT_TERMS = 4096


def terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of the distinct terms of each text, by text and bin. Null is empty."""
    buf, starts, ends, of = words_of(lowered(texts))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_words = np.bincount(of, minlength=len(texts))
    values, owners = [word_hashes(buf, starts, ends)], [of]
    for k in PREFIXES:
        long_ = ends - starts > k
        values.append(word_hashes(buf, starts[long_], starts[long_] + k) ^ np.uint64(k))
        owners.append(of[long_])
    doc = np.concatenate(owners)
    bins = (mix(np.concatenate(values)) & np.uint64(BINS - 1)).astype(np.int64)
    key, count = np.unique(doc * BINS + bins, return_counts=True)
    share = count / n_words[key // BINS]
    out = [key]
    for i, r in enumerate(RATES):
        some = key[(share >= r) & (count > 1)]
        out.append(some // BINS * BINS + (mix((some % BINS).astype(np.uint64) + np.uint64((i + 1) * BINS)) & np.uint64(BINS - 1)).astype(np.int64))
    key = np.unique(np.concatenate(out))
    return key // BINS, key % BINS


class Machine:
    """Chosen bins with weights w and factors v; bias w0."""

    def __init__(self, chosen: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.place = np.full(BINS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.w0, self.w, self.v = w0, w, v

    def raw(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        s = self.w0 + np.bincount(doc, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            s += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return s

    def score(self, texts: list) -> np.ndarray:
        doc, bins = terms(texts)
        at = self.place[bins]
        return 1 / (1 + np.exp(-np.clip(self.raw(doc[at >= 0], at[at >= 0], len(texts)), -30, 30)))


def fit_machine(doc: np.ndarray, bins: np.ndarray, label: np.ndarray, seed: int = 0) -> Machine:
    """Fits on term lists (by document) and labels 0 and 1, by AdaGrad on the logistic loss; rows of the rarer label weigh more."""
    n, n1 = len(label), int(label.sum())
    if not n or n1 in (0, n):
        rate = float(np.clip(n1 / n, 0.01, 0.49) if n else 0.01)
        return Machine(np.zeros(0, np.int64), float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, RANK)))
    df1 = np.bincount(bins, label[doc], BINS)
    df = np.bincount(bins, minlength=BINS).astype(float)
    expect = df * n1 / n
    spread = expect * (1 - n1 / n) * (1 - df / n)
    chi = np.where(df >= 4, (df1 - expect) ** 2 / np.maximum(spread, 1e-9), 0)
    order = np.argsort(-chi, kind="stable")[:CHOSEN]
    chosen = np.sort(order[chi[order] >= LEAST_CHI])
    rng = np.random.default_rng(seed)
    m = Machine(chosen, float(np.log(n1 / (n - n1))), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), RANK)))
    at = m.place[bins]
    doc, at = doc[at >= 0], at[at >= 0]
    edges = np.searchsorted(doc, np.arange(n + 1))
    weight = np.where(label == 1, min(4.0, (n - n1) / n1) ** 0.5, 1.0)
    gw, gv, g0 = np.full(len(chosen), 1e-6), np.full((len(chosen), RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        deal = rng.permutation(n)
        for part in np.array_split(deal, max(1, n // 128)):
            size = edges[part + 1] - edges[part]
            idx = at[np.repeat(edges[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            row = np.repeat(np.arange(len(part)), size)
            sums = np.stack([np.bincount(row, m.v[idx, f], len(part)) for f in range(RANK)], 1)
            z = np.clip(m.raw(row, idx, len(part)), -30, 30)
            err = (1 / (1 + np.exp(-z)) - label[part]) * weight[part] / len(part)
            d0 = err.sum()
            dw = np.bincount(idx, err[row], len(chosen)) + 1e-4 * m.w
            own = err[row][:, None] * (sums[row] - m.v[idx])
            dv = np.stack([np.bincount(idx, own[:, f], len(chosen)) for f in range(RANK)], 1) + 1e-4 * m.v
            g0 += d0 * d0
            gw += dw * dw
            gv += dv * dv
            m.w0 -= 0.1 * d0 / g0**0.5
            m.w -= 0.1 * dw / np.sqrt(gw)
            m.v -= 0.03 * dv / np.sqrt(gv)
    z = m.raw(doc, at, n)
    ranked = np.argsort(-z, kind="stable")
    hit = np.cumsum(label[ranked])
    f1 = 2 * hit / (np.arange(1, n + 1) + n1)
    best = int(f1.argmax())
    below = z[ranked[best + 1]] if best + 1 < n else z[ranked[best]] - 1
    m.w0 -= float(np.clip((z[ranked[best]] + below) / 2, -6, 6))
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, terms_a_row: int = FIT_TERMS) -> Machine:
    """A machine from the rows whose id has a label of 0 or 1, about ``rows`` of each label by a hash of the id.

    The driver gets no texts but term lists of ``terms_a_row`` terms at most, and 4 * ``rows`` lists at most,
    by the same hash, also where ids of documents repeat. Several labels of one id count as the largest.
    No rows of a label, or an empty table: a constant under 0.5. Null texts have no term.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r.label: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    for k in (0, 1):
        if sizes.get(k, 0) > rows:
            marks = marks.where((F.col("label") != k) | (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rows / sizes[k] * (1 << 20))))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id").select("text", "label", F.xxhash64("id", "text").alias("h"))  # about 2 * rows ids at most, so no text is shuffled

    def listed(batches):
        for batch in batches:
            for part in blocks(batch):
                doc, bins = terms(part.column(0).to_pylist())
                if len(doc) > terms_a_row:
                    order = np.lexsort((mix(bins.astype(np.uint64)), doc))
                    own = np.bincount(doc, minlength=part.num_rows)
                    rank = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
                    some = np.sort(order[rank < terms_a_row])
                    doc, bins = doc[some], bins[some]
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges), pa.array(bins.astype(np.int32))), part.column(1), part.column(2)], names=["bins", "label", "h"])

    got = chosen.mapInArrow(tidy(listed), "bins array<int>, label int, h long").orderBy("h").limit(4 * rows).toArrow().combine_chunks()
    lists = got.column("bins").combine_chunks() if got.num_rows else None
    if lists is None:
        return fit_machine(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    bins, n = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
    # one order whatever the tasks' order
    label = got.column("label").to_numpy().astype(float)
    edges = np.concatenate([[0], np.cumsum(n)])
    key = np.array([int(b[:8].sum()) if len(b) else 0 for b in np.split(bins, edges[1:-1])])
    order = np.lexsort((key, n, label))
    parts = np.split(bins, edges[1:-1])
    return fit_machine(np.repeat(np.arange(len(n)), n[order]), np.concatenate([parts[i] for i in order]), label[order])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every row; null and empty texts get the score of no term. Repeated rows stay, null ids too; an empty table gives no rows. Other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # CHOSEN bins and a table of BINS places
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(part.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(scored), f"doc_id {kind}, score double")

"""Token ids in grammar-compressed files.

Documents are range-partitioned and sorted by id and a hash of the text, and each partition writes
blocks. A block is compressed by Re-Pair in batches: a round counts the neighbouring pairs of symbols,
gives every pair with at least one in SHARE of the most uses (and at least LEAST_USES) a nonterminal, and
replaces them from the left; the next round sees the new symbols. Rounds go on until no pair has
LEAST_USES uses that do not overlap. Rules only name symbols of earlier rounds and are stored with their
expansion lengths, and the running sum of these lengths over a block's symbols finds the symbol that
holds any token: a document is decoded without its neighbours.

Block layout (little-endian): ``RPR2``, then uint32 counts of terminals, rules, symbols and the bytes of
a symbol; uint64 ids; uint32 rules (left, right); uint32 expansion lengths; symbols. Blocks are rows of a
Parquet table in the shared folder: block, first_doc, last_doc, doc_ids, lengths, n_ids, payload.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoreach.functions.shared import shared_path
from isoreach.llm.blocks import blocks, tidy
from isoreach.llm.bpe import Codec, ragged

BLOCK_IDS = 1 << 19
LEAST_USES = 8
SHARE = 32
_HEAD = struct.Struct("<4sIIIIQ")
#: Pairs of up to so many occurrences are served one by one if any of them has too few uses apart from the others.
FEW_USES = 1 << 15
#: Bits of a place of the hash tables of pairs, at most, and the factors of either table.
_SLOT_BITS = 18
_FACTORS = (0x9E3779B1, 0x85EBCA6B), (0xC2B2AE35, 0x27D4EB2F)
#: Bytes of the table for a partition of the files.
PARTITION_BYTES = 128 << 20
MOST_PARTITIONS = 100_000
#: Blocks whose starts are broadcast; of more the payloads are shuffled to them.
SMALL_BLOCKS = 500_000


def _apart(at: np.ndarray) -> np.ndarray:
    """Of ascending places those where no other begins one place before: in a run every other one, from the left."""
    first = np.ones(len(at), bool)
    first[1:] = at[1:] - at[:-1] != 1
    run = np.flatnonzero(first)
    odd = (at & 1).astype(bool)
    return odd == np.repeat(odd[run], np.diff(run, append=len(at)))


def _slots(left: np.ndarray, right: np.ndarray, factors: tuple[int, int], bits: int) -> np.ndarray:
    return ((left * np.uint32(factors[0]) ^ right * np.uint32(factors[1])) >> np.uint32(32 - bits)).astype(np.intp)


def frequent_pairs(s: np.ndarray, least: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as left << 32 | right, place of each occurrence, pair of each occurrence) of the pairs with enough uses; places.

    ``live`` are the ascending places of all pairs that may have ``least`` uses; the last result are those
    of them that still may. A place of either hash table rules out what is rare; where one holds several
    pairs these are counted one by one. Enough is ``least``, and one in SHARE of the most that a place of
    the first table holds. A pair that overlaps itself needs ``least`` uses that do not.
    """
    after = s[1:]
    bits = min(max(len(live).bit_length() + 1, 10), _SLOT_BITS)
    h = _slots(s.take(live), after.take(live), _FACTORS[0], bits)
    count = np.bincount(h, minlength=1 << bits)
    limit = max(least, int(count.max()) // SHARE)
    while True:
        at = live[(count >= limit).take(h)]
        slot = _slots(s.take(at), after.take(at), _FACTORS[1], bits)
        held = (np.bincount(slot, minlength=1 << bits) >= limit).take(slot)
        at, slot = at[held], slot[held]
        pair = s.take(at).astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= after.take(at)
        name, mixed = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
        name[slot] = pair
        mixed[slot[name.take(slot) != pair]] = True
        full = np.zeros(1 << bits, bool)
        full[slot] = True
        alone = np.flatnonzero(full & ~mixed)
        number = np.full(1 << bits, -1, np.int32)
        number[alone] = np.arange(len(alone), dtype=np.int32)
        which = number.take(slot)
        rest = np.flatnonzero(mixed.take(slot))
        more, back, n = np.unique(pair[rest], return_inverse=True, return_counts=True)
        good = n >= limit
        which[rest] = np.where(good, len(alone) + np.cumsum(good) - 1, -1)[back]
        pairs = np.concatenate([name[alone], more[good]])
        del slot, pair, rest, back  # a block of one long text may be large
        of = which >= 0
        at, which = at[of], which[of]
        twin = pairs >> np.uint64(32) == pairs & np.uint64(0xFFFFFFFF)
        own = np.flatnonzero(twin[which])
        weak = twin & (np.bincount(which[own[_apart(at[own])]], minlength=len(pairs)) < least)
        if not weak.all() or limit == least:
            alive = live[(count >= least).take(h)]
            if weak.any():
                stay = ~weak[which]
                alive = np.delete(alive, np.searchsorted(alive, at[~stay]))
                pairs, at, which = pairs[~weak], at[stay], (np.cumsum(~weak) - 1)[which[stay]]
            return pairs, at, which, alive
        limit = max(least, limit // SHARE)


def _one_by_one(pair: np.ndarray, at: np.ndarray, which: np.ndarray, size: int, least: int) -> np.ndarray:
    """Of occurrences those to replace if pairs are served one after the other, the most frequent first."""
    taken, free = np.zeros(size, bool), np.zeros(len(at), bool)
    n = np.bincount(which, minlength=len(pair))
    order, ends = np.argsort(which, kind="stable"), np.cumsum(n).tolist()
    twin = (pair >> np.uint64(32) == pair & np.uint64(0xFFFFFFFF)).tolist()
    for p in np.argsort(-n, kind="stable").tolist():
        own = order[ends[p - 1] if p else 0 : ends[p]]
        x = at[own]
        own = own[~(taken[x] | taken[x + 1])]
        if twin[p]:
            own = own[_apart(at[own])]
        if len(own) >= least:
            free[own] = True
            x = at[own]
            taken[x] = taken[x + 1] = True
    return free


def compress(ids: np.ndarray, terminals: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray]:
    """(rules as rows left, right; symbols). ids are below ``terminals``; rule k is the symbol terminals + k.

    A replacement makes pairs with the new symbol only and takes uses from all others, so a pair found
    rare stays rare: a round looks at the places of the pairs that were not, and beside the new symbols.
    """
    s = ids.astype(np.uint32)
    rules: list[np.ndarray] = [np.zeros((0, 2), np.uint32)]
    made = 0
    live = np.arange(max(len(s) - 1, 0))
    while len(live) >= least:
        pair, at, which, live = frequent_pairs(s, least, live)
        if not len(pair):
            break
        free = _apart(at)
        uses = np.bincount(which[free], minlength=len(pair))
        if uses.max() < least or len(at) <= FEW_USES and (uses < least).any():  # they overlap one another
            free = _one_by_one(pair, at, which, len(s), least)
            uses = np.bincount(which[free], minlength=len(pair))
        good = uses >= least
        free &= good[which]
        at = at[free]
        s[at] = (terminals + made + np.cumsum(good) - 1).astype(np.uint32)[which[free]]
        keep, near = np.ones(len(s), bool), np.zeros(len(s), bool)
        keep[at + 1] = False
        near[live] = near[at] = near[np.maximum(at - 1, 0)] = True
        s, near = s[keep], near[keep]
        near[-1] = False
        live = np.flatnonzero(near)
        rules.append(np.stack([pair[good] >> np.uint64(32), pair[good] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += int(good.sum())
    return np.concatenate(rules), s


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for."""
    length, done = np.ones(terminals + len(rules), np.int64), 0
    for to in _levels(rules, terminals):
        length[terminals + done : terminals + to] = length[rules[done:to]].sum(1)
        done = to
    return length[terminals:]


def _levels(rules: np.ndarray, terminals: int):
    """Ends of runs of rules that only name symbols from before the run."""
    done = 0
    top = rules.max(1) if len(rules) else rules
    while done < len(rules):
        known = np.flatnonzero(top[done:] >= terminals + done)
        done = done + int(known[0]) if len(known) else len(rules)
        yield done


class Grammar:
    """Rules with their expansions, and the symbols of one block."""

    def __init__(self, payload: bytes):
        magic, self.terminals, n_rules, n_symbols, width, self.n_ids = _HEAD.unpack_from(payload)
        if magic != b"RPR2":
            raise ValueError("not a block of grammar-compressed ids")
        rules = np.frombuffer(payload, "<u4", 2 * n_rules, _HEAD.size).reshape(-1, 2)
        t = self.terminals
        self.length = np.ones(t + n_rules, np.int64)
        self.length[t:] = np.frombuffer(payload, "<u4", n_rules, _HEAD.size + 8 * n_rules)
        wide = np.zeros((n_symbols, 4), np.uint8)
        wide[:, :width] = np.frombuffer(payload, np.uint8, n_symbols * width, _HEAD.size + 12 * n_rules).reshape(-1, width)
        self.symbols = wide.view("<u4").reshape(-1)
        self.at = np.concatenate([np.arange(t), t + np.cumsum(self.length[t:]) - self.length[t:]])
        done = 0
        self.flat = np.empty(t + int(self.length[t:].sum()), np.uint32)
        self.flat[:t], filled = np.arange(t), t
        for to in _levels(rules, t):  # as many rules at once as name only symbols that are known
            parts = rules[done:to].reshape(-1)
            new = self.flat[ragged(self.at[parts], self.length[parts])]
            self.flat[filled : filled + len(new)] = new
            done, filled = to, filled + len(new)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids at begin to end of the block; only the symbols that hold them are expanded."""
        end = self.n_ids if end is None else end
        if begin == 0 and end == self.n_ids:
            return self.flat[ragged(self.at[self.symbols], self.length[self.symbols])]
        upto = np.cumsum(self.length[self.symbols])
        a, b = np.searchsorted(upto, [begin, end - 1], side="right") if end > begin else (0, -1)
        some = self.symbols[a : b + 1]
        before = int(upto[a] - self.length[self.symbols[a]]) if len(some) else 0
        return self.flat[ragged(self.at[some], self.length[some])][begin - before : end - before]


def to_payload(ids: np.ndarray, terminals: int, least: int = LEAST_USES) -> bytes:
    rules, symbols = compress(ids, terminals, least)
    width = max(1, (int(terminals + len(rules) - 1).bit_length() + 7) // 8)
    lengths = expansion_lengths(rules, terminals)
    head = _HEAD.pack(b"RPR2", terminals, len(rules), len(symbols), width, len(ids))
    return head + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every text (null: empty), appends ``end_id`` and writes blocks in ascending id order; the table's path.

    Null ids come first and repeated ids lie by a hash of the text and the text; a hot id may lie in several
    partitions. Their number follows the size of the input. Other columns are ignored. An empty table
    writes no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of files; of joins it may be far too large
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(guess // PARTITION_BYTES, MOST_PARTITIONS), 1)

    def written(batches):
        codec = Codec.of(tokenizer)
        own, serial = TaskContext.get().partitionId(), 0
        id_type, held, lengths, ids, size = None, [], [], [], 0

        def flush():
            nonlocal serial, held, lengths, ids, size
            all_ids = pa.chunked_array(held, type=id_type).combine_chunks()
            n_by_doc = np.concatenate(lengths)
            row = [
                pa.array([(own << 32) + serial], pa.int64()), pa.array([own], pa.int32()), all_ids.slice(0, 1), all_ids.slice(len(all_ids) - 1),
                pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                pa.ListArray.from_arrays(pa.array([0, len(n_by_doc)], pa.int32()), pa.array(n_by_doc, pa.int64())),
                pa.array([size], pa.int64()), pa.array([to_payload(np.concatenate(ids), codec.size)], pa.binary()),
            ]
            serial, held, lengths, ids, size = serial + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in row], names=["block", "part", "first_doc", "last_doc", "doc_ids", "lengths", "n_ids", "payload"])

        for batch in batches:
            id_type = batch.column(0).type
            for part in blocks(batch):
                got, k = codec.encode([(t or "").encode() for t in part.column(1).to_pylist()])
                k = k.astype(np.int64)
                ends = np.cumsum(k)
                ids.append(np.insert(got, ends, end_id))
                held.append(part.column(0))
                lengths.append(k + 1)
                size += len(got) + len(k)
                if size >= BLOCK_IDS:
                    yield flush()
        if size:
            yield flush()

    path = shared_path(spark, "token-ids")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    rows.mapInArrow(tidy(written), f"block long, part int, first_doc {kind}, last_doc {kind}, doc_ids array<{kind}>, lengths array<long>, n_ids long, payload binary").write.parquet(path)
    return path


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """block, base: the ids in all blocks before. Sums within the writing partitions and over them."""
    sizes = spark.read.parquet(path).select("block", "part", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select("block", (F.col("part_base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).alias("base"))


def read_ids(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document in the files.

    ``only`` (doc_id) restricts the reading to some documents: blocks without them are skipped and of
    the others just the symbols that hold them are expanded.
    """
    table = spark.read.parquet(path)
    kind = table.schema["first_doc"].dataType.simpleString()
    starts = block_starts(spark, path)
    if table.count() <= SMALL_BLOCKS:  # two longs a block
        starts = F.broadcast(starts)
    rows = table.join(starts, "block").select("doc_ids", "lengths", "payload", "base")
    if only is not None:
        wanted = only.select(F.col("doc_id").alias("_w")).distinct()
        hits = table.select("block", F.explode("doc_ids").alias("_w")).join(wanted, "_w").groupBy("block").agg(F.collect_set("_w").alias("wanted"))
        rows = table.join(hits, "block").join(starts, "block").select("doc_ids", "lengths", "payload", "base", "wanted")

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column(0).slice(i, 1).flatten()
                n = batch.column(1).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                grammar, base = Grammar(batch.column(2)[i].as_py()), batch.column(3)[i].as_py()
                at = np.cumsum(n) - n
                if batch.num_columns > 4:
                    pick = np.flatnonzero(np.isin(np.array(docs.to_pylist(), object), np.array(batch.column(4)[i].as_py(), object)))
                    parts = [grammar.ids(int(at[k]), int(at[k] + n[k])) for k in pick]
                    docs, n, at = docs.take(pa.array(pick)), n[pick], at[pick]
                    data = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
                else:
                    data = grammar.ids()
                offsets = np.concatenate([[0], np.cumsum(n)]) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([docs, pa.array(base + at, pa.int64()), pa.array(n, pa.int64()), ids], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(tidy(read), f"doc_id {kind}, start long, n_tokens long, ids binary")

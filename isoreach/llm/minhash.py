"""Near duplicates by DartMinHash over weighted word shingles.

Each element (a shingle of five words, weighted by how often it occurs) owns the region [0, weight) of
an axis. Hashed darts fall on the region with a rank, as a Poisson process cut at [0,1), [1,2), [2,4),
and so on; every dart also names one of T coordinates, and a coordinate keeps the dart of least rank.
Two documents agree on a coordinate with the chance of their weighted Jaccard similarity. Darts are
thrown only up to the rank that fills all coordinates, so the work is about the number of elements plus
T log T, and documents with an empty coordinate are thrown again to twice the rank.

Signatures are joined in bands. Documents with equal shingles are one class before that. Within a band
bucket every document meets one hub, another hub in each band, which is linear in the bucket; pairs are
verified exactly on their shingles. Buckets that still hold several classes are then compared in
blocks: by signature, which members may resemble one of another class, and exactly among those. The
blocks of a large bucket with several classes all meet, so its cost grows with the square of its blocks.

A pair of similarity 0.8 is lost with a chance of about 0.0001 in the bands, and of about
1e-8 where the signatures say that it cannot pass (MAY_PASS). Classes are the connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.functions.shared import through_table
from isoreach.llm.blocks import blocks, lowered, mix, tidy, unit, word_hashes, words_of
from isoreach.llm.skew import join_hot
from isoreach.operators.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
THRESHOLD = 0.8
#: Below the threshold by over six standard deviations of an estimate from 120 coordinates.
MAY_PASS = 0.56
BLOCK = 1024
#: Ids that a Bloom filter is made for, and its bits for each.
FILTER_IDS, FILTER_BITS = 4_000_000, 10
SKETCH_BYTES = 4 << 20


def shingles(texts: list, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each text, by text and hash.

    Words are runs of letters and digits in lower case. A text of fewer words than ``width`` has one
    shingle of all its words; a text without words has none.
    """
    buf, starts, ends, of = words_of(lowered(texts))
    h = word_hashes(buf, starts, ends)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float64)
    n_words = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    left = (first + n_words)[of] - np.arange(len(h))  # words from here to the text's end
    long_text = n_words[of] >= width
    at = np.flatnonzero(np.where(long_text, left >= width, np.arange(len(h)) == first[of]))
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = left[at] > k
            value = np.where(there, mix(value * np.uint64(0x100000001B3) ^ h[np.minimum(at + k, len(h) - 1)]), value)
    doc = of[at]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
    return doc[new], value[new], np.diff(new, append=len(doc)).astype(np.float64)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, coordinates: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """A row of least dart ranks for each document; infinite where a document has no weight. Weights are any positive numbers."""
    least = np.full(n_docs * coordinates, np.inf)
    norm = np.bincount(doc, weight, n_docs)
    rank_limit = np.where(norm > 0, (math.log(coordinates) + 2.0) * coordinates / np.maximum(norm, 1e-300), 0)
    pending = norm > 0
    base = mix(element ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    step = np.uint64(0xD1B54A32D192ED03)
    while pending.any():
        own = np.flatnonzero(pending[doc])
        cell = 0
        while len(own):
            low, high = (0.0, 1.0) if cell == 0 else (2.0 ** (cell - 1), 2.0**cell)
            own = own[weight[own] > low]
            at, rank, thrown = own, np.zeros(len(own)), 0
            key = mix(base[at] ^ np.uint64(cell * 0xD1B54A32D192ED03 & (2**64 - 1)))
            limit = rank_limit[doc[at]]
            while len(at):
                k = 1 if len(at) > 20_000 else min(64, 1 + 200_000 // len(at) // 4)  # darts of a throw
                serial = np.arange(thrown, thrown + k, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    u = mix(key[:, None] + (serial * np.uint64(3) + np.uint64(1))[None, :] * step)
                    ranks = rank[:, None] + np.cumsum(-np.log(unit(u)), axis=1) / (high - low)
                    hit = ranks <= limit[:, None]
                    if hit.any():
                        r, c = np.nonzero(hit)
                        v = mix(u[r, c] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                        ok = low + (high - low) * unit(v) <= weight[at[r]]
                        r, c, v = r[ok], c[ok], v[ok]
                        to = doc[at[r]] * coordinates + (mix(v) % np.uint64(coordinates)).astype(np.int64)
                        np.minimum.at(least, to, ranks[r, c])
                on = hit[:, -1]
                at, rank, key, limit = at[on], ranks[on, -1], key[on], limit[on]
                thrown += k
            cell += 1
        pending &= np.isinf(least.reshape(n_docs, coordinates)).any(1)
        rank_limit[pending] *= 2
    return least.reshape(n_docs, coordinates)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(sig), 1), np.uint64)
    for r in range(rows):
        key = mix(key ^ bits[:, :, r])
    return key.view(np.int64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """id, th (a hash of the text), k1, k2 (a 128-bit sum that equal shingles share), bands (array of long), sig (a byte for each coordinate) for every row; the last four are null without a word."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketched(batches):
        for batch in batches:
            for part in blocks(batch, limit=SKETCH_BYTES):
                texts = part.column(1).to_pylist()
                doc, element, weight = shingles(texts, width)
                has = np.bincount(doc, minlength=len(texts)) > 0
                none = pa.array(~has)
                with np.errstate(over="ignore"):
                    sums = []
                    for salt in (0x5BD1E995, 0x1B873593):
                        e = mix(element ^ np.uint64(salt)) * weight.astype(np.uint64)
                        begin = np.flatnonzero(np.diff(doc, prepend=-1))
                        total = np.zeros(len(texts), np.uint64)
                        if len(doc):
                            total[doc[begin]] = np.add.reduceat(e, begin)
                        sums.append(pa.array(total.view(np.int64), mask=~has))
                sig = dart_signatures(doc, element, weight, len(texts), bands * rows)[has]
                keys = _band_keys(sig, bands, rows)
                small = (mix(np.ascontiguousarray(sig).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                at = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), *sums,
                        pa.ListArray.from_arrays(pa.array(at * bands), pa.array(keys.reshape(-1)), mask=none),
                        pa.Array.from_buffers(pa.binary(), len(has), [pa.array(has).buffers()[1], pa.py_buffer(at * (bands * rows)), pa.py_buffer(small.tobytes())]),
                    ],
                    names=["id", "th", "k1", "k2", "bands", "sig"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(tidy(sketched), f"id {kind}, th long, k1 long, k2 long, bands array<long>, sig binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), _text_hash(text).alias("th"))


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    n = len(a)
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(n, -1)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint8).reshape(n, -1)
    return (x == y).mean(1)


def _pack(values: np.ndarray) -> bytes:
    """Six bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _maybe_in(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id and text hash may be among the ``wanted``: all of these and a few others.

    A Bloom filter of FILTER_BITS bits a wanted row, at most 8 MB, goes to the rows, so their texts are not
    shuffled. Over FILTER_IDS wanted rows the rows are joined instead.
    """
    n = wanted.count()
    if n > FILTER_IDS:
        w = wanted.select(F.col("id").alias("_i"), F.col("th").alias("_t"))
        return df.join(w, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left_semi")
    bits = 1 << max(10, (n * FILTER_BITS).bit_length())
    place = lambda k: F.pmod(F.xxhash64("id", "th", F.lit(k)), F.lit(bits))
    words = wanted.select(F.explode(F.array(*map(place, range(4)))).alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    if words.num_rows:
        held[words.column("w").to_numpy()] = words.column("b").to_numpy()
    schema = "bits array<long>"
    row = df.sparkSession.createDataFrame(pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held))}), schema)
    test = F.lit(True)
    for k in range(4):
        test = test & (F.get("bits", (place(k) / 64).cast("int")).bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id, th, {k}), {bits}L) % 64 as int))")) != 0)
    return df.join(F.broadcast(row), test, "left_semi")  # one row


def _lists(texts: DataFrame, reps: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep, list: six bytes for each shingle of a text and each time that it occurs, ascending; of the ``wanted`` (rep)."""
    kind = texts.schema["id"].dataType.simpleString()
    chosen = through_table(reps.select("rep", "id", "th").join(wanted, "rep"), "wanted")

    def listed(batches):
        for batch in batches:
            for part in blocks(batch):
                t = part.column(1).to_pylist()
                doc, element, weight = shingles(t, width)
                times = weight.astype(np.int64)
                nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                value = mix(np.repeat(element, times) ^ mix(nth.astype(np.uint64))) & np.uint64((1 << 48) - 1)
                doc = np.repeat(doc, times)
                order = np.lexsort((value, doc))
                edges = np.searchsorted(doc, np.arange(len(t) + 1)).tolist()
                value = value[order]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([_pack(value[x:y]) for x, y in zip(edges, edges[1:])], pa.binary())], names=["id", "th", "list"])

    made = _maybe_in(texts, chosen).mapInArrow(tidy(listed), f"id {kind}, th long, list binary").withColumnsRenamed({"id": "_i", "th": "_t"})
    named = made.join(chosen, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))).select("rep", "list")
    return through_table(named.dropDuplicates(["rep"]), "shingle-lists")  # rows that repeat


def _passing(pairs: DataFrame, texts: DataFrame, reps: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs a, b whose shingles have at least that weighted Jaccard similarity."""
    lists = _lists(texts, reps, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), width)

    def compared(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common = len(np.intersect1d(_unpack(x), _unpack(y)))
                keep.append(common >= threshold * (len(x) // 6 + len(y) // 6 - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(lists.select(F.col("rep").alias("a"), F.col("list").alias("la")), "a").join(lists.select(F.col("rep").alias("b"), F.col("list").alias("lb")), "b")
    return both.select("a", "b", "la", "lb").mapInArrow(tidy(compared), "a long, b long")


def _common(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each list of ``left`` shares with each of ``right``: products of 0/1 matrices over the values that two lists hold, some columns at a time."""
    every = [*left.tolist(), *[k for k in right.tolist() if k not in set(left.tolist())]]
    value, row = np.concatenate([lists[k] for k in every]), np.repeat(np.arange(len(every)), [len(lists[k]) for k in every])
    u, col, n = np.unique(value, return_inverse=True, return_counts=True)
    shared = n[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    at = {k: i for i, k in enumerate(every)}
    li, ri = np.array([at[k] for k in left.tolist()]), np.array([at[k] for k in right.tolist()])
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(col[-1]) + 1 if len(col) else 0
    for c in range(0, width, 4096):
        a, b = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(every), min(4096, width - c)), np.float32)
        m[row[a:b], col[a:b] - c] = 1.0
        out += m[li] @ m[ri].T
    return out


def _in_blocks(members: DataFrame) -> DataFrame:
    """Every member (bucket, n, rep, component) in the pairs of blocks (i, j) that hold its block; blocks have about BLOCK members."""
    dealt = members.withColumn("blocks", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = dealt.select("bucket", "rep", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component")


def _sides(key, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, comp, own = (np.asarray(table.column(c)) for c in ("rep", "component", "own"))
    i, j = key[1].as_py(), key[2].as_py()
    return ids, comp, np.flatnonzero(own == i), np.flatnonzero(own == j)


def _resembling(key, table):
    """The members of two blocks that may pass with a member of another class."""
    ids, comp, left, right = _sides(key, table)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
    hit = np.zeros(len(ids), bool)
    need = MAY_PASS * sig.shape[1]
    for at in left.tolist():
        rest = right[comp[right] != comp[at]]
        ok = rest[(sig[rest] == sig[at]).sum(1) >= need]
        hit[ok] = True
        hit[at] |= len(ok) > 0
    return pa.table({"bucket": pa.array([key[0].as_py()] * int(hit.sum()), pa.int64()), "rep": pa.array(ids[hit]), "component": pa.array(comp[hit])})


def _joining(threshold: float):
    def joined(key, table):
        """Links a, b that join the classes ca, cb of two blocks: one for each two classes that a passing pair connects, at most."""
        ids, comp, left, right = _sides(key, table)
        lists = [_unpack(x) for x in table.column("list").to_pylist()]
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "ca", "cb")})
        size = np.array([len(x) for x in lists], np.float32)
        common = _common(lists, left, right)
        passing = (common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-3) & (comp[left][:, None] != comp[right][None, :])
        x, y = np.nonzero(passing)
        pair = np.stack([np.minimum(comp[left[x]], comp[right[y]]), np.maximum(comp[left[x]], comp[right[y]])], 1)
        first = np.unique(pair, axis=0, return_index=True)[1] if len(pair) else np.zeros(0, np.int64)
        a, b = ids[left[x[first]]], ids[right[y[first]]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "ca": pa.array(comp[left[x[first]]]), "cb": pa.array(comp[right[y[first]]])})

    return joined


def _links(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """The verified links (a, b) of representatives, and the classes (node, component) that they make."""
    placed = through_table(reps.select("rep", F.explode("bands").alias("bucket")), "placed")
    hubs = through_table(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep")).alias("hub")).where("n > 1").select("bucket", "n", F.col("hub.rep").alias("hub")), "hubs")
    shared = through_table(join_hot(placed, hubs, ["bucket"], "n"), "band-buckets")
    sigs = reps.select("rep", "sig")
    texts = _texts(docs.where(F.col(f"`{text_col}`").isNotNull()), id_col, text_col)

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(_agreement(batch.column(2), batch.column(3)) >= MAY_PASS))

    pairs = shared.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = through_table(pairs.select("a", "b", "sa", "sb").mapInArrow(tidy(likely), "a long, b long"), "hub-pairs")
    links = through_table(_passing(pairs, texts, reps, threshold, width), "links")
    first = through_table(connected_components(links, "a", "b"), "classes")

    # Buckets with several classes: which members may resemble one of another class, by signature, then exactly.
    named = through_table(shared.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("bucket", "n", "rep", "component"), "named")
    mixed = through_table(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi and m > 2").select("bucket", "m"), "mixed")
    open_ = through_table(join_hot(named, mixed, ["bucket"], "m").drop("m"), "open")
    maybe = through_table(_in_blocks(open_).join(sigs, "rep").groupBy("bucket", "i", "j").applyInArrow(_resembling, "bucket long, rep long, component long").distinct(), "resembling")
    if not maybe.isEmpty():
        lists = _lists(texts, reps, maybe.select("rep").distinct(), width)
        sizes = through_table(maybe.groupBy("bucket").agg(F.count("*").alias("n")), "resembling-sizes")
        more = _in_blocks(join_hot(maybe, sizes, ["bucket"], "n")).join(lists, "rep").groupBy("bucket", "i", "j").applyInArrow(_joining(threshold), "a long, b long, ca long, cb long")
        more = through_table(more, "class-links")
        links = through_table(links.unionByName(more.select("a", "b")).distinct(), "links")
        # The classes found are stars already; only their roots have to be joined.
        first = through_table(connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "a", "b"), "classes")
    return links, first


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """id, th (a hash of the text), class_key, class_id, class_size, n_links for every row; see ``near_duplicates``."""
    held = through_table(sketch(docs, id_col, text_col, bands, rows, width), "sketches")
    least = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "th", "bands", "sig")).alias("r")
    reps = held.where("k1 is not null").groupBy("k1", "k2").agg(least, F.count("*").alias("n"))
    reps = through_table(reps.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "n", "r.*"), "representatives")
    links, first = _links(docs, reps, id_col, text_col, threshold, width)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    key = F.concat(F.hex("k1"), F.lit("-"), F.hex("k2"))
    one = F.struct("no_id", "id").alias("one")
    linked = through_table(reps.join(first.join(degree, "node").withColumnRenamed("node", "rep"), "rep").select("rep", "k1", "k2", "n", "component", "n_links", key.alias("key"), one), "linked")
    summed = through_table(linked.groupBy("component").agg(F.count("*").alias("texts"), F.min("key").alias("class_key"), F.min("one").alias("least"), F.sum("n").alias("class_size")), "class-sums")
    named = join_hot(linked, summed, ["component"], "texts").select("k1", "k2", "n", "class_key", F.col("least.id").alias("class_id"), "class_size", "n_links")
    alone = reps.join(first.select(F.col("node").alias("rep")), "rep", "left_anti").select("k1", "k2", "n", key.alias("class_key"), F.col("id").alias("class_id"), F.col("n").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    every = through_table(named.unionByName(alone), "text-classes")
    out = join_hot(held.where("k1 is not null").select("id", "th", "k1", "k2"), every, ["k1", "k2"], "n").select("id", "th", "class_key", "class_id", "class_size", "n_links")
    wordless = held.where("k1 is null").select("id", "th", F.lit(None).cast("string").alias("class_key"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(wordless)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """doc_id, class_id (the least id of its class, null where no member has one), class_size (rows), n_links, class_key for every row.

    Rows without a word (null, empty, only signs) are classes of their own, without a ``class_key``, and so
    are texts that nothing resembles. Rows that repeat stay and are of one class. An id that repeats with
    several texts has a row for each, in the class of that text; two classes may then have one least id,
    and ``class_key`` tells them apart. Rows with a null id are classed like others. ``n_links`` counts the
    verified links of the row's text with other texts that the classes are made of. An empty table gives
    no rows. Other columns are ignored; ids are of any type that has an order.
    """
    return classes(docs, id_col, text_col, threshold, bands, rows, width).select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_links", "class_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one of each class: that of the least id, null ids last, then of the least text hash.

    Of rows with equal id and text the one whose columns come first as JSON stays. Rows without a word
    all stay. All columns are kept, of any type and name. An empty table stays empty.
    """
    found = through_table(classes(docs, id_col, text_col, threshold).select("id", "th", "class_key"), "classed")
    worded = found.where("class_key is not null")
    kept = worded.groupBy("class_key").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "th")).alias("r")).select("r.id", "r.th")
    repeated = worded.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select("id", "th")
    kept = through_table(kept.join(_same(repeated), _agree("id", "th"), "left").select("id", "th", F.col("_th").isNotNull().alias("many")).unionByName(found.where("class_key is null").select("id", "th").distinct().select("id", "th", F.lit(False).alias("many"))), "kept")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col(f"`{id_col}`").alias("_id"), _text_hash(F.col(f"`{text_col}`")).alias("_th"))
    met = rows.join(kept, _agree("id", "th"))
    out = met.where("not many").select("row")
    if not kept.where("many").isEmpty():
        out = out.unionByName(met.where("many").groupBy("id", "th").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select("row.*")


def _same(table: DataFrame) -> DataFrame:
    return table.select(F.col("id").alias("_id"), F.col("th").alias("_th"))


def _agree(id_col: str, th: str):
    return F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(th) == F.col("_th"))

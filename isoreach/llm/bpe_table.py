"""BPE through a table of distinct words, and decoding through a table of pieces.

1. Texts go into chunks of about CHUNK_BYTES by a hash of the id; a chunk lists its distinct pieces
   (see ``bpe``: pieces encode alone) by the hash bucket of the piece, sorted.
2. All lists of a bucket meet in one task: each distinct piece of the corpus is encoded there once.
   The lists come back as ids in the lists' order, and as bytes through a join of the ids with the
   table of pieces, which the tokenizer bounds (some ten thousand rows).
3. A chunk meets its lists again, and the ids and the decoded bytes are put where their pieces stood.

What is shuffled is the texts once, compressed, and each distinct piece of a chunk once each way, not
every word. Pieces are told apart by their bytes: hashes only find the candidates, and two pieces of a
chunk that share a hash are two entries. The number of buckets follows the number of chunks, so a
bucket's table stays the same size on any input; a frequent word is one entry in each chunk. Rows are
dealt to chunks by id and text, so a hot or null id is spread over all chunks, and equal rows are sent
once for each BATCH_BYTES that they are read in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from isoreach.llm.blocks import tidy, trim
from isoreach.llm.bpe import Codec, gather, piece_hashes, piece_starts, ragged, same_bytes

CHUNK_BYTES = 8 << 20
BATCH_BYTES = 8 << 20


class _Pieces:
    """The pieces of some texts: their places, which distinct piece each is, and the distinct ones by (bucket, hash, bytes)."""

    def __init__(self, codec: Codec, texts: list[bytes], buckets: int):
        self.raw = raw = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        buf = np.frombuffer(raw, np.uint8)
        starts = piece_starts(buf, begin[sizes > 0]) if raw else np.zeros(0, np.int64)
        for i, t in enumerate(texts):
            if any(a in t for a in codec.added):  # the library gets the whole text
                starts = starts[(starts <= begin[i]) | (starts >= begin[i] + sizes[i])]
        self.size = np.diff(starts, append=len(buf))
        self.of_text = np.diff(np.searchsorted(starts, np.append(begin, len(raw))))
        h = piece_hashes(buf, starts, self.size) if raw else np.zeros(0, np.uint64)
        u, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        if raw and not self._agree(buf, starts, first).all():
            order = sorted(range(len(h)), key=lambda i: (h[i], raw[starts[i] : starts[i] + self.size[i]]))  # two pieces of one hash
            word = lambda i: raw[starts[i] : starts[i] + self.size[i]]
            new = np.array([k == 0 or h[i] != h[order[k - 1]] or word(i) != word(order[k - 1]) for k, i in enumerate(order)])
            first = np.array(order)[new]
            self.which = np.empty(len(h), np.int64)
            self.which[order] = np.cumsum(new) - 1
            u = h[first]
        del h
        self.which = self.which.astype(np.int32)
        self.bucket = (u % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        self.at, self.n = starts[first], self.size[first]

    def _agree(self, buf: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes of the first one of its hash."""
        rep = first[self.which]
        same = self.size == self.size[rep]
        same[same] = same_bytes(buf, starts[same], buf, starts[rep[same]], self.size[same])
        return same

    def forget(self) -> None:
        """What only the lists need goes, before the texts are put together."""
        self.order = self.bucket = self.at = self.size = None

    def words(self, some: np.ndarray) -> list[bytes]:
        raw = self.raw
        return [raw[a : a + n] for a, n in zip(self.at[some].tolist(), self.n[some].tolist())]

    def lists(self):
        """(bucket, distinct pieces of it) by bucket."""
        own = self.bucket[self.order]
        for part in np.split(self.order, np.flatnonzero(np.diff(own)) + 1) if len(own) else []:
            yield int(self.bucket[part[0]]), part


def _packed(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zlib.compress(len(words).to_bytes(4, "little") + lens + b"".join(words), 1)


def _unpacked(blob: bytes) -> list[bytes]:
    raw = zlib.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    at = 4 + 4 * n
    return [raw[at + a : at + b] for a, b in zip([0, *ends], ends)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(1).to_pylist()]


def _read_chunk(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _by_chunk(held: list[pa.RecordBatch]):
    """Rows by chunk as compressed Arrow streams; rows of equal id and text are one row with their number."""
    if not held:
        return
    rows = pa.Table.from_batches(held)
    rows = rows.group_by(["doc_id", "text", "chunk"], use_threads=False).aggregate([([], "count_all")]).select(["doc_id", "text", "count_all", "chunk"])
    of = rows.column(3).to_numpy()
    for c in np.unique(of).tolist():
        part = rows.filter(pa.array(of == c)).select([0, 1, 2]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(part)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (array of int), decoded (string, what the ids decode to) for every row.

    Null texts are empty: no ids, empty string. Repeated rows and ids stay, null ids too. Other columns
    are ignored. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(16, 4 * chunks)

    def packed(batches):
        """Batches as compressed Arrow streams by chunk."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BATCH_BYTES:
                yield from _by_chunk(held)
                held, size = [], 0
        yield from _by_chunk(held)

    def listed(key, table):
        codec = Codec.of(tokenizer)
        texts = [t for blob in table.column("docs") for t in _texts(_read_chunk(blob.as_py()))]
        p = _Pieces(codec, texts, buckets)
        names, blobs = [], []
        for bucket, part in p.lists():
            names.append(bucket)
            blobs.append(_packed(p.words(part)))
        trim()
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(names), pa.int64()), "bucket": pa.array(names, pa.int64()), "words": pa.array(blobs, pa.binary())})

    def encoded(key, table):
        codec = Codec.of(tokenizer)
        lists = [_unpacked(b.as_py()) for b in table.column("words")]
        words = sorted(set().union(*lists))
        place = {w: i for i, w in enumerate(words)}
        special = [any(a in w for a in codec.added) for w in words]
        order, ids, n = codec.distinct([w for w, odd in zip(words, special) if not odd]) if not all(special) else (np.zeros(0, np.int64), np.zeros(0, codec.dtype), np.zeros(0, np.int64))
        # back to the words' order
        plain = np.flatnonzero(~np.array(special, bool)) if special else np.zeros(0, np.int64)
        count, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        count[plain[order]], at[plain[order]] = n, np.cumsum(n) - n
        odd = np.flatnonzero(np.array(special, bool)) if special else np.zeros(0, np.int64)
        more = codec.whole([words[i].decode("utf-8", "replace") for i in odd])
        for i, x in zip(odd.tolist(), more):
            count[i], at[i] = len(x), len(ids)
            ids = np.concatenate([ids, x])
        out = []
        for own in lists:
            e = np.fromiter((place[w] for w in own), np.int64, len(own))
            out.append(zlib.compress(count[e].astype("<u4").tobytes() + ids[ragged(at[e], count[e])].tobytes(), 1))
        trim()
        return pa.table({"chunk": table.column("chunk").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int64()), "ids": pa.array(out, pa.binary())})

    def joined(left, right):
        codec = Codec.of(tokenizer)
        width = codec.dtype.itemsize
        back = dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist()))
        batches = [_read_chunk(b.as_py()) for b in left.column("docs")]
        p = _Pieces(codec, [t for b in batches for t in _texts(b)], buckets)
        count, at = np.zeros(len(p.n), np.int64), np.zeros(len(p.n), np.int64)
        flat, filled = [np.zeros(0, codec.dtype)], 0
        for bucket, part in p.lists():
            raw = zlib.decompress(back[bucket])
            count[part] = own = np.frombuffer(raw, "<u4", len(part))
            at[part] = filled + np.cumsum(own, dtype=np.int64) - own
            flat.append(np.frombuffer(raw, codec.dtype, (len(raw) - 4 * len(part)) // width, 4 * len(part)))
            filled += len(flat[-1])
        flat = np.concatenate(flat)
        p.forget()
        # the distinct pieces decoded, each once, from their ids
        piece_at, piece_len, piece_flat = codec.piece_table()
        shown = gather(piece_flat, piece_at[flat], piece_len[flat])
        before = np.concatenate([[0], np.cumsum(piece_len[flat])])
        shown_at, shown_n = before[at], before[at + count] - before[at]
        ids = gather(flat, at[p.which], count[p.which]).astype(np.int32)
        decoded = gather(shown, shown_at[p.which], shown_n[p.which])
        edges = np.concatenate([[0], np.cumsum(p.of_text)])
        by_text = lambda n: np.concatenate([[0], np.cumsum(n[p.which])])[edges].astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), len(p.of_text), [None, pa.py_buffer(by_text(shown_n)), pa.py_buffer(decoded)])
        doc_ids = pa.chunked_array([b.column(0) for b in batches], type=batches[0].column(0).type if batches else left_type)
        times = pa.chunked_array([b.column(2) for b in batches], type=pa.int64())
        trim()
        return pa.table({"doc_id": doc_ids, "times": times, "ids": pa.ListArray.from_arrays(pa.array(by_text(count)), pa.array(ids)), "decoded": text})

    left_type = to_arrow_type(docs.schema[id_col].dataType)
    parts = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).mapInArrow(tidy(packed), "chunk long, docs binary").repartition("chunk")
    lists = parts.groupBy("chunk").applyInArrow(listed, "chunk long, bucket long, words binary")
    coded = lists.groupBy("bucket").applyInArrow(encoded, "chunk long, bucket long, ids binary")
    out = parts.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(joined, f"doc_id {kind}, times long, ids array<int>, decoded string")
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")

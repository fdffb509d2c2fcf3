"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the last ``WINDOW`` bytes cuts every text into chunks that depend on content alone,
so a passage that stands in several documents gives the same chunks there.

1. Keys (128-bit hashes) of all chunks are counted; those that occur more than once are *shared*.
2. Each shared chunk is encoded once, by the task that its key is dealt to.
3. Documents without a shared chunk are encoded where they are read.  The others are joined with the
   ids of their shared chunks, and only the rest of their text is encoded.

A chunk's own ids are valid between its first and its last *safe place*: a position before a space or
a line feed, which no token, normalisation or lower-casing step reaches across.  At the join of two
chunks, the text from the last safe place of the left one to the first of the right one is encoded
again, widened over chunks without a safe place; there both sides agree exactly.

Which documents have a shared chunk is told by a bitmap of fixed size (``BITMAP`` bits, broadcast): a
bit set by accident only sends a document the longer way.  So texts without shared chunks are never
shuffled.

Edge cases: a null text counts as empty and has no ids; a null id is a value like any other; repeated
rows are encoded as often as they occur; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcode.llm.common import python_tasks, stored
from spendcode.llm.tokens import word_encoder

WINDOW = 8
CHUNK_BITS = 9  # a cut about every 512 bytes
LEAST = 128     # bytes of a chunk at least
BITMAP = 1 << 26
_STEP = 1 << 20


def cut_places(data: bytes) -> list[int]:
    """Ends of the chunks of a text but the last, by a rolling hash of the bytes before them."""
    places, last = [], 0
    for at in range(0, len(data) - WINDOW + 1, _STEP):
        b = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(_STEP + WINDOW - 1, len(data) - at)).astype(np.uint64)
        two = b[:-1] | b[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        mixed = eight * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CHUNK_BITS)
        for p in (np.flatnonzero(mixed == 0) + at + WINDOW).tolist():
            if p - last >= LEAST and p < len(data):
                places.append(p)
                last = p
    return places


def safe_spans(data: bytes) -> list[tuple[int, int]]:
    """From first to last safe place of each chunk, where there are two."""
    spans, start = [], 0
    for end in [*cut_places(data), len(data)]:
        first = min((p for p in (data.find(b" ", start, end), data.find(b"\n", start, end)) if p >= 0), default=-1)
        last = max(data.rfind(b" ", start, end), data.rfind(b"\n", start, end))
        if 0 <= first < last:
            spans.append((first, last))
        start = end
    return spans


def _key(part: bytes) -> tuple[int, int]:
    import xxhash
    h = xxhash.xxh3_128_intdigest(part)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[int, int], int] = {}
        for text in batch.column(0).to_pylist():
            data = (text or "").encode()
            for a, b in safe_spans(data):
                k = _key(data[a:b])
                seen[k] = seen.get(k, 0) + 1
        k1, k2 = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                          pa.array(list(seen.values()), pa.int64())], ["k1", "k2", "n"])


def key_bitmap(keys: DataFrame) -> bytes:
    """Bit ``k1 mod BITMAP`` of every key; at most ``BITMAP / 8`` bytes reach the driver."""
    pos = F.pmod("k1", F.lit(BITMAP))
    rows = keys.select(pos.alias("p")).distinct().groupBy(F.floor(F.col("p") / 32768).alias("b")).agg(
        F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()
    bitmap = bytearray(BITMAP // 8)
    for r in rows:
        bitmap[r["b"] * 4096:(r["b"] + 1) * 4096] = r["bits"]
    return bytes(bitmap)


def _has(bitmap: bytes, key: tuple[int, int]) -> bool:
    p = key[0] % BITMAP
    return bool(bitmap[p >> 3] >> (p & 7) & 1)


def _merged(texts: list[str], held: list[dict[tuple[int, int], bytes]], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Ids of texts of which some chunks are known; what lies between these is encoded again, in one piece each."""
    known: list[list[bytes]] = []
    rest: list[str] = []
    for text, ids_of in zip(texts, held, strict=True):
        data, at, ids_here = text.encode(), 0, []
        for a, b in safe_spans(data):
            ids = ids_of.get(_key(data[a:b]))
            if ids is not None:
                rest.append(data[at:a].decode())
                ids_here.append(ids)
                at = b
        rest.append(data[at:].decode())
        known.append(ids_here)
    pieces = iter(encode(rest))
    out = []
    for ids_here in known:
        parts = [next(pieces)]
        for ids in ids_here:
            parts += (ids, next(pieces))
        out.append(b"".join(parts))
    return out


def _held_by_row(column: pa.Array) -> list[dict[tuple[int, int], bytes]]:
    """The known ids of each row, by key, of a column of lists of (k1, k2, ids)."""
    flat = column.values
    k1, k2, ids = (flat.field(i).to_pylist() for i in range(3))
    ends = column.offsets.to_pylist()
    return [dict(zip(zip(k1[a:b], k2[a:b], strict=True), ids[a:b], strict=True)) for a, b in zip(ends, ends[1:], strict=False)]


def encode_documents(docs: DataFrame, tokenizer: str, finish: Callable, schema: str, types: list[pa.DataType],
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the columns of ``schema`` for every row.

    ``finish(encoder, ids)`` gives them for one document's ids (numpy array); see ``ids_only``.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    names = [c.split()[0] for c in schema.split(", ")]
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    counts = texts.mapInArrow(_chunk_counts, "k1 bigint, k2 bigint, n bigint").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    shared = stored(counts.where("n > 1").select("k1", "k2"), "bpe-shared")
    bits = spark.sparkContext.broadcast(key_bitmap(shared))

    def shared_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], bytes] = {}
            for text in batch.column(0).to_pylist():
                data = text.encode()
                for a, b in safe_spans(data):
                    k = _key(data[a:b])
                    if _has(bits.value, k):
                        found[k] = data[a:b]
            k1, k2 = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array([v.decode() for v in found.values()], pa.string())], ["k1", "k2", "part"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                encoder.encode(batch.column(2).to_pylist()), pa.binary())], ["k1", "k2", "ids"])

    # a chunk's text goes to the task of its key once a batch of documents; there one copy stays
    offered = texts.mapInArrow(shared_texts, "k1 bigint, k2 bigint, part string")
    parts = offered.groupBy("k1", "k2").agg(F.min("part").alias("part")).join(shared, ["k1", "k2"], "left_semi")
    encoded = stored(parts.select("k1", "k2", "part").mapInArrow(encode_parts, "k1 bigint, k2 bigint, ids binary"), "bpe-encoded")

    def columns(ids: list, encoder, data: list[bytes]) -> list[pa.Array]:
        done = [finish(encoder, np.frombuffer(d, dtype=encoder.kind)) for d in data]
        cols = list(zip(*done, strict=True)) or [()] * len(names)
        return [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a shared chunk are finished; the others keep their text and get their keys."""
        encoder = word_encoder(tokenizer)
        for batch in batches:
            alone: list[tuple] = []
            later: list[tuple] = []
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                keys = {k for k in (_key(data[a:b]) for a, b in safe_spans(data)) if _has(bits.value, k)}
                if keys:
                    later.append((row, doc, text, [{"k1": a, "k2": b} for a, b in keys]))
                else:
                    alone.append((row, doc, text))
            ids = columns([a[1] for a in alone], encoder, encoder.encode([a[2] for a in alone]))
            n, m = len(alone), len(later)
            pad = lambda values, kind: pa.array([*[None] * n, *values], kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[0] for a in alone] + [x[0] for x in later], pa.int64()),
                 pa.array(ids[0].to_pylist() + [x[1] for x in later], pa.int64()),
                 *(pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in ids[1:]),
                 pad([x[2] for x in later], pa.string()), pad([x[3] for x in later], key_type)],
                ["row", "doc", *names, "text", "keys"])

    key_type = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    first = stored(rows.mapInArrow(first_pass, f"row bigint, doc bigint, {schema}, text string, "
                                               "keys array<struct<k1:bigint,k2:bigint>>"), "bpe-first")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            data = _merged(batch.column(1).to_pylist(), _held_by_row(batch.column(2)), encoder.encode)
            yield pa.RecordBatch.from_arrays(columns(batch.column(0).to_pylist(), encoder, data), ["doc", *names])

    open_rows = first.where(F.col("text").isNotNull())
    asked = open_rows.select("row", F.explode("keys").alias("k")).select("row", "k.k1", "k.k2")
    held = asked.join(encoded, ["k1", "k2"]).groupBy("row").agg(F.collect_list(F.struct("k1", "k2", "ids")).alias("held"))
    none = F.array().cast("array<struct<k1:bigint,k2:bigint,ids:binary>>")
    rest = open_rows.select("row", "doc", "text").join(held, "row", "left").select("doc", "text", F.coalesce("held", none).alias("held"))
    rest = rest.mapInArrow(second_pass, f"doc bigint, {schema}")
    done = first.where(F.col("text").isNull()).select("doc", *names)
    return done.unionByName(rest).withColumnRenamed("doc", id_col)


def ids_only(encoder, ids: np.ndarray) -> tuple:
    return (ids.tolist(),)


def digests(encoder, ids: np.ndarray) -> tuple:
    """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text."""
    import hashlib
    return (len(ids), hashlib.sha256(b" ".join(encoder.number_bytes[ids].tolist())).hexdigest(),
            hashlib.sha256(encoder.decoded_bytes(ids)).hexdigest())


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)`` with the ids of every row's text."""
    return encode_documents(docs, tokenizer, ids_only, "ids array<int>", [pa.list_(pa.int32())], id_col, text_col)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids; null ids give null."""
    python_tasks(rows.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            out = [None if x is None else encoder.decode(np.array(x, dtype=np.int64)) for x in batch.column(ids_col).to_pylist()]
            kept = [c for c in batch.schema.names if c != out_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], [*kept, out_col])

    fields = [f for f in rows.schema.fields if f.name != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` string"
    return rows.mapInArrow(texts, schema)

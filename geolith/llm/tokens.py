"""Token ids in binary files: frequency-ranked, byte-aligned variable-length coding.

A file is Parquet as a container, so that Spark's commit protocol covers it and
any store that Spark reaches can hold it. Each row is one block of whole
documents in ascending doc_id order and stands alone:

- ``table``: the ids of the block by falling frequency, ties by id, little-endian
  unsigned 32 bits. A token is stored as its rank in this table.
- ``control``: two bits per rank, four to a byte, low bits first: its bytes less one.
- ``data``: the ranks' bytes, little-endian, without their leading zero bytes.
- ``doc_ids`` and ``lengths``: the documents and how many ranks each has.

The decoder looks the four lengths of a control byte up in a 256-row table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.bpe import encoder
from geolith.llm.common import CHUNKED, at, before, let_go, scratch_path, small_batches

END = 2
#: Ranks after which a block is closed.
BLOCK = 1 << 19

BLOCK_SCHEMA = "first_doc long, n_docs int, n_tokens long, doc_ids array<bigint>, lengths array<int>, `table` binary, control binary, data binary"

#: For each control byte the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros((len(v) + 3) // 4 * 4, np.uint8)
    code[: len(v)] = size - 1
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    data[start] = v.astype(np.uint8)
    for k in range(1, int(size.max(initial=1))):
        on = np.flatnonzero(size > k)
        data[start[on] + k] = (v[on] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``pack_ranks`` coded."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        on = np.flatnonzero(size > k)
        out[on] |= raw[start[on] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> tuple:
    """One block of documents, whose ids stand in a row, as a row of BLOCK_SCHEMA."""
    counts = np.bincount(ids)
    values = np.flatnonzero(counts)
    values = values[np.lexsort((values, -counts[values]))]
    rank = np.empty(len(counts), np.uint32)
    rank[values] = np.arange(len(values), dtype=np.uint32)
    control, data = pack_ranks(rank[ids])
    return doc_ids[0], len(lengths), len(ids), doc_ids, lengths.tolist(), values.astype("<u4").tobytes(), control, data


def decode_block(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block's documents in a row, unsigned 32 bits."""
    return np.frombuffer(table, "<u4")[unpack_ranks(control, data, n)]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Encode ``docs`` (``doc_id, text``) into block files under ``path``, in ascending doc_id order (null first).

    Texts are encoded once, in the task that writes them: the range sort moves
    texts, not ids. A task holds one block of about BLOCK ids, or one longer document.
    """

    schema = pa.schema([("first_doc", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), *((n, pa.binary()) for n in ("table", "control", "data"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(vocabulary)
        names, lengths, flats, n = [], [], [], 0

        def block() -> pa.RecordBatch:
            row = encode_block([x for part in names for x in part], np.concatenate(lengths), np.concatenate(flats))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for lo, hi, ids, counts in tok.batches(batch.column("text"), end):
                docs_in, begin = batch.column("doc_id").slice(lo, hi - lo).to_pylist(), 0
                ends = np.cumsum(counts)
                while begin < len(counts):  # up to the document with which the block is full
                    done = int(ends[begin - 1]) if begin else 0
                    upto = min(len(counts), int(np.searchsorted(ends, done + max(1, BLOCK - n))) + 1)
                    names.append(docs_in[begin:upto])
                    lengths.append(counts[begin:upto])
                    flats.append(ids[done : ends[upto - 1]])
                    n, begin = n + len(flats[-1]), upto
                    if n >= BLOCK:
                        yield block()
                        names, lengths, flats, n = [], [], [], 0
        if names:
            yield block()
        let_go()

    key = F.col("doc_id").cast("long")
    laid = docs.select(key.alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    blocks = laid.mapInArrow(encode, BLOCK_SCHEMA)
    blocks = blocks.withColumns({"part": F.spark_partition_id(), "block": F.monotonically_increasing_id()})
    with small_batches(docs.sparkSession, CHUNKED):
        blocks.write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The documents of the files at ``path``: ``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32 bits).

    ``start`` counts the ids before the document over all files.
    """
    blocks = spark.read.parquet(path)
    offsets = before(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", "n_tokens").withColumn("start", at(offsets, "part") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    starts = starts.select(F.col("block").alias("_b"), "start")
    rows = blocks.join(starts, F.col("block") == F.col("_b")).select("doc_ids", "lengths", "n_tokens", "table", "control", "data", "start")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                cell = lambda name: batch.column(at[name])[k]
                ids = decode_block(*(cell(n).as_py() for n in ("table", "control", "data", "n_tokens")))
                n = np.asarray(cell("lengths").values).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                content = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([cell("doc_ids").values, pa.array(cell("start").as_py() + ends[:-1]), pa.array(n), content], names=["doc_id", "start", "n_tokens", "ids"])
        let_go()

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_file(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back.

    Null and empty texts are the end id alone. Rows that repeat a doc_id follow
    each other. A null doc_id comes first. An empty table gives empty files.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary or vocabulary_path(), end)
    return read_tokens(spark, path)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    back = token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

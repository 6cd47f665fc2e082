"""Token files of directly addressable codes.

Ids are cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id
of a block, level k the k-th chunk of those ids that need it. A bitmap beside
each level tells which ids go on, and a rank directory (ones before every
``RANK_BITS`` bits) tells where they go on. So the id at any place is read from
one byte a level, and nothing before it is decoded.

A block is the payload of one row of a Parquet table, which gives task commit,
any file system and checksums. Rows: ``shard`` (range of doc_id), ``block``
(order within it), ``doc_ids``, ``lengths`` (ids per document), ``payload``.
Payload, little-endian: ``DAC1``, u32 levels, then per level u64 chunks, the
chunks, the bitmap, the directory (u32).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnokit.llm.batches import text_pieces
from limnokit.llm.subwords import cached_tokenizer, tokenizer_path
from limnokit.session import shared_dir

MAGIC, RANK_BITS = b"DAC1", 512
BLOCK_SCHEMA = "shard int, block int, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack_ids(ids: np.ndarray) -> bytes:
    """The payload of an array of ids from 0 to 2^32 - 1."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        on = rest > 0xFF
        bits = np.packbits(on, bitorder="little")
        step = RANK_BITS // 8
        ones = np.add.reduceat(_ONES[bits].astype(np.uint32), np.arange(0, len(bits), step)) if len(bits) else np.zeros(0, np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class PackedIds:
    """Random access to the ids of a payload."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        (n_levels,), at = struct.unpack_from("<I", payload, 4), 8
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            n_bits = (n + 7) // 8
            n_ranks = -(-n_bits // (RANK_BITS // 8)) + 1
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + 8 + n)
            self.levels.append((chunks, bits, np.frombuffer(payload, "<u4", n_ranks, at + 8 + n + n_bits)))
            at += 8 + n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, places: int | slice | np.ndarray) -> np.ndarray | int:
        """The ids at a place, a range of places or an array of places."""
        if isinstance(places, slice):
            places = np.arange(*places.indices(len(self)))
        at = np.atleast_1d(np.asarray(places, np.int64))
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, directory) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at = live[on], at[on]
            if not len(at):
                break
            at = _rank(bits, directory, at)
        return int(out[0]) if np.ndim(places) == 0 else out


def _rank(bits: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ones before each place: the directory's count, and the ones since in at most 64 bytes."""
    step = RANK_BITS // 8
    first, byte = (at // RANK_BITS) * step, at >> 3
    low, high = int(first[0]), int(byte[-1]) + 1
    if np.all(at[1:] >= at[:-1]):  # a range: one running count over the bytes it spans
        running = np.concatenate([[0], np.cumsum(_ONES[bits[low:high]], dtype=np.int64)])
        since = running[byte - low] - running[first - low]
    else:
        since = np.array([int(_ONES[bits[a:b]].sum()) for a, b in zip(first, byte, strict=True)], np.int64)
    part = _ONES[bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
    return directory[at // RANK_BITS].astype(np.int64) + since + part


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, block_tokens: int = 1 << 20) -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending order of ``doc_id``.

    Null texts are empty, so they give the end id alone. Rows with the same id
    follow each other in order of Spark's hash of their text; null ids come first. A document
    is never cut: a longer one than ``block_tokens`` has a block to itself.
    """
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        library = cached_tokenizer(tokenizer, False)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, size
            names, lengths, ids = (list(x) for x in zip(*held, strict=True))
            block, size = block + 1, 0
            held.clear()
            row = [shard, block - 1, sum(map(len, ids)), sum(names, []), np.concatenate(lengths), pack_ids(np.concatenate(ids))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["shard", "block", "n_tokens", "doc_ids", "lengths", "payload"])

        for rows, texts in text_pieces(batches):
            found = library.encode(texts)
            lengths = np.diff(found.bound) + 1
            ids = np.insert(found.ids.astype(np.uint32), found.bound[1:], end_id)
            held.append((rows.column("doc_id").to_pylist(), lengths, ids))
            size += len(ids)
            if size >= block_tokens:
                yield flush()
        if held:
            yield flush()

    # a hash of the text after the id: rows that share an id, or have none, spread over several ranges
    # ranges may also end between equal rows, which are numbered where they are read
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranges = keyed.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text", "row")
    ranges.select("doc_id", "text").mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it: shard totals, then
    block totals within a shard, then documents within a block.
    """

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, lengths = PackedIds(row["payload"]), np.array(row["lengths"], np.int64)
                stop = np.cumsum(lengths)
                crc = [zlib.crc32(codes[int(a) : int(b)].astype("<u4").tobytes()) for a, b in zip(stop - lengths, stop, strict=True)]
                n = len(lengths)
                yield pa.record_batch(
                    [
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        stop - lengths,
                        lengths,
                        pa.array(crc, pa.int64()),
                    ],
                    ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.select("shard", "block", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    shards = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before.orderBy("shard")), F.lit(0)).alias("shard_start"))
    in_shard = before.partitionBy("shard").orderBy("block")
    places = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0)).alias("block_start"))
    docs = blocks.drop("n_tokens").mapInArrow(decode, "shard int, block int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return (
        docs.join(places, ["shard", "block"])
        .join(shards, "shard")
        .select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )


def store_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to new token files in the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/settled/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path)

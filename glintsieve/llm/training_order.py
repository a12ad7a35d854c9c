"""Training-order materialisation: every sequence has a slot in one global random order.

Documents are packed into sequences where they are read.  Sequences are numbered over the whole corpus, and a keyed Feistel network permutes the
numbers: a bijection on the smallest even number of bits that holds them, walked along its
cycles until it lands below their count.  So the order is random, needs no sort of
random keys, and is the same for the same key and corpus.  Shards are ranges of slots: each is a
blob of sequences at a fixed stride, so a reader that stopped at a slot goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, new_folder, partitions, remove_folder
from .packing import CAPACITY, END_ID, packed_together, pieces_of
from .subwords import word_cache

KEY, ROUNDS = 20240501, 6
#: Sequences of a shard.
SHARD = 64
#: Shards of a row group: blobs are mostly padding where texts are short, and a reader holds a group at once.
ROW_GROUP = 64
#: Ids that are packed together in a task.
TOGETHER = 2_000_000
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
_PIECES = "array<struct<doc_id: long, piece: int, start: long, length: long, offset: long>>"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def permute(numbers: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slots of ``numbers``, all below ``count``: a bijection of them that depends on the key."""
    half = max(1, (max(1, count - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(ROUNDS):
            salt = np.uint64((key * 0x100000001B3 + r * 0x1234567890ABCDEF) & (2**64 - 1))
            mixed = (right + salt) * _A
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _B
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(ids, length, pieces) of ``docs`` (doc_id, text), tokenised and packed in the tasks that read them.

    Best-fit-decreasing packing takes the pieces of some ``TOGETHER`` ids at a time, so a
    task holds no more than these, and one bin in hundreds is not full.  ``ids`` is in the
    form of ``small``; ``pieces`` are (doc_id, piece, start, length, offset) in their order.
    """
    schema = pa.schema([("ids", pa.binary()), ("length", pa.int64()), ("pieces", pa.list_(_PIECE))])
    names = [f.name for f in _PIECE]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary)
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            made = packed_together(held, capacity)
            held.clear()
            columns = [[small(s.ids) for s in made], [s.length for s in made], [[dict(zip(names, p, strict=True)) for p in s.pieces] for s in made]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for piece, at, part in pieces_of(cache, text.as_py(), capacity):
                        held.append((doc_id, piece, at // 4, part))
                        size += len(part) // 4
                        if size >= TOGETHER:
                            yield packed()
                            size = 0
            if held:
                yield packed()
        finally:
            cache.clear()
            give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(make, f"ids binary, length long, pieces {_PIECES}")


def ordered_sequences(written: DataFrame, key: int = KEY, shard: int = SHARD) -> DataFrame:
    """``written``, sequences as read from Parquet files, with slot, shard and place in the shard.

    A sequence's number is its row in its file after all rows of the files before, by
    name: the counts of files are all that is gathered, and nothing is shuffled.  Equal
    sequences have slots of their own.  Without rows the result is empty.
    """
    spark = written.sparkSession
    # One row for each file, so as many as there were tasks.
    named = written.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = sorted((r["_file"], r["n"]) for r in named.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in sizes)
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    before = spark.createDataFrame([(f, b) for (f, _), b in zip(sizes, starts, strict=False)], "_file string, _before long")

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, key))

    placed = named.join(F.broadcast(before), "_file").withColumn("slot", slot((F.col("_before") + F.col("_at")).cast("long")))
    return placed.select(*written.columns, "slot", F.floor(F.col("slot") / shard).cast("long").alias("shard"), (F.col("slot") % shard).cast("int").alias("place"))


def order_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: int = KEY) -> DataFrame:
    """Documents' pieces with the slots of their sequences, as the written shards hold them.

    The packed ids are written as shards to the shared folder; the rows are read from
    these.  Null and empty texts are an end id alone; very long texts are many pieces; a
    null doc_id and repeated rows have pieces as any other.  Numbers, and so slots,
    depend on how the table is split into tasks, but not on which attempt of a task wrote.
    """
    spark = docs.sparkSession
    sequences = packed_sequences(docs, vocabulary, capacity)
    folder = new_folder(spark, "sequences")
    sequences.write.option("compression", "none").parquet(folder)
    made = shards(ordered_sequences(spark.read.schema(sequences.schema).parquet(folder), key), capacity)
    written = write_shards(made)
    remove_folder(spark, folder)
    return written_sequences(written, capacity)


def small(ids: bytes) -> bytes:
    """Ids in less room on their way to a shard: first bytes of all, second bytes and so on, compressed."""
    return pa.Codec("zstd", compression_level=1).compress(np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def whole(ids: bytes, length: int) -> bytes:
    """``length`` ids, as they were before ``small``."""
    return np.frombuffer(pa.Codec("zstd").decompress(ids, 4 * length, asbytes=True), np.uint8).reshape(4, -1).T.tobytes()


def shards(ordered: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(shard, blob, sequences) from ordered sequences: their ids in order, each padded with the end id to ``capacity`` ids.

    ``sequences`` has the pieces of each, so padding can be told from ids.  Partitions
    are ranges of shards: written, the files are in training order.
    """
    stride = 4 * capacity
    end = END_ID.to_bytes(4, "little")
    schema = pa.schema([("shard", pa.int64()), ("blob", pa.binary()), ("sequences", pa.list_(pa.list_(_PIECE)))])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blob, rows = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([now], [b"".join(blob)], [rows]), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "ids", "length", "pieces")]
            for shard, ids, length, pieces in zip(*columns, strict=True):
                if shard != now:
                    if rows:
                        yield made()
                    now, blob, rows = shard, [], []
                blob.append(whole(ids, length) + end * (capacity - length))
                rows.append(pieces)
        if rows:
            yield made()

    dealt = ordered.select("shard", "place", "ids", "length", "pieces").repartitionByRange(partitions(ordered.sparkSession), "shard").sortWithinPartitions("shard", "place")
    return dealt.mapInArrow(lay, f"shard long, blob binary, sequences array<{_PIECES}>")


def write_shards(made: DataFrame) -> DataFrame:
    """Writes shards to a new folder of the shared ones, and reads them from there."""
    folder = new_folder(made.sparkSession, "shards")
    made.write.option("parquet.block.row.count.limit", ROW_GROUP).option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(folder)
    return made.sparkSession.read.schema(made.schema).parquet(folder)


def written_sequences(written: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot, shard, place, offset, byte_offset) of each piece; the checksum is of its ids in the blob.

    ``offset`` is the piece's in its sequence, in ids, and ``byte_offset`` its in the blob.
    """
    stride = 4 * capacity

    def row(blob: Column, p: Column, at: Column) -> Column:
        first = at * stride + p["offset"] * 4
        ids = F.substring(blob, (first + 1).cast("int"), (p["length"] * 4).cast("int"))
        slot = F.col("shard") * shard + at
        return F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"), F.crc32(ids).alias("ids_crc32"), slot.alias("slot"), F.col("shard").alias("shard"), at.alias("place"), p["offset"].alias("offset"), first.cast("long").alias("byte_offset"))

    # As a variable the blob is fetched once for each shard; a column would be copied out for each piece.
    pieces = lambda blob: F.flatten(F.transform("sequences", lambda s, at: F.transform(s, lambda p: row(blob, p, at))))
    return written.select(F.inline(F.flatten(F.transform(F.array("blob"), pieces))))


def read_from(written: DataFrame, slot: int, capacity: int = CAPACITY, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in order; a reader that stopped goes on with the next slot."""
    stride = 4 * capacity
    for row in written.where(F.col("shard") >= slot // shard).orderBy("shard").toLocalIterator():
        blob = bytes(row["blob"])
        first = slot % shard if row["shard"] == slot // shard else 0
        for at in range(first * stride, len(blob), stride):
            yield np.frombuffer(blob[at : at + stride], "<u4")

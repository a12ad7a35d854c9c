import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from glintsieve.llm import queries
from glintsieve.llm import training_order as order
from glintsieve.llm.common import VOCABULARY
from glintsieve.llm.packing import tokenised_pieces


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097, 70000])
def test_permutation(count):
    slots = order.permute(np.arange(count), count)
    assert sorted(slots.tolist()) == list(range(count))
    assert np.array_equal(slots[::-1], order.permute(np.arange(count)[::-1], count))
    if count > 100:
        assert not np.array_equal(slots, order.permute(np.arange(count), count, key=1))
        assert (slots == np.arange(count)).mean() < 0.05
        assert abs(np.corrcoef(slots, np.arange(count))[0, 1]) < 0.15


def brute_sequences(rows):
    """slot to the ids of its pieces in order, from rows whose ids are told apart by (start, checksum)."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.slot, r.offset)):
        out.setdefault(r.slot, []).append(r)
    return out


def check_rows(rows, docs, capacity, shard):
    """Every piece of every document once, in gapless sequences, one for each slot; nearly as few as can be."""
    want = [tuple(r) for r in tokenised_pieces(docs, VOCABULARY, capacity).collect()]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by_slot = brute_sequences(rows)
    assert sorted(by_slot) == list(range(len(by_slot)))
    for slot, pieces in by_slot.items():
        end = 0
        for r in pieces:
            assert r.offset == end and (r.shard, r.place) == divmod(slot, shard) and r.byte_offset == 4 * (r.place * capacity + end)
            end += r.length
        assert end <= capacity
    assert len(by_slot) <= 1.2 * sum(r.length for r in rows) / capacity + 16
    return by_slot


def test_shards_hold_all_sequences_in_order(spark, monkeypatch):
    monkeypatch.setattr(order, "TOGETHER", 300)
    texts = [None, "", "one two three", "word " * 100, "again", "again"]
    docs = spark.createDataFrame([(i // 2 if i > 4 else i, t, 1) for i, t in enumerate(texts * 20)] + [(None, "x", 2)] * 3, "doc_id long, text string, slot int")
    written = []
    write = order.write_shards
    monkeypatch.setattr(order, "write_shards", lambda made: written.append(write(made)) or written[0])
    rows = order.written_sequences(order.order_documents(docs, VOCABULARY, 32) and written[0], 32, 64).collect()
    by_slot = check_rows(rows, docs, 32, 64)
    want = []
    blobs = {r.shard: bytes(r.blob) for r in written[0].collect()}
    for pieces in by_slot.values():
        ids = b"".join(blobs[r.shard][r.byte_offset : r.byte_offset + 4 * r.length] for r in pieces)
        want.append(np.pad(np.frombuffer(ids, "<u4"), (0, 32 - len(ids) // 4)))
    for start in (0, 5, 8, 19):
        got = list(order.read_from(written[0], start, 32, 64))
        assert len(got) == len(want) - start and all(np.array_equal(a, b) for a, b in zip(got, want[start:], strict=True))


def test_nothing(spark):
    assert order.order_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_the_query_reads_its_rows_from_written_shards(spark, small, monkeypatch):
    written = []
    write = order.write_shards
    monkeypatch.setattr(order, "write_shards", lambda made: written.append(write(made)) or written[0])
    rows = queries.op8_training_order(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    by_slot = check_rows(rows, docs, order.CAPACITY, order.SHARD)
    files = [f.removeprefix("file://") for f in written[0].inputFiles()]
    assert files
    assert all(pq.ParquetFile(f).metadata.row_group(0).num_rows <= order.ROW_GROUP for f in files)
    blobs = {r.shard: bytes(r.blob) for r in written[0].collect()}
    for pieces in by_slot.values():
        for r in pieces:
            assert zlib.crc32(blobs[r.shard][r.byte_offset : r.byte_offset + 4 * r.length]) == r.ids_crc32
        end = 4 * (pieces[-1].place * order.CAPACITY + pieces[-1].offset + pieces[-1].length)
        assert not any(blobs[pieces[0].shard][end : 4 * order.CAPACITY * (pieces[0].place + 1)])
    for slot in (0, len(by_slot) // 2):
        left = [by_slot[s] for s in sorted(by_slot) if s >= slot]
        for pieces, ids in zip(left, order.read_from(written[0], slot), strict=True):
            assert all(zlib.crc32(ids[r.offset : r.offset + r.length].tobytes()) == r.ids_crc32 for r in pieces)

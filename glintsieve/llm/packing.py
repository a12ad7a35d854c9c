"""Best-fit-decreasing packing of tokenised documents into sequences.

Best fit needs only lengths, and a piece has one of ``capacity`` lengths.  So the
corpus is packed as a whole, on counts: the lengths are taken in falling order, and a
segment tree over remaining capacities names the tightest open bin in logarithmic time;
all bins with the same remaining capacity are a few intervals of bin numbers.  The
resulting plan says which ranks among the pieces of a length go to which bins.  Pieces
get their ranks from distributed counts, so no task and not the driver ever holds more
than the counts of lengths and the plan, whatever the corpus' size.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, partitions, unused
from .subwords import WordCache, word_cache

CAPACITY = 2048
#: The id that ends each document.
END_ID = 0


class OpenBins:
    """Segment tree over remaining capacities: where it is true, some bin is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        at = remaining + self.size
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that is ``length`` at least."""
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


class Run(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank``: ``per_bin`` in each of ``bins`` bins from ``first_bin``, at ``offset``."""

    length: int
    rank: int
    bins: int
    per_bin: int
    first_bin: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The plan for so many pieces of each length, and the number of bins.

    It is what best fit does piece by piece in falling order of length: the tightest
    bin that takes a piece stays the tightest until no further piece of that length
    fits, so bins of the same remaining capacity are filled alike.
    """
    tree = OpenBins(capacity)
    free: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # intervals of bins: first, number
    plan: list[Run] = []
    made = 0

    def give_back(remaining: int, first: int, number: int) -> None:
        free[remaining].append((first, number))
        tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                number = -(-left // (capacity // length))
                give_back(capacity, made, number)
                made += number
            first, number = free[remaining].popleft()
            if not free[remaining]:
                tree.set(remaining, False)
            per_bin = min(left, remaining // length)
            used = min(number, left // per_bin)
            plan.append(Run(length, rank, used, per_bin, first, capacity - remaining))
            rank += used * per_bin
            left -= used * per_bin
            if used < number:
                free[remaining].appendleft((first + used, number - used))
                tree.set(remaining, True)
            if rest := remaining - per_bin * length:
                give_back(rest, first, used)
    return plan, made


def pieces_of(cache: WordCache, text: str | None, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, byte of its start, ids) of a text's ids and the end id, cut at every ``capacity`` ids."""
    ids, width = cache.packed(text) + END_ID.to_bytes(4, "little"), 4 * capacity
    for piece, at in enumerate(range(0, len(ids), width)):
        yield piece, at, ids[at : at + width]


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document.

    A document is its text's ids and then ``END_ID``; only one longer than ``capacity``
    is cut.  Null and empty texts are the end id alone.  Ids are little-endian
    unsigned 32-bit numbers.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.binary()))
        kinds += ", ids binary"
    schema = pa.schema(fields)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary)
        try:
            for batch in batches:
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for piece, at, part in pieces_of(cache, text.as_py(), capacity):
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)[: len(fields)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        finally:
            cache.clear()
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_up, kinds)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: few sequences of at most ``capacity`` tokens, each gapless from 0.

    ``pieces`` needs length (1 to ``capacity``); all its columns stay, whatever their
    names, but for those named sequence_id or offset, which are replaced.  Every row is
    packed by itself, equal rows and rows with null ids too.  Without rows the result is
    empty.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    chunks = 4 * partitions(spark)
    row, chunk, own, before, place = (unused(pieces, c) for c in ("_row", "_chunk", "_own", "_before", "_place"))
    # A rank among the pieces of a length: the pieces of earlier chunks, and the place in the own chunk. Rows are
    # dealt to chunks by their numbers, which don't change once they are written, so equal rows are spread as well.
    kept = cut(pieces.withColumn(row, F.monotonically_increasing_id())).withColumn(chunk, F.pmod(F.xxhash64(row), F.lit(chunks)).cast("int"))
    counts = kept.groupBy("length", chunk).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("length", chunk, "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_decreasing(lengths, capacity)
    # Runs by length and rank as one key; a length has at most 2 ** 40 pieces in this form.
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(((table[:, 0] << 40) + table[:, 1], table))

    @F.pandas_udf("sequence_id long, offset long")
    def place_of(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, runs = shared.value
        run = runs[np.searchsorted(keys, (length.to_numpy() << 40) + rank.to_numpy(), "right") - 1]
        bins, inside = np.divmod(rank.to_numpy() - run[:, 1], run[:, 3])
        return pd.DataFrame({"sequence_id": run[:, 4] + bins, "offset": run[:, 5] + inside * run[:, 0]})

    within = Window.partitionBy(chunk, "length").orderBy(row)
    ranked = kept.withColumn(own, F.row_number().over(within) - 1).join(counts.select("length", chunk, before), ["length", chunk])
    placed = ranked.withColumn(place, place_of(F.col("length"), (F.col(before) + F.col(own)).cast("long")))
    return placed.select(*pieces.columns, F.col(f"{place}.sequence_id").alias("sequence_id"), F.col(f"{place}.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents (doc_id, text) as placed pieces, without their ids.

    Rows with a null id or text, empty and very long texts and repeated rows are all
    packed, each row by itself; other columns are ignored.
    """
    return pack(tokenised_pieces(docs, vocabulary, capacity), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids binary): the packed sequences, from placed pieces that have their ids.

    Each placed row is in its sequence once, whatever its doc_id.
    """
    packed = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return packed.select("sequence_id", "length", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


class Sequence(NamedTuple):
    """Pieces (doc_id, piece, start, length, offset) of one sequence, its length and ids."""

    pieces: list[tuple]
    length: int
    ids: bytes


def packed_together(pieces: list[tuple], capacity: int = CAPACITY) -> list[Sequence]:
    """Best-fit-decreasing sequences of some pieces (doc_id, piece, start, ids)."""
    by_length: dict[int, list[tuple]] = {}
    for p in pieces:
        by_length.setdefault(len(p[-1]) // 4, []).append(p)
    plan, bins = best_fit_decreasing({n: len(x) for n, x in by_length.items()}, capacity)
    filled: list[list[tuple]] = [[] for _ in range(bins)]
    for run in plan:
        for nth, p in enumerate(by_length[run.length][run.rank : run.rank + run.bins * run.per_bin]):
            at, inside = divmod(nth, run.per_bin)
            filled[run.first_bin + at].append((run.offset + inside * run.length, p))
    out = []
    for rows in filled:
        rows.sort(key=lambda r: r[0])
        ids = b"".join(p[-1] for _, p in rows)
        out.append(Sequence([(*p[:-1], len(p[-1]) // 4, offset) for offset, p in rows], len(ids) // 4, ids))
    return out

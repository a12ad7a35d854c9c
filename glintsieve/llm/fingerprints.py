"""Document fingerprints by a randomised edit embedding.

All texts share random walks over their characters: at step t a walk writes down the
character it stands on and moves on by a random bit that depends on t and on that
character.  Two walks over texts that differ by a few edits fall into step again soon
after each, so edit distance becomes Hamming distance between what the walks wrote.

A text is walked in segments of ``SEGMENT`` characters, many side by side in numpy.
A fingerprint samples ``SAMPLES`` places of the embedding from a grid that is shared
by all texts of a scale; scales are powers of two of the length, and a text is sampled
on its own scale's grid and on the next, so texts of nearly the same length always
share one.  Candidates agree on all places of some band of bits sampled from a grid,
and are verified by the likeness of their fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import cut, partitions
from .graph import HOT_SHARE, join_hot

SEGMENT = 2048
#: Steps of one segment's walk: two for each character on average, and a margin.
STEPS = 2 * SEGMENT + 384
SAMPLES = 256
#: The smallest scale holds texts of up to so many characters.
SMALLEST = 64
#: Segments that are walked side by side.
SIDE_BY_SIDE = 4096
#: Bands of each grid, and sampled places in each, for candidates.
BANDS, BAND_PLACES = 12, 7
#: Symbols of a fingerprint; the first stands for a place beyond the text's end.
ALPHABET = ".0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
#: Likeness that two unrelated texts reach by chance, as measured on letters of prose.
CHANCE = 0.08
#: Ranges of doc_ids for each shuffle partition.
RANGES_PER_PARTITION = 3
#: Documents that are held and walked together.
TOGETHER = 1500


@lru_cache(1)
def _moves() -> np.ndarray:
    """The shared random bit for each step and symbol; a walk that has left its text stays."""
    bits = np.random.default_rng(20240229).integers(0, 2, (STEPS, 64), dtype=np.int64)
    bits[:, 0] = 0
    return bits


@lru_cache(64)
def _grid(scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments and steps that are sampled on a scale, evenly over all its characters."""
    size = SMALLEST << scale
    pick = np.random.default_rng([20240301, scale])
    if size <= SEGMENT:
        steps = np.sort(pick.choice(2 * size, SAMPLES, replace=2 * size < SAMPLES))
        return np.zeros(SAMPLES, np.int64), steps
    places = (np.arange(SAMPLES) + pick.random(SAMPLES)) * (size // SEGMENT * 2 * SEGMENT) / SAMPLES
    return np.divmod(places.astype(np.int64), 2 * SEGMENT)


def scale_of(n_chars: int) -> int:
    scale = 0
    while SMALLEST << scale < n_chars:
        scale += 1
    return scale


def _symbols(text: str) -> np.ndarray:
    """A symbol from 1 to 63 for each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(63) + np.uint32(1)).astype(np.uint8)


def _walk(texts: Sequence[str]) -> list[str]:
    """The fingerprints of so many texts that their segments fit side by side, or of one long text."""
    coded = [_symbols(t) for t in texts]
    counts = [max(1, -(-len(c) // SEGMENT)) for c in coded]
    first = np.concatenate(([0], np.cumsum(counts)))
    board = np.zeros((first[-1], SEGMENT + 1), np.uint8)
    for at, c in zip(first.tolist(), coded, strict=False):
        whole = len(c) // SEGMENT
        board[at : at + whole, :SEGMENT] = c[: whole * SEGMENT].reshape(whole, SEGMENT)
        if rest := len(c) - whole * SEGMENT:
            board[at + whole, :rest] = c[whole * SEGMENT :]
    scales = [scale_of(len(c)) for c in coded]
    # Short texts need only the steps of the largest grid among them.
    last = STEPS if max(counts) > 1 else min(STEPS, 1 + 2 * (SMALLEST << (max(scales) + 1)))
    written = np.empty((last, len(board)), np.uint8)
    flat, place, moves = board.reshape(-1), np.arange(len(board)) * (SEGMENT + 1), _moves()
    for t in range(last):
        now = flat.take(place, out=written[t], mode="clip")
        place += moves[t].take(now)
    out = []
    for at, n, scale in zip(first.tolist(), counts, scales, strict=False):
        parts = []
        for s in (scale, scale + 1):
            segment, step = _grid(s)
            inside = (segment < n) & (step < last)
            sample = np.zeros(SAMPLES, np.uint8)
            sample[inside] = written[step[inside], at + segment[inside]]
            parts.append(_LETTERS[sample].tobytes().decode())
        out.append(f"{scale}:{parts[0]}:{parts[1]}")
    return out


def fingerprints(texts: Sequence[str]) -> list[str]:
    """The fingerprint of each text: scale, and the samples on the scale's grid and on the next one's."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out = [""] * len(texts)
    group: list[int] = []
    held = 0
    for i in order:
        size = max(1, -(-len(texts[i]) // SEGMENT))
        # Texts of one segment whose walks differ much in length are kept apart.
        if group and (held + size > SIDE_BY_SIDE or held >= 512 and len(texts[i]) > 2 * len(texts[group[0]]) and len(texts[group[0]]) < SEGMENT):
            for j, f in zip(group, _walk([texts[j] for j in group]), strict=True):
                out[j] = f
            group, held = [], 0
        group.append(i)
        held += size
    if group:
        for j, f in zip(group, _walk([texts[j] for j in group]), strict=True):
            out[j] = f
    return out


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are, 0 to 1: agreement on the finest grid they share, beyond chance.

    Fingerprints of scales that differ by two or more share none and have 0.
    """
    if one == other:
        return 1.0
    s, a0, a1 = one.split(":")
    t, b0, b1 = other.split(":")
    if abs(int(s) - int(t)) > 1:
        return 0.0
    a, b = (a0, b0) if s == t else (a1, b0) if int(s) < int(t) else (a0, b1)
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    some = (x != _LETTERS[0]) | (y != _LETTERS[0])
    if not some.any():
        return 1.0
    share = float((x[some] == y[some]).mean())
    return max(0.0, (share - CHANCE) / (1 - CHANCE))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) for each row of ``docs``; a null text counts as empty."""

    @F.pandas_udf("string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(fingerprints(list(batch)))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), of(text).alias("fingerprint"))


@lru_cache(1)
def _band_orders() -> np.ndarray:
    """For each band the order in which it looks for places."""
    draw = np.random.default_rng(20240303)
    return np.array([draw.permutation(SAMPLES) for _ in range(BANDS)])


def print_digest(fingerprint: str) -> tuple[int, int]:
    """A 128-bit digest of a fingerprint, as two signed numbers."""
    one, two = np.frombuffer(xxhash.xxh3_128_digest(fingerprint.encode()), np.int64).tolist()
    return one, two


class Prints:
    """Texts compared by the likeness of their fingerprints, ``least`` or more; empty texts link with nothing."""

    dtype = np.dtype(np.uint8)
    sure = False  # bands are sampled

    def __init__(self, least: float):
        self.least = least

    def forms(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        made = fingerprints([t or "" for t in texts])
        return [np.frombuffer(f.encode() if t else b"", np.uint8) for f, t in zip(made, texts, strict=True)]

    def digest(self, form: np.ndarray) -> tuple[int, int]:
        return print_digest(form.tobytes().decode())

    def keys(self, form: np.ndarray) -> np.ndarray:
        """For each band of either grid a hash of the first places in the band's order that lie in the text, and of what is there.

        So texts of nearly one length look at the same places, however little of a grid they fill.
        """
        scale, *grids = form.tobytes().split(b":")
        orders, keys = _band_orders(), []
        for at, grid in enumerate(grids):
            samples = np.frombuffer(grid, np.uint8)
            inside = samples != _LETTERS[0]
            count = min(BAND_PLACES, int(inside.sum()))
            if not count:
                continue
            first = np.argsort(~inside[orders], axis=1, kind="stable")[:, :count]
            places = np.take_along_axis(orders, first, 1)
            rows = np.concatenate((places.astype(np.uint8), samples[places]), 1)
            keys += [xxhash.xxh3_64_intdigest(row.tobytes(), seed=(int(scale) + at) * BANDS + n) for n, row in enumerate(rows)]
        return np.array(keys, np.uint64)

    def firsts(self, forms: Sequence[np.ndarray], sides: Sequence[int], known: Sequence[int]) -> list[int]:
        count, names = len(forms), sorted(set(sides))
        linked = np.zeros((count, count), bool)
        members = [[i for i, s in enumerate(sides) if s == name] for name in names]
        for i, j, near in self._near(forms, members[0], members[-1]):
            linked[np.ix_(i, j)] |= near
            linked[np.ix_(j, i)] |= near.T
        labels = np.array(known)
        linked |= labels[:, None] == labels[None, :]
        firsts = [-1] * count
        for i in range(count):
            reached = [i] if firsts[i] < 0 else []
            while reached:
                at = reached.pop()
                if firsts[at] < 0:
                    firsts[at] = i
                    reached += [j for j in np.flatnonzero(linked[at]).tolist() if firsts[j] < 0]
        return firsts

    def _near(self, forms: Sequence[np.ndarray], ones: list[int], others: list[int]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
        """Rows, columns, and whether these are near, for the grids that they share; as ``likeness`` says."""
        parts = [form.tobytes().split(b":") for form in forms]
        scales = [int(p[0]) for p in parts]
        grid = lambda chosen, which: np.frombuffer(b"".join(parts[i][which] for i in chosen), np.uint8).reshape(-1, SAMPLES)
        of = lambda chosen, scale: [i for i in chosen if scales[i] == scale]
        for s in sorted({scales[i] for i in ones}):
            mine = of(ones, s)
            for t, which, other_which in ((s, 1, 1), (s - 1, 1, 2), (s + 1, 2, 1)):
                if theirs := of(others, t):
                    two = grid(theirs, other_which)
                    near = np.empty((len(mine), len(theirs)), bool)
                    for row, one in enumerate(grid(mine, which)):
                        some = (one != _LETTERS[0]) | (two != _LETTERS[0])
                        n = some.sum(axis=1)
                        share = np.where(n > 0, ((one == two) & some).sum(axis=1) / np.maximum(n, 1), 1.0)
                        near[row] = np.maximum(0.0, (share - CHANCE) / (1 - CHANCE)) >= self.least
                    yield mine, theirs, near

    def done(self) -> None:
        """Nothing is kept."""


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(h1, h2, n, near_class) for each distinct fingerprint that is near another one.

    Banding and verification: fingerprints that share a band's places meet, exactly and
    however many share them, and those of ``least`` likeness or more are linked.
    h1 and h2 are ``print_digest`` of the fingerprint and n its number of rows;
    near_class is the least h1 that links reach.  Null and empty texts, repeated rows
    and copies link with nothing; an empty table gives no rows; other columns are ignored.
    Two texts of one scale meet with a chance of 0.998 at a likeness of 0.8, and of
    neighbouring scales, which share one grid only, of 0.96; links in a row join classes, too.
    """
    linked = linking.linked_classes(docs, Prints(least), through_ids=False).classes
    least_of = cut(linked.groupBy("component").agg(F.min("h1").alias("near_class"), F.count(F.lit(1)).alias("prints")).where("prints > 1"))
    return cut(join_hot(linked, least_of, ["component"], max(1, linked.count()), "prints").select("h1", "h2", "n", "near_class"))


def edited_and_near(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``next_and_edited`` with near_class: the same number for equal fingerprints and all that links join.

    It is the least first half of ``print_digest`` among a class's fingerprints, and
    null for a null or empty text.  Classes of several fingerprints are broadcast up to
    ``linking.BROADCAST_ROWS``; beyond, they are joined by shuffle, and texts with very
    many copies by a broadcast of theirs alone.
    """
    near, rows = near_classes(docs, least), next_and_edited(docs, digests=True)
    out = [c for c in rows.columns if c not in ("h1", "h2")]
    if near.count() <= linking.BROADCAST_ROWS:
        found = rows.join(F.broadcast(near.drop("n")), ["h1", "h2"], "left")
        return found.select(*out, F.coalesce("near_class", "h1").alias("near_class"))
    often = max(1, near.agg(F.sum("n")).first()[0] // (HOT_SHARE * partitions(docs.sparkSession)))
    hot = near.where(F.col("n") > often).select("h1", "h2", F.col("near_class").alias("hot_class"))
    found = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    # Rows that are done get keys that match nothing and differ by document, so no task gets all of them.
    spread = F.when(F.col("h1").isNotNull() & F.col("hot_class").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "edited_sha256"))
    rest = near.where(F.col("n") <= often).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "near_class")
    found = found.withColumn("spread", spread).join(rest, (F.col("spread") == rest["k1"]) & (F.col("h2") == rest["k2"]), "left")
    return found.select(*out, F.coalesce("hot_class", "near_class", "h1").alias("near_class"))


def next_and_edited(docs: DataFrame, digests: bool = False) -> DataFrame:
    """For each document its own and its edited text's fingerprint, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text has the last quarter of the text (rounded
    down) replaced by as many first characters of the next document by doc_id, or all
    it has; after the last comes the first.  A null text counts as empty.  Of rows with
    the same doc_id the order is that of a hash of their texts, and a null doc_id comes
    before all others.  A single row is its own next.  Other columns are ignored.  With
    ``digests``, h1 and h2 are ``print_digest`` of the fingerprint, null for an empty text.

    Documents are dealt out by ranges of doc_id and sorted there; the first document
    of each range is sent to the range before it as well, so each task sees the next
    document of its last one and no task sees more than its own ranges.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(2**63))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", lowest))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"))
    # Range boundaries are doc_ids at even ranks, a few ranges for each partition.
    ranges = RANGES_PER_PARTITION * partitions(spark)
    cuts = sorted(set(ids.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), keys.to_numpy(), "right").astype(np.int32))

    firsts = {r["bucket"]: r["least"] for r in ids.withColumn("bucket", range_of("key")).groupBy("bucket").agg(F.min("key").alias("least")).collect()}
    full = sorted(firsts)
    # One row for each range's first document, so as many as there are ranges.
    before = spark.createDataFrame([(firsts[b], full[i - 1]) for i, b in enumerate(full)], "key long, before int")
    sent = named.withColumn("bucket", range_of("key")).withColumn("tie", F.xxhash64("text")).join(F.broadcast(before), "key", "left")
    place = lambda bucket, halo: F.struct(F.col(bucket).alias("bucket"), F.lit(halo).alias("halo"))
    places = F.when(F.col("before").isNull(), F.array(place("bucket", 0))).otherwise(F.array(place("bucket", 0), place("before", 1)))
    sent = sent.withColumn("at", F.explode(places)).select("at.bucket", "doc_id", "at.halo", "text", "key", "tie")
    dealt = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "halo", "key", "tie")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, int, str]] = []  # bucket, doc_id, halo, text

        def done(rows: list[tuple[int, int | None, int, str]]) -> pa.RecordBatch:
            """All rows but the last, each with its next one."""
            texts, edited, keep = [], [], []
            for i, (bucket, _, halo, text) in enumerate(rows):
                texts.append(text)
                if halo or i + 1 == len(rows) or rows[i + 1][0] != bucket:
                    continue
                cut_off = len(text) // 4
                keep.append(i)
                edited.append(text[: len(text) - cut_off] + rows[i + 1][3][:cut_off])
            prints = fingerprints(texts + edited)
            own, new = prints[: len(texts)], prints[len(texts) :]
            columns = [
                [rows[i][1] for i in keep],
                [len(rows[i][3]) for i in keep],
                [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                [own[i] for i in keep],
                new,
                [likeness(own[i], n) for i, n in zip(keep, new, strict=True)],
                [likeness(own[i], own[i + 1]) for i in keep],
                [print_digest(own[i])[0] if texts[i] else None for i in keep],
                [print_digest(own[i])[1] if texts[i] else None for i in keep],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                held += zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
                if len(held) > 1:
                    yield done(held)
                    held = held[-1:]

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, h1 long, h2 long"
    edited = dealt.select("bucket", "doc_id", "halo", "text").mapInArrow(edit, kinds)
    return edited if digests else edited.drop("h1", "h2")


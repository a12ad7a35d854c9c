"""N-gram Jaccard self-join with signature trees.

A document's set is its distinct word shingles, as 64-bit hashes.  Documents that can
reach the threshold are brought together exactly, in two steps.

Routing.  Two sets that link differ in few shingles, at most D for a class of sizes.
The hash range is cut into D + 1 + S parts, so two linked sets agree on S + 1 whole
parts at least.  Each set leaves out the S parts that tell least, in an order that
depends on a part's content alone: fewest rare shingles first.  Of the parts that two
linked sets agree on, the last in that order has S others before it in neither set's
left-out ones, so both keep it: its digest is a routing key that they share.  Which
shingles are frequent is told by a sample; it changes how few keys strangers share, and
never the result.  Tasks combine equal keys before the shuffle, so a key that very many
documents share costs one entry a task.  Components of sets that share keys are families.

Signature trees.  Each family, in blocks of ``BLOCK`` sets, is made into trees: a node
has the OR of the token bitmaps below it and the range of sizes.  Two trees are
traversed together; a pair of nodes is left out if sizes or the largest possible
overlap rule out a link, or if all sets below both are linked already.  At the leaves
the overlaps are counted exactly.  Families of several blocks are linked within random
blocks, round by round, one set of each component going on; then only blocks of different
components are compared, each two as a task of its own.  The links' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import LOWER, UPPER, cut, unused
from .graph import join_hot

LEAF, FANOUT = 8, 4
#: Parts beyond those that a link needs, as a share of the shingles that may differ and a few more; so many give no key.
SLACK_SHARE, SLACK = 1.0, 2
#: Documents, about, whose shingles tell which are frequent; in how many of them such a one is; and how many are kept at most.
ROUTING_SAMPLE, FREQUENT_IN, FREQUENT_SHINGLES = 8000, 2, 500_000
#: The sizes of a class grow by this factor.
CLASS_RATIO = 1.4
#: Entries of a block's incidence matrix; blocks of longer documents are counted set by set.
MATRIX_ENTRIES = 12_000_000
#: Hashes of words that a worker remembers; they are cheap to make again.
CACHED_WORDS = 100_000

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0x1234567890ABCDEF & 2**64 - 1 | 1) for i in range(1, 65)]
_DROP = np.uint64(31)
_NONE = np.empty(0, np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray, odd: np.uint64 = _ODD[0]) -> np.ndarray:
    x = (x ^ (x >> _DROP)) * odd
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of so many words; of a shorter text, the whole as one.

    Words are runs without ASCII white space, with A-Z lower-cased.
    """
    parts = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * _ODD[i % len(_ODD)]
    total = np.sort(_mix(_mix(total, _ODD[40])))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed numbers."""
    size = np.uint64(len(shingles))
    with np.errstate(over="ignore"):
        one = _mix(np.array([_mix(shingles, _ODD[50]).sum(dtype=np.uint64) + size]), _ODD[51])
        two = _mix(np.array([_mix(shingles, _ODD[52]).sum(dtype=np.uint64) ^ size]), _ODD[53])
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


@lru_cache(8)
def _classes(longest: int) -> tuple[int, ...]:
    starts = [1]
    while starts[-1] <= longest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * CLASS_RATIO)))
    return tuple(starts)


def routing_keys(shingles: np.ndarray, num: int, den: int, frequent: np.ndarray = _NONE) -> np.ndarray:
    """The keys of a set that is not empty; two sets with a Jaccard of num/den or more share one.

    ``frequent`` are sorted hashes, the same for all sets.
    """
    size = len(shingles)
    starts = _classes(1 << (size * den // num + 1).bit_length())
    mixed = _mix(shingles, _ODD[54])
    high = shingles >> np.uint64(32)
    rare = np.ones(size, np.int64)
    if len(frequent):
        rare -= frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    keys = []
    # As the larger of a pair a set is in its own class, as the smaller in those of all larger partners.
    for c in range(int(np.searchsorted(starts, size, "right")) - 1, int(np.searchsorted(starts, size * den // num, "right"))):
        largest = starts[c + 1] - 1
        differ = 2 * largest * (den - num) // (den + num)
        slack = SLACK + int(SLACK_SHARE * differ)
        parts = differ + 1 + slack
        part = ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        digest = np.zeros(parts, np.uint64)
        digest[part[first]] = np.add.reduceat(mixed, first)
        some, telling = np.bincount(part, minlength=parts), np.bincount(part, rare, parts)
        kept = np.lexsort((np.arange(parts), digest, some, telling))[slack:]
        keys.append(_mix(digest[kept] + _mix((kept + 1).astype(np.uint64) + (np.uint64(c) << np.uint64(40)), _ODD[55]), _ODD[56]))
    return np.concatenate(keys)


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles in several documents of a bounded sample, the most frequent ones.

    The sample is by a hash of the text and takes a text once or more as it occurs.
    """
    share = min(1.0, ROUTING_SAMPLE / max(1, docs.count()))
    sampled = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            if sets:
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], schema=schema)

    counted = sampled.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_IN)
    found = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT_SHINGLES).select("shingle").toArrow().column(0)
    return np.sort(np.asarray(found.to_numpy(), np.int64).view(np.uint64))


class SignatureTree:
    """A tree over sets: each node has the OR of the bitmaps below it, and what bounds sizes and overlaps."""

    def __init__(self, sets: Sequence[np.ndarray], bits: int):
        #: Sets in the tree's order, so that similar ones are near each other.
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        sizes = np.array([len(sets[i]) for i in self.order])
        words = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order):
            at = sets[i] & np.uint64(bits - 1)
            np.bitwise_or.at(words[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        # Shingles of a set beyond its bits: so many more may overlap than the bits show.
        beyond = sizes - np.bitwise_count(words).sum(axis=1)
        #: For each level from the leaves: bitmaps, least size, largest size, most beyond; and the sets below a node.
        self.levels = []
        step = LEAF
        first = np.arange(0, len(sets), step)
        level = (np.bitwise_or.reduceat(words, first), np.minimum.reduceat(sizes, first), np.maximum.reduceat(sizes, first), np.maximum.reduceat(beyond, first))
        self.levels.append((step, *level))
        while len(level[0]) > 1:
            first = np.arange(0, len(level[0]), FANOUT)
            step *= FANOUT
            level = (np.bitwise_or.reduceat(level[0], first), np.minimum.reduceat(level[1], first), np.maximum.reduceat(level[2], first), np.maximum.reduceat(level[3], first))
            self.levels.append((step, *level))
        self.count = len(sets)

    def span(self, level: int, node: int) -> tuple[int, int]:
        step = self.levels[level][0]
        return node * step, min(self.count, (node + 1) * step)

    def may_link(self, level: int, node: int, other: SignatureTree, other_level: int, other_node: int, num: int, den: int) -> bool:
        _, bits, low, high, beyond = (x if i == 0 else x[node] for i, x in enumerate(self.levels[level]))
        _, bits2, low2, high2, beyond2 = (x if i == 0 else x[other_node] for i, x in enumerate(other.levels[other_level]))
        if high * den < low2 * num or high2 * den < low * num:
            return False
        overlap = int(np.bitwise_count(bits & bits2).sum()) + min(int(beyond), int(beyond2))
        # A link needs an overlap of num / (num + den) of both sizes together.
        return overlap * (num + den) >= num * int(low + low2)


def tree_links(sets: Sequence[np.ndarray], sides: Sequence[int], num: int, den: int, known: Sequence[int] | None = None) -> list[int]:
    """For each set the first one of its component, by links within one side or, of two, across them.

    With one side all pairs are compared; with two, those across only.  Sets with equal
    ``known`` numbers are in one component already.
    """
    label = list(range(len(sets)))
    groups = {i: [i] for i in label}

    def join(i: int, j: int) -> None:
        one, two = label[i], label[j]
        if one != two:
            small, large = sorted((one, two), key=lambda x: len(groups[x]))
            for k in groups[small]:
                label[k] = large
            groups[large] += groups.pop(small)

    met: dict[int, int] = {}
    for i, k in enumerate(known or ()):
        join(i, met.setdefault(k, i))
    bits = 64
    while bits < 8 * max(map(len, sets)):
        bits *= 2
    names = sorted(set(sides))
    members = [[i for i, s in enumerate(sides) if s == name] for name in names]
    trees = [SignatureTree([sets[i] for i in m], bits) for m in members]
    placed = [[m[i] for i in t.order] for m, t in zip(members, trees, strict=True)]
    one, two = 0, len(trees) - 1
    overlap = _overlaps(sets)
    top = len(trees[one].levels) - 1, 0, len(trees[two].levels) - 1, 0
    stack = [top]
    while stack:
        level, node, level2, node2 = stack.pop()
        x, y = trees[one].span(level, node)
        x2, y2 = trees[two].span(level2, node2)
        here, there = placed[one][x:y], placed[two][x2:y2]
        if len({label[i] for i in here} | {label[i] for i in there}) == 1:
            continue
        if not trees[one].may_link(level, node, trees[two], level2, node2, num, den):
            continue
        if level == 0 and level2 == 0:
            common = overlap(here, there)
            sizes, sizes2 = np.array([len(sets[i]) for i in here]), np.array([len(sets[i]) for i in there])
            linked = common * (num + den) >= num * (sizes[:, None] + sizes2[None, :])
            for i, j in zip(*np.nonzero(linked), strict=True):
                join(here[i], there[j])
            continue
        if level >= level2:
            below = [(level - 1, n) for n in range(node * FANOUT, min((node + 1) * FANOUT, len(trees[one].levels[level - 1][1])))]
            pairs = [(*b, level2, node2) for b in below]
        else:
            below = [(level2 - 1, n) for n in range(node2 * FANOUT, min((node2 + 1) * FANOUT, len(trees[two].levels[level2 - 1][1])))]
            pairs = [(level, node, *b) for b in below]
        if one == two:
            # Of a tree with itself, a pair of nodes is visited in one order only.
            pairs = [p for p in pairs if trees[one].span(p[0], p[1])[0] < trees[one].span(p[2], p[3])[1]]
        stack += pairs
    firsts = {name: min(g) for name, g in groups.items()}
    return [firsts[x] for x in label]


def _overlaps(sets: Sequence[np.ndarray]):
    """A function of two lists of sets' numbers that counts the overlap of each pair."""
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(codes, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    width = int(shared.sum())
    if width * len(sets) <= MATRIX_ENTRIES:
        matrix = np.zeros((len(sets), max(1, width)), np.float32)
        ends = np.cumsum([len(s) for s in sets])
        for i, (end, s) in enumerate(zip(ends.tolist(), sets, strict=True)):
            mine = codes[end - len(s) : end]
            matrix[i, column[mine[shared[mine]]]] = 1
        return lambda here, there: (matrix[here] @ matrix[there].T).astype(np.int64)

    def counted(here: list[int], there: list[int]) -> np.ndarray:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in there] for i in here], np.int64)

    return counted


class Shingles:
    """Texts compared by the Jaccard of their sets of shingles, num/den or more; ``frequent`` is broadcast."""

    dtype = np.dtype(np.uint64)
    sure = True

    def __init__(self, words: int, num: int, den: int, frequent: Broadcast):
        self.words, self.num, self.den, self.frequent = words, num, den, frequent

    def forms(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        return [shingle_set(t, self.words) for t in texts]

    def digest(self, form: np.ndarray) -> tuple[int, int]:
        return set_digest(form)

    def keys(self, form: np.ndarray) -> np.ndarray:
        return routing_keys(form, self.num, self.den, self.frequent.value)

    def firsts(self, forms: Sequence[np.ndarray], sides: Sequence[int], known: Sequence[int]) -> list[int]:
        return tree_links(forms, sides, self.num, self.den, known)

    def done(self) -> None:
        _HASHES.clear()


def linked_sets(docs: DataFrame, words: int, num: int, den: int, through_ids: bool = True) -> linking.Classes:
    """The classes of equal shingle sets of ``docs`` and their components by links of num/den or more."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    return linking.linked_classes(docs, Shingles(words, num, den, frequent), through_ids)


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two documents link when the Jaccard of their shingle sets is num/den or more;
    component_id is the least doc_id that links reach, the own one included.  A text of
    fewer words than a shingle is one shingle.  A null or empty text, or one of white
    space only, has an empty set and links with nothing.  Rows are judged by their own
    texts; rows that share a doc_id are linked through it, if their sets are not empty.
    A row with a null doc_id has the least doc_id of its component, or null.  Other
    columns are ignored.
    """
    linked = linked_sets(docs, words, num, den)
    least = linked.classes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    total = linked.classes.count()
    named = cut(join_hot(linked.classes, cut(least.withColumnRenamed("sets", "n_sets")), ["component"], total, "n_sets").select("h1", "h2", "n", "component_id"))
    found = join_hot(linked.rows.where("h1 is not null"), named, ["h1", "h2"], linked.rows.count())
    alone = linked.rows.where("h1 is null").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def distinct_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of near duplicates, all columns as they were.

    Groups are by links of num/den or more between texts, never by ids alone: rows are
    dropped, not ids, so unlike texts that share a doc_id all stay.  Of a group the row
    with the least doc_id stays (a null one comes last), then the one with the least
    set; equal sets of one doc_id give the row with the least text.  Rows whose text has
    no words are in no group and stay.
    """
    linked = linked_sets(docs, words, num, den, through_ids=False)
    total = linked.rows.count()
    named = join_hot(linked.rows.where("h1 is not null"), linked.classes.select("h1", "h2", "n", "component"), ["h1", "h2"], total)
    sets = cut(named.groupBy("doc_id", "h1", "h2", "component").agg(F.count(F.lit(1)).alias("rows")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = cut(sets.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    judged = cut(join_hot(sets, first, ["component"], total).withColumn("stays", order == F.col("first")))
    # An id none of whose rows stays, or all of them, tells by itself; of others each row's set must be known.
    ids = judged.where("doc_id is not null").groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.max("stays").alias("some"))
    gone = cut(ids.where("not some").select(F.col("doc_id").alias("_id")))
    several = cut(ids.where("some and rows > 1").select(F.col("doc_id").alias("_id")))

    def of_ids(ids: DataFrame, inside: bool) -> DataFrame:
        """The rows of ``docs`` whose id is among ``ids``, or all others; their texts are never shuffled."""
        own = F.col("doc_id").cast("long")
        if ids.count() <= linking.BROADCAST_ROWS:
            return docs.join(F.broadcast(ids), own == F.col("_id"), "left_semi" if inside else "left_anti")
        has = own.isNotNull() & linking.among(ids, F.coalesce(own, F.lit(0)))
        return docs.where(has if inside else ~has)

    wordless = F.coalesce(~F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = of_ids(gone.unionByName(several), False).where(F.col("doc_id").isNotNull() | wordless)
    odd = docs.where("doc_id is null")
    if not several.isEmpty():
        odd = odd.unionByName(of_ids(several, True))
    # Wordless rows of ids whose other rows go are back, too.
    alone = cut(linked.rows.where("h1 is null").select(F.col("doc_id").alias("_id")).join(gone, "_id", "left_semi").distinct())
    if not alone.isEmpty():
        kept = kept.unionByName(of_ids(alone, True).where(wordless))

    @F.pandas_udf("h1 long, h2 long")
    def digest(texts: pd.Series) -> pd.DataFrame:
        made = [shingle_set(t, words) for t in texts]
        names = [set_digest(x) if len(x) else (None, None) for x in made]
        return pd.DataFrame({"h1": pd.array([a for a, _ in names], "Int64"), "h2": pd.array([b for _, b in names], "Int64")})

    told = unused(docs, "set")
    # Called nondeterministic, it runs once for the filter on its result and the key together; else in two Python workers a task.
    odd = odd.withColumn(told, digest.asNondeterministic()(F.col("text").cast("string")))
    key = [F.col("doc_id").cast("long").alias("k0"), F.col(f"{told}.h1").alias("k1"), F.col(f"{told}.h2").alias("k2")]
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = odd.where(F.col(f"{told}.h1").isNotNull()).groupBy(*key).agg(F.min_by(whole, "text").alias("row"))
    stay = judged.where("stays").select("doc_id", "h1", "h2")
    one = one.join(stay, one["k0"].eqNullSafe(stay["doc_id"]) & (one["k1"] == stay["h1"]) & (one["k2"] == stay["h2"]), "left_semi").select("row.*")
    return kept.unionByName(odd.where(F.col(f"{told}.h1").isNull() & F.col("doc_id").isNotNull()).select(*docs.columns)).unionByName(one)

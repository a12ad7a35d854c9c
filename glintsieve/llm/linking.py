"""Links between texts that share keys: classes of equal texts, candidates, links and their components.

What an operator compares texts by is a ``Comparison``: the form of a text, its digest,
keys of which two linked forms share one, and the links among forms.  Equal forms are
one class.  Tasks combine equal keys before the shuffle, so a key that very many share
costs one entry a task.  Components of classes that share keys are families; a family
is linked in blocks, as ``_links`` says, and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import cut, drop_cut, give_back, partitions
from .graph import components, join_hot, least_reached

#: Classes in a block of a family.
BLOCK = 128
#: A family of more blocks, if links leave its sets apart, isn't compared whole: its sets meet by their keys.
MEET_BLOCKS = 8
#: Routing buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 4
#: Up to so many rows, two numbers each, the candidates' ids are broadcast; beyond, 8 bytes of each, and only rows that these let through are shuffled.
BROADCAST_ROWS = 500_000
#: Documents whose keys are combined together in a task.
TOGETHER = 1500


class Comparison(Protocol):
    """How an operator compares texts; it is sent to the workers."""

    #: The numbers that forms are made of.
    dtype: np.dtype
    #: Whether any two forms that link share a key; else more links are found where whole families are compared.
    sure: bool

    def forms(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """What texts are compared by; an empty form links with nothing."""

    def digest(self, form: np.ndarray) -> tuple[int, int]:
        """A 128-bit digest of a form that is not empty, as two signed numbers."""

    def keys(self, form: np.ndarray) -> np.ndarray:
        """The 64-bit keys of a form; of two that link, both have one of them."""

    def firsts(self, forms: Sequence[np.ndarray], sides: Sequence[int], known: Sequence[int]) -> list[int]:
        """For each form the first one of its component, by links within one side or, of two, across them; equal ``known`` are linked already."""

    def done(self) -> None:
        """Frees what a worker keeps between texts."""


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least node, and the distinct edges (node, least node) of keys with several."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = np.flatnonzero(new)
    least = np.repeat(nodes[first], np.diff(np.append(first, len(keys))))
    differ = nodes != least
    edges = np.unique(np.stack((nodes[differ], least[differ]), 1), axis=0) if differ.any() else np.empty((0, 2), np.int64)
    return keys[first], nodes[first], edges[:, 0], edges[:, 1]


_ROUTED = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("size", pa.int64()), ("th", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("blob", pa.binary())])
_ROUTED_KINDS = "bucket int, doc_id long, size long, th long, h1 long, h2 long, a long, b long, blob binary"


def _rows(schema: pa.Schema, **columns: Sequence) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _route(docs: DataFrame, by: Comparison) -> DataFrame:
    """One row for each document (doc_id, size of its form, text's hash th, h1, h2) and one for each edge (a, b) between digests."""
    spark = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * partitions(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, TOGETHER):
                    turn += 1
                    yield from emit_some(whole.slice(at, TOGETHER), turn)
        finally:
            by.done()
            give_back()

    def emit_some(batch: pa.RecordBatch, turn: int) -> Iterator[pa.RecordBatch]:
        ids, sizes, ones, twos = batch.column(0).to_pylist(), [], [], []
        keys, nodes = [], []
        seen: set[tuple[int, int]] = set()
        for form in by.forms(batch.column(1).to_pylist()):
            one, two = by.digest(form) if len(form) else (None, None)
            sizes.append(len(form))
            ones.append(one)
            twos.append(two)
            if len(form) and (one, two) not in seen:
                seen.add((one, two))
                keys.append(by.keys(form))
                nodes.append(np.full(len(keys[-1]), one, np.int64))
        yield _rows(_ROUTED, bucket=[(turn * 7919 + i) % buckets for i in range(len(ids))], doc_id=ids, size=sizes, th=batch.column(2).to_pylist(), h1=ones, h2=twos)
        if not keys:
            return
        key, node, a, b = _stars(np.concatenate(keys), np.concatenate(nodes))
        if len(a):
            yield _rows(_ROUTED, bucket=(np.abs(a) % buckets).astype(np.int32), a=a, b=b)
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # keys are sorted, and so are buckets
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(edge[1:], len(key))
        blobs = [key[x:y].tobytes() + node[x:y].tobytes() for x, y in zip(edge.tolist(), ends.tolist(), strict=True)]
        yield _rows(_ROUTED, bucket=bucket[edge].astype(np.int32), blob=blobs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                halves = [(np.frombuffer(x, np.uint64, len(x) // 16), np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2)) for x in held]
                _, _, a, b = _stars(np.concatenate([x for x, _ in halves]), np.concatenate([x for _, x in halves]))
                if len(a):
                    yield _rows(_ROUTED, a=a, b=b)
                held.clear()

        for batch in batches:
            blobs = batch.column("blob").is_valid()
            other = batch.filter(pa.compute.invert(blobs))
            if other.num_rows:
                yield other
            mine = batch.filter(blobs)
            for bucket, blob in zip(mine.column(0).to_pylist(), mine.column("blob").to_pylist(), strict=True):
                if bucket != at:
                    yield from flush()
                    at = bucket
                held.append(blob)
        yield from flush()
        give_back()

    routed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th")).mapInArrow(emit, _ROUTED_KINDS)
    dealt = routed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return cut(dealt.mapInArrow(meet, _ROUTED_KINDS).select("doc_id", "size", "th", "h1", "h2", "a", "b"))


def among(names: DataFrame, name: Column) -> Column:
    """Whether ``name``, a long that is not null, is among ``names`` (one long): these are sent to all workers, 8 bytes each."""
    known = names.sparkSession.sparkContext.broadcast(np.unique(names.toArrow().column(0).to_numpy()))

    @F.pandas_udf("boolean")
    def listed(values: pd.Series) -> pd.Series:
        asked = values.to_numpy()
        at = np.searchsorted(known.value, asked)
        return pd.Series(np.append(known.value, 0)[at] == asked) & (at < len(known.value))

    return listed(name)


class Classes(NamedTuple):
    """Rows by their form, and what links reach."""

    #: (doc_id, size, h1, h2) of each row; size is the form's, h1 and h2 are null for an empty one.
    rows: DataFrame
    #: (h1, h2, n, node, rep, component) of each form that is not empty: how many rows have it, their least doc_id, and the least node that links reach.
    classes: DataFrame


def linked_classes(docs: DataFrame, by: Comparison, through_ids: bool = True) -> Classes:
    """The classes of equal forms of ``docs`` (doc_id, text) and their components by links.

    With ``through_ids``, classes that share a doc_id are linked as well.
    """
    routed = _route(docs, by)
    own = routed.where("size is not null").select("doc_id", "size", "h1", "h2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    named = routed.where("size > 0").groupBy("h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    # Numbers of written rows don't change any more.
    classes = cut(named.select("h1", "h2", "n", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"), F.monotonically_increasing_id().alias("node")))
    families = components(routed.where("a is not null").select("a", "b"))
    family = cut(classes.join(families, classes["h1"] == families["node"]).select(classes["node"], "h1", "h2", "rep", "th", F.col("component").alias("family")))
    if family.count() <= graph.DRIVER_EDGES:
        links = _few_links(docs, family, by)
    else:
        total = classes.count()
        links = _links(docs, _in_families(family, 2, total), by, total)
    drop_cut(family)
    if through_ids:
        links = links.unionByName(_through_ids(own, classes))
    found = components(links)
    return Classes(own, cut(classes.join(found, "node", "left").select("h1", "h2", "n", "node", "rep", F.coalesce("component", "node").alias("component"))))


def _in_families(members: DataFrame, least: int, total: int) -> DataFrame:
    """``members`` (family, ...) of families with ``least`` members or more, with the number of their blocks."""
    sizes = cut(members.groupBy("family").agg(F.count(F.lit(1)).alias("n")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    found = cut(join_hot(members, sizes.where(F.col("n") >= least).select("family", "n", blocks), ["family"], total))
    drop_cut(sizes)
    return found


def _through_ids(own: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that share a doc_id, each with the least of them."""
    named = own.where("h1 is not null and doc_id is not null")
    key = F.struct("h1", "h2")
    several = cut(named.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).where("low != high").select("doc_id", "n"))
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return own.sparkSession.createDataFrame([], "a long, b long")
    shared = cut(join_hot(named.select("doc_id", "h1", "h2"), several, ["doc_id"], total).distinct().join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node"))
    least = cut(shared.groupBy("doc_id").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")))
    return cut(join_hot(shared, least, ["doc_id"], total).select(F.col("node").alias("a"), "b").where("a != b"))


_EDGES = "family long, a long, b long"


def _placed(docs: DataFrame, asked: DataFrame, by: Comparison) -> DataFrame:
    """(node, family, blocks, form) of each row of ``asked`` (node, h1, h2, rep, th, family, blocks), from the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    if asked.count() <= BROADCAST_ROWS:
        few = F.broadcast(asked)
    else:  # whole texts are shuffled, so only those that are asked for
        few, place = asked, lambda doc_id: F.xxhash64(doc_id, "th")
        texts = texts.where(among(asked.select(place("rep")), place("doc_id")))
    wanted = texts.join(few, texts["doc_id"].eqNullSafe(few["rep"]) & (texts["th"] == few["th"])).select("node", "family", "blocks", "h1", "h2", "text")

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch[~batch["node"].isin(seen)].drop_duplicates("node")
            made = by.forms(list(batch.pop("text")))
            same = [len(x) > 0 and by.digest(x) == (a, b) for x, a, b in zip(made, batch["h1"], batch["h2"], strict=True)]
            batch["form"] = [x.tobytes() for x in made]
            batch = batch.loc[same, ["node", "family", "blocks", "form"]]
            seen.update(batch["node"].tolist())
            yield batch

    return wanted.mapInPandas(forms, "node long, family long, blocks int, form binary")


def _by_keys(placed: DataFrame, members: DataFrame, by: Comparison) -> tuple[DataFrame, np.ndarray]:
    """(node, family, label) of ``members`` (node, family, label), with new families in which all meet that have unlike labels and share a key; and whose members these are.

    Families in which very many pairs share several keys are left out: compared whole
    they take fewer copies.  A new family is one key, or several that few have; keys that
    the same sets have count once.  The driver holds a few numbers of each such key, and
    16 bytes go to all workers.
    """

    def keys(known: Broadcast | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), TOGETHER):
                    batch = whole.iloc[at : at + TOGETHER]
                    made = [np.unique(by.keys(np.frombuffer(x, by.dtype))).view(np.int64) for x in batch["form"]]
                    rows = batch.loc[batch.index.repeat([len(x) for x in made]), ["node", "family", "label"]].assign(key=np.concatenate(made))
                    if known:
                        asked, family = known.value
                        place = np.minimum(np.searchsorted(asked, rows["key"]), len(asked) - 1)
                        rows = rows.assign(family=family[place])[asked[place] == rows["key"]].drop_duplicates(["node", "family"])
                    yield rows[["node", "family", "label", "key"]]
            give_back()

        return emit

    context, kinds = placed.sparkSession.sparkContext, "node long, family long, label long, key long"
    forms = placed.where(F.col("blocks") > MEET_BLOCKS).select("node", "form").join(members, "node")
    digests = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")).alias(f"d{i}") for i in (1, 2)]
    met = forms.mapInPandas(keys(None), kinds).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("family"), F.min("label").alias("low"), F.max("label").alias("high"), *digests)
    # A key is of one family.
    found = cut(met.where("low != high").groupBy("family", "n", "d1", "d2").agg(F.min("key").alias("key"), F.min("low").alias("low")).select("key", "n", "family", "low"))
    some = found.toArrow()
    drop_cut(found)
    key, n, of, low = (some.column(c).to_numpy() for c in ("key", "n", "family", "low"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n")).toArrow()
    families, copies = sizes.column("family").to_numpy(), sizes.column("n").to_numpy()
    order = np.argsort(families)
    families, copies = families[order], (copies * -(-copies // BLOCK))[order]
    place = np.searchsorted(families, of)
    fewer = np.bincount(place, n * -(-n // BLOCK), len(families)) < copies
    key, n, low = (x[fewer[place]] for x in (key, n, low))
    order = np.lexsort((key, low, n >= BLOCK))  # keys of one label are next to each other
    family = np.empty(len(key), np.int64)
    family[order] = -1 - np.where(n[order] >= BLOCK, np.arange(len(key)) + np.sum(n), np.cumsum(n[order]) // BLOCK)
    order = np.argsort(key)
    if not len(key):
        return members.where("false"), families[fewer]
    known = context.broadcast((key[order], family[order]))
    return cut(forms.mapInPandas(keys(known), kinds).select("node", "family", "label").distinct()), families[fewer]


def _linker(by: Comparison) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For a group of (node, family, form, side, label), the edges between labels that links join; a label is one of the nodes that are linked already."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node", kind="stable")
        labels = group["label"].tolist()
        firsts = by.firsts([np.frombuffer(x, by.dtype) for x in group["form"]], group["side"].tolist(), labels)
        edges = [(group["family"].iloc[0], a, b) for a, b in sorted({(labels[i], labels[f]) for i, f in enumerate(firsts)}) if a != b]
        return pd.DataFrame(edges, columns=["family", "a", "b"], dtype="int64")

    return link


def _links(docs: DataFrame, asked: DataFrame, by: Comparison, total: int) -> DataFrame:
    """(a, b) nodes of ``asked`` (node, h1, h2, rep, th, family, blocks) that links join, enough of them to tell the components.

    In rounds, each family is cut into blocks at random, the links in a block are found,
    and of each component so far one class goes on, until rounds help little.  So a family
    of very many near copies shrinks by a factor a round.  Then all classes of different
    components meet, block by block; blocks of one component never do.  In a family of
    more than ``MEET_BLOCKS`` only those meet that share a key, as all do that link,
    if that takes fewer copies of them.
    """
    link, kinds = _linker(by), _EDGES
    block = lambda turn: F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int")
    placed = _placed(docs, asked, by)
    large = asked.where("blocks > 1").select("node", "family", "blocks")
    some_large = not large.isEmpty()
    if some_large:  # their forms are needed again
        placed = cut(placed)
    now = placed.select("node", "family", "form", block(0).alias("block"), F.lit(0).alias("side"), F.col("node").alias("label"))
    edges = cut(now.groupBy("family", "block").applyInPandas(link, kinds))
    if not some_large:
        return edges.select("a", "b")
    active, turn = large, 0
    while True:
        labels = components(edges.join(large.select("family").distinct(), "family", "left_semi").select("a", "b"))
        if turn:
            drop_cut(labelled)
        labelled = cut(large.join(labels, "node", "left").select("node", "family", F.coalesce("component", "node").alias("label")))
        reached, before = labelled.groupBy("family", "label").agg(F.min("node").alias("node")), active.count()
        older, active, turn = active, _in_families(reached, 2, total), turn + 1
        if turn > 1:
            drop_cut(older)
        if active.count() * 3 > before * 2:
            break
        again = active.select("node", "family", "blocks", F.col("node").alias("label"))
        again = placed.select("node", "form").join(again, "node").select("node", "family", "form", block(turn).alias("block"), F.lit(0).alias("side"), "label")
        edges, older = cut(edges.unionByName(again.groupBy("family", "block").applyInPandas(link, kinds))), edges
        drop_cut(older)
    apart = labelled.join(active.select("family").distinct(), "family", "left_semi")
    if by.sure:
        many = apart.join(large.where(F.col("blocks") > MEET_BLOCKS).select("family").distinct(), "family", "left_semi")
        if not many.isEmpty():
            keyed, families = _by_keys(placed, many, by)
            done = F.broadcast(active.sparkSession.createDataFrame(pa.table({"family": families})))  # large ones, each of many rows
            apart = apart.join(done, "family", "left_anti").select("node", "family", "label").unionByName(keyed)
    met = _unlike_blocks(apart)
    if met is not None:
        last = placed.select("node", "form").join(met, "node").groupBy("family", "low", "high").applyInPandas(link, kinds)
        edges, older = cut(edges.unionByName(last)), edges
        drop_cut(older)
    drop_cut(placed)
    return edges.select("a", "b")


def _few_links(docs: DataFrame, family: DataFrame, by: Comparison) -> DataFrame:
    """(a, b) as ``_links`` gives them, for up to ``graph.DRIVER_EDGES`` rows of ``family`` (node, h1, h2, rep, th, family).

    The rounds are the same, and which sets meet after them.  The driver holds a few numbers of each class, deals the
    classes to blocks and finds what links reach so far; the workers read texts and
    link.  So a round is one shuffle, however many partitions the session has.
    """
    spark = docs.sparkSession
    asked = family.toArrow()
    _, code, size = np.unique(asked.column("family").to_numpy(), return_inverse=True, return_counts=True)
    blocks = -(-size[code] // BLOCK)
    asked, blocks = asked.append_column("blocks", pa.array(blocks, pa.int32())).filter(pa.array(size[code] > 1)), blocks[size[code] > 1]
    if not asked.num_rows:
        return spark.createDataFrame([], "a long, b long")
    link = _linker(by)
    placed = _placed(docs, spark.createDataFrame(asked), by)
    large = blocks > 1
    if large.any():  # their forms are needed again
        placed = cut(placed)
    block = F.pmod(F.xxhash64("node", F.lit(0)), F.col("blocks")).cast("int").alias("block")
    found = placed.select("node", "family", "form", block, F.lit(0).alias("side"), F.col("node").alias("label")).groupBy("family", "block").applyInPandas(link, _EDGES).toArrow()
    a, b = (found.column(c).to_numpy() for c in "ab")
    if not large.any():
        return spark.createDataFrame(pa.table({"a": a, "b": b}))
    node, of = (asked.column(c).to_numpy()[large] for c in ("node", "family"))
    draw, active = np.random.default_rng(7), len(node)

    def meet(on: list[str], **columns: np.ndarray) -> DataFrame:
        kept = F.broadcast(spark.createDataFrame(pa.table(columns)))
        rows = placed.select("node", "form").join(kept, "node")
        if "parts" in columns:
            rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).where("other < first or other >= after")
            rows = rows.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
        return rows.groupBy(*on).applyInPandas(link, _EDGES)

    while True:
        reached, least = least_reached(np.append(a, node), np.append(b, node))
        label = least[np.searchsorted(reached, node)]
        first = node == label  # a label is the least node of its component
        _, code, size = np.unique(of[first], return_inverse=True, return_counts=True)
        goes = np.flatnonzero(first)[size[code] > 1]
        if len(goes) * 3 > active * 2:
            break
        active = len(goes)
        if not active:
            break
        again, mine = node[goes], of[goes]
        order = np.lexsort((draw.random(active), mine))
        again, mine = again[order], mine[order]
        found = meet(["family", "block"], node=again, family=mine, block=_ranks(mine) // BLOCK, side=np.zeros(active, np.int32), label=again).toArrow()
        a, b = (np.concatenate((x, found.column(c).to_numpy())) for x, c in ((a, "a"), (b, "b")))
    links = spark.createDataFrame(pa.table({"a": a, "b": b}))
    open_ = np.isin(of, of[goes])
    if open_.any():
        met = [x[open_] for x in (node, of, label)]
        wide = open_ & (blocks[large] > MEET_BLOCKS) & by.sure
        if wide.any():
            members = F.broadcast(spark.createDataFrame(pa.table({"node": node[wide], "family": of[wide], "label": label[wide]})))
            keyed, families = _by_keys(placed, members, by)
            found, rest = keyed.toArrow(), ~np.isin(met[1], families)
            met = [np.concatenate((x[rest], found.column(c).to_numpy())) for x, c in zip(met, ("node", "family", "label"), strict=True)]
        if len(met[0]):
            links = links.unionByName(cut(meet(["family", "low", "high"], **_unlike_places(*met, draw)).select("a", "b")))
    drop_cut(placed)
    return links


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The place of each number among its equals, which are next to each other."""
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def _unlike_places(node: np.ndarray, family: np.ndarray, label: np.ndarray, draw: np.random.Generator) -> dict[str, np.ndarray]:
    """Where each node meets others: its block ``side`` among the ``parts`` of its family, and the blocks from ``first`` to before ``after``, of its own label, that it doesn't meet.

    As in ``_unlike_blocks``: a label of ``BLOCK`` nodes or more has blocks of its own,
    the nodes of smaller ones share blocks, and these meet themselves as well.
    """
    out = {k: np.zeros(len(node), np.int64) for k in ("side", "first", "after", "parts")}
    order = np.lexsort((node, label, family))
    for mine in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
        _, code, size = np.unique(label[mine], return_inverse=True, return_counts=True)
        small = size < BLOCK
        shuffled = draw.permutation(np.flatnonzero(small))
        part = np.zeros(len(size), np.int64)
        part[shuffled] = (np.cumsum(size[shuffled]) - size[shuffled]) // BLOCK
        mixed = int(part[small].max()) + 1 if small.any() else 0
        wide = np.where(small, 0, -(-size // BLOCK))
        after = mixed + np.cumsum(wide)
        first = after - wide
        out["side"][mine] = np.where(small[code], part[code], first[code] + _ranks(code) // BLOCK)
        out["first"][mine], out["after"][mine] = np.where(small, 0, first)[code], np.where(small, 0, after)[code]
        out["parts"][mine] = mixed + int(wide.sum())
    return {"node": node, "family": family, "label": label} | out


def _unlike_blocks(mine: DataFrame) -> DataFrame | None:
    """(node, family, label, low, high, side) for every two blocks of a family of ``mine`` (node, family, label) in which sets have different labels; None if there are none.

    A label of ``BLOCK`` sets or more has blocks of its own, which meet those of others;
    the sets of smaller labels share blocks, and these meet themselves as well.
    """
    total = mine.count()
    if not total:
        return None
    counts = cut(mine.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n")))
    small = counts.where(F.col("n") < BLOCK).groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).alias("mixed"))
    own = counts.join(small, "family", "left").select("family", "label", "n", F.when(F.col("n") >= BLOCK, F.col("label")).alias("of"), F.when(F.col("n") >= BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(F.col("mixed")).alias("parts"))
    by = F.when(F.col("of").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("node"))
    parted = cut(join_hot(mine, cut(own), ["family", "label"], total).withColumn("part", F.pmod(by, F.col("parts"))))
    order = Window.partitionBy("family").orderBy("of", "part")
    blocks = cut(parted.groupBy("family", "of", "part").agg(F.count(F.lit(1)).alias("sets")).withColumn("block", F.row_number().over(order)))
    mixed, whole = blocks.where("of is null").select("family", F.col("block").alias("one")), blocks.where("of is not null").select("family", "of", "block")
    pairs = mixed.join(blocks.select("family", "block"), "family").where("one <= block").select("family", F.col("one").alias("low"), F.col("block").alias("high"))  # mixed blocks come first
    labels = whole.select("family", "of").distinct()
    two = labels.join(labels.select("family", F.col("of").alias("of2")), "family").where("of < of2")
    across = two.join(whole.withColumnRenamed("block", "b1"), ["family", "of"]).join(whole.select("family", F.col("of").alias("of2"), F.col("block").alias("b2")), ["family", "of2"])
    pairs = pairs.unionByName(across.select("family", F.least("b1", "b2").alias("low"), F.greatest("b1", "b2").alias("high")))
    asked = pairs.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    placed = parted.join(blocks.drop("sets"), [parted["family"] == blocks["family"], parted["of"].eqNullSafe(blocks["of"]), parted["part"] == blocks["part"]]).select("node", parted["family"], "label", "block")
    return placed.join(asked, ["family", "block"]).select("node", "family", "label", "low", "high", F.col("block").alias("side"))

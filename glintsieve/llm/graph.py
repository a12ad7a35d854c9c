"""Connected components of a distributed graph, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, partitions

#: A key is hot from so small a part of a partition's even share of the rows on.
HOT_SHARE = 4
#: Up to so many edges, two numbers each, the driver finds the components; rounds of stages are for more.
DRIVER_EDGES = 200_000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """``rows`` inner-joined to ``facts``, which has each key once with the number of its rows in ``count``.

    Keys with more rows than a small part of a partition's share go by a broadcast:
    their facts are fewer than ``HOT_SHARE`` for each partition, whatever the input.  So
    no task gets all rows of a hot key.  Null keys join nothing.
    """
    least = max(1, total // (HOT_SHARE * partitions(rows.sparkSession)))
    hot = F.broadcast(facts.where(F.col(count) > least).drop(count))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").where(" and ".join(f"{k} is not null" for k in keys))
    return rows.join(hot, keys).unionByName(rest.join(facts.where(F.col(count) <= least).drop(count), keys))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the least node reachable.

    Every round first links each node's larger neighbours to its least neighbour, and
    then its smaller ones, until nothing changes; that takes a number of rounds
    logarithmic in the longest path.  Minima are pre-aggregated.  A hub's edges are
    joined to one row, and adaptive execution splits that join where they are very many.
    Null ends and loops are dropped; a node without another is not in the result.
    Up to ``DRIVER_EDGES`` the driver does the same at once, and the result is to be
    broadcast; ``edges`` are read twice then, so they should be cheap to read.
    """
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if _state(now)[0] <= DRIVER_EDGES:  # repeated ones counted each
        return _at_driver(now)
    now = cut(now.distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a")
        smaller = smaller.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now, older = cut(smaller.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), now
        drop_cut(older)
        state, last = _state(now), state
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _at_driver(edges: DataFrame) -> DataFrame:
    ends = edges.toArrow()
    return F.broadcast(edges.sparkSession.createDataFrame(pa.table(dict(zip(("node", "component"), least_reached(*(ends.column(c).to_numpy() for c in "ab")), strict=True))), "node long, component long"))


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges between ``a`` and ``b``, and the least that each of them reaches."""
    nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, two = codes[: len(a)], codes[len(a) :]
    least = np.arange(len(nodes))
    while (least[one] != least[two]).any():
        low = np.minimum(least[one], least[two])
        np.minimum.at(least, least[one], low)
        np.minimum.at(least, least[two], low)
        while (least[least] != least).any():
            least = least[least]
    return nodes, nodes[least]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]

import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintsieve.llm import common, graph, jaccard, linking
from glintsieve.llm.graph import components


def plain_set(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return frozenset()
    if len(parts) < words:
        return frozenset([tuple(parts)])
    return frozenset(tuple(parts[i : i + words]) for i in range(len(parts) - words + 1))


def brute(rows, words, num, den):
    """(doc_id, n_shingles) to component, for rows of (doc_id, text) with distinct ids."""
    sets = [(d, plain_set(t, words)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if x and y and den * common >= num * (len(x) + len(y) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: (len(x), find(d)) for d, x in sets}


def near_copies(draw, families, copies, size):
    out = []
    for _ in range(families):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(3, size))]
        for _ in range(draw.randint(1, copies)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                at = draw.randrange(len(words))
                words[at] = f"x{draw.randint(0, 9)}"
            if draw.random() < 0.2:
                words = words[: -draw.randint(1, 3)] or words
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_linked_sets_share_a_key(words, num, den, share):
    """Whatever is called frequent: none, some or all of a set's shingles."""
    draw = np.random.default_rng(words)
    for _ in range(150):
        size = int(draw.integers(1, 300))
        one = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
        frequent = np.sort(one[draw.random(len(one)) < share])
        two = one
        while True:
            changed = two.copy()
            at = int(draw.integers(0, len(two)))
            kind = draw.random()
            if kind < 0.4:
                changed[at] = draw.integers(0, 2**64, dtype=np.uint64)
            elif kind < 0.7:
                changed = np.delete(changed, at)
            else:
                changed = np.append(changed, draw.integers(0, 2**64, dtype=np.uint64))
            changed = np.unique(changed)
            common = len(np.intersect1d(one, changed))
            if not len(changed) or den * common < num * (len(one) + len(changed) - common):
                break
            two = changed
            assert np.intersect1d(jaccard.routing_keys(one, num, den, frequent), jaccard.routing_keys(two, num, den, frequent)).size


@pytest.mark.parametrize("seed", range(6))
def test_trees_find_every_component(seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr(jaccard, "MATRIX_ENTRIES", draw.choice([0, 10**9]))
    texts = [t for t in near_copies(draw, 6, 30, 60) if t.strip()]
    rows = list(enumerate(texts))
    sets = [jaccard.shingle_set(t, 3) for t in texts]
    want = brute(rows, 3, 80, 100)
    firsts = jaccard.tree_links(sets, [0] * len(sets), 80, 100)
    assert [want[i][1] for i in range(len(texts))] == firsts
    # In two blocks: links inside each and across give the same components.
    sides = [draw.randint(0, 1) for _ in sets]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for side in ({0}, {1}, {0, 1}):
        members = [i for i, s in enumerate(sides) if s in side]
        if members:
            found = jaccard.tree_links([sets[i] for i in members], [sides[i] for i in members], 80, 100)
            for i, f in zip(members, found, strict=True):
                low, high = sorted((find(i), find(members[f])))
                label[high] = low
    assert [find(i) for i in range(len(sets))] == firsts


@pytest.mark.parametrize(("words", "num", "block"), [(3, 90, 128), (3, 90, 4), (5, 80, 6)])
def test_documents(spark, words, num, block, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", block)
    draw = random.Random(words * block)
    texts = near_copies(draw, 25, 12, 120) + [None, "", " \n\t", "One", "one", "one two", "ONE  TWO", "one two three", "e f g h", *["hot copy of many words here"] * 60]
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, h1 int, family string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words, num, 100).collect()}
    assert got == brute(rows, words, num, 100)


def test_broadcast_or_not(spark, monkeypatch):
    draw = random.Random(8)
    rows = list(enumerate(near_copies(draw, 10, 8, 80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linking, "BROADCAST_ROWS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_repeated_rows_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (9, "a b c d"), (None, "a b c d"), (None, "x y z"), (7, "")], "doc_id long, text string")
    got = sorted(jaccard.jaccard_components(docs).collect(), key=str)
    assert [tuple(r) for r in got if r.doc_id == 4] == [(4, 2, 4)] * 2
    assert {tuple(r) for r in got} == {(4, 2, 4), (9, 2, 4), (None, 2, 4), (None, 1, None), (7, 0, 7)}
    assert jaccard.jaccard_components(docs.where("false")).collect() == []


def test_rows_that_share_an_id_are_linked(spark):
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "x y z w"), (9, "x y z w"), (9, "p q r s"), (11, "p q r s"), (12, "k l m n"), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs).collect())
    assert got == sorted([(3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 2, 3), (9, 2, 3), (11, 2, 3), (12, 2, 12), (12, 0, 12)])


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_one_row_of_each_group_stays(spark, broadcast, monkeypatch):
    monkeypatch.setattr(linking, "BROADCAST_ROWS", broadcast)
    rows = [(3, "a b c d e f", "1"), (5, "a b c d e f", "2"), (5, "x y z w v", "3"), (5, "x Y z w v", "4"), (5, None, "5"), (None, "a b c d e f", "6"), (None, "q r s t u", "7"), (None, "q r s t u", "8"), (None, "", "9"), (7, "a b c d e f", "10"), (7, " ", "11"), (8, "", "12"), (8, "", "13")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string").withColumn("set", F.create_map(F.lit(1), F.lit(2)))
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns
    got = sorted(r.h1 for r in kept.collect())
    assert set(got) - {"7", "8"} == {"1", "4", "5", "9", "11", "12", "13"} and len(set(got) & {"7", "8"}) == 1 and len(got) == 8


def test_large_families_lose_no_link(spark, monkeypatch):
    """Families of many blocks, of one component and of several that share a routing key."""
    monkeypatch.setattr(linking, "BLOCK", 3)
    draw = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.choice([1, 2, 3, 9])):
            words[draw.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:k] + [f"y{j}"] * 3) for j, k in enumerate((100, 104, 108, 112))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (80,):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, num, 100).collect()}
        assert got == brute(rows, 3, num, 100)


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3), (3, None)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            label[high] = low
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert dict(got) == {x: find(x) for x in label} and len(got) == len(label)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_files_and_few_texts(spark):
    """A written frame's shuffles leave no files, its own can be deleted, and only rows that are asked for go on."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.rsplit("/", 1)[-1] for f in manager.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before = shuffled()
    written = common.cut(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and written.count() == 1000
    path = written._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.exists(path)
    common.drop_cut(written)
    assert not os.path.exists(path)
    ids = spark.createDataFrame([(3,), (5,), (-7,)], "id long")
    asked = spark.createDataFrame([(3,), (4,), (-7,), (9,)], "id long")
    assert sorted(r.id for r in asked.where(linking.among(ids, F.col("id"))).collect()) == [-7, 3]
    assert asked.where(linking.among(ids.where("false"), F.col("id"))).collect() == []


def test_no_job_outlives_the_query_that_is_cut(spark):
    """One side of a join is empty, and known to be so while the other one still reads a shuffle."""

    def slowly(seconds, rows):
        def wait(batches):
            for batch in batches:
                time.sleep(seconds)
                yield batch.head(rows)

        return wait

    many, few = common.cut(spark.range(300).coalesce(1)), common.cut(spark.range(30).coalesce(1))
    none = many.mapInPandas(slowly(2, 0), "id long")
    some = few.groupBy("id").agg(F.count(F.lit(1)).alias("n")).mapInPandas(slowly(6, 30), "id long, n long")
    before = spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None)
    assert common.cut(none.join(some, "id")).count() == 0
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert common.cut(many.join(few, "id", "left_semi").where("id >= 10")).count() == 20
    assert spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None) == before


def test_an_empty_side_of_a_merge_join_leaves_no_job(spark):
    """Both sides are stages of their own; the empty one ends while the only row of the other is still in the making."""

    def nothing(batches):
        for _ in batches:
            yield from ()

    def slowly(batches):
        for batch in batches:
            time.sleep(8)
            yield batch

    none = common.cut(spark.range(0, 300, 1, 2)).mapInPandas(nothing, "id long")
    some = common.cut(spark.range(0, 1, 1, 2)).mapInPandas(slowly, "id long")
    assert common.cut(none.join(some.hint("merge"), "id")).count() == 0
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_components_at_the_driver_and_in_rounds(spark, monkeypatch):
    """Both ways give the same; few edges take no rounds of stages."""
    draw = random.Random(9)
    rows = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(150, 250)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)] + [(-5, -7), (None, 3), (8000, 8000)]
    edges = spark.createDataFrame(rows, "a long, b long")
    states = []
    monkeypatch.setattr(graph, "_state", lambda now, f=graph._state: states.append(1) or f(now))
    few = sorted(map(tuple, components(edges).collect()))
    assert len(states) == 1 and components(edges.where("false")).collect() == []
    monkeypatch.setattr(graph, "DRIVER_EDGES", -1)
    assert sorted(map(tuple, components(edges).collect())) == few and len(states) > 3
    assert (60, 0) in few and (249, 150) in few and (-5, -7) in few


@pytest.mark.parametrize("most", [200_000, -1])
def test_strangers_of_a_large_family_meet_by_keys(spark, most, monkeypatch):
    """Each text shares a passage with the next one, so all are one family; its sets are not copied for every two blocks, and no link is lost."""
    monkeypatch.setattr(linking, "BLOCK", 3)
    monkeypatch.setattr(graph, "DRIVER_EDGES", most)
    copies = []
    places, blocks = linking._unlike_places, linking._unlike_blocks

    def few(*args):
        out = places(*args)
        copies.append(int((out["parts"] - out["after"] + out["first"]).sum()))
        return out

    def many(*args):
        out = blocks(*args)
        copies.append(out.count())
        return out

    monkeypatch.setattr(linking, "_unlike_places", few)
    monkeypatch.setattr(linking, "_unlike_blocks", many)
    texts = [" ".join(f"w{i * 4 + j}" for j in range(60)) for i in range(90)]
    texts += [t + " more" for t in texts[::9]]  # links
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert 0 < sum(copies) * 2 < len(texts) * len(texts) // 3, copies


def test_few_classes_are_linked_in_few_jobs(spark, monkeypatch):
    """Large families take the same links by few stages as by many: in blocks, in rounds and between unlike blocks."""
    monkeypatch.setattr(linking, "BLOCK", 3)
    draw = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(80):
        words = list(base)
        for _ in range(draw.choice([1, 2, 3, 8, 12])):
            words[draw.randrange(90)] = f"x{i}"
        texts.append(" ".join(words))
    texts += near_copies(draw, 10, 10, 60)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    jobs = {}
    for most in (graph.DRIVER_EDGES, -1):
        monkeypatch.setattr(graph, "DRIVER_EDGES", most)
        spark.sparkContext.setJobGroup(f"links {most}", "")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 80, 100).collect()}
        jobs[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"links {most}"))
        assert got == brute(rows, 3, 80, 100)
    assert 2 * jobs[200_000] < jobs[-1]

"""Language-model scores of documents: smoothed word frequencies and causal self-attention.

Word counts cover the whole training part.  Tasks count words before the shuffle.  The
most frequent words, a fixed number, go to every worker; all other words of a document
are joined to the counts, so neither the driver nor a worker holds a corpus' vocabulary.
The attention model's class and id frequencies, and how classes follow ids, are those of
all training documents.  Its attention weights begin on a sample at the driver; then
every task trains them on all of its training documents, and their mean is taken.
Each text is split into subword ids once; they are written to the shared folder and read
from there for the transitions, for training and for the scores.
"""

from __future__ import annotations

import copy
import math
import os
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import Adam, AttentionModel
from .common import LOWER, UPPER, cut, document_remainder, new_folder, remove_folder
from .subwords import WordCache, word_cache

#: Words whose counts every worker has.
FREQUENT_WORDS = 200_000
#: Documents, about, on which the weights begin, and the subword ids of them at most; all others follow in the tasks.
SAMPLE_DOCUMENTS, SAMPLE_IDS = 800, 400_000
#: The tasks' rate of training, and the subword ids that they lay out together for it.
RATE, TRAINED_TOGETHER = 0.005, 50_000
#: Windows of a step of training.
TRAINED_WINDOWS = 256
#: Parts of the weights that are averaged apart.
WEIGHT_PARTS = 64
SMOOTHING = 0.1
HELD_OUT = 10
#: Texts that are scored together, in subword ids.
TOGETHER = 200_000

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) of all texts of ``docs``; a document's end is the empty word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                held[b""] += 1
                if len(held) >= 500_000:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of all words from some count on, as many as there can be up to ``most``."""
    # Counts by steps of a sixteenth of their logarithm: a few hundred steps, whatever the corpus.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r["s"], r["words"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, held = None, 0
    for s, words in steps:
        held += words
        if held > most:
            break
        least = s
    if least is None:
        return {}
    rows = counts.where(step >= least).select("word", "n").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def id_counts(counts: DataFrame, vocabulary: str, size: int, end_id: int) -> np.ndarray:
    """How often each subword id occurs in the counted words; each document's end is ``end_id``."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        cache = word_cache(vocabulary)
        for batch in batches:
            parts = [cache[w] if w else end_id.to_bytes(4, "little") for w in batch.column(0).to_pylist()]
            ids = np.frombuffer(b"".join(parts), "<u4")
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(p) // 4 for p in parts]))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=schema)

    out = np.zeros(size, np.int64)
    for row in counts.select("word", "n").mapInArrow(spread, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def encoded(docs: DataFrame, usable: Column, vocabulary: str) -> tuple[DataFrame, str]:
    """(doc_id, text, usable, ids) of each row of ``docs`` (doc_id, text), written to a shared folder, which is given too.

    ``ids`` are the text's subword ids and an end, two bytes each if all of the vocabulary fits, else four.
    """
    end_id, kind = _end_and_kind(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("usable", pa.bool_()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary)
        for batch in batches:
            ids = [text_ids(text.as_py(), cache, end_id).astype(kind).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], schema=schema)

    folder = new_folder(docs.sparkSession, "encoded")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(usable, F.lit(False)).alias("usable"))
    rows.mapInArrow(encode, "doc_id long, text string, usable boolean, ids binary").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema("doc_id long, text string, usable boolean, ids binary").parquet(folder), folder


def _end_and_kind(vocabulary: str) -> tuple[int, str]:
    tokenizer = word_cache(vocabulary).tokenizer
    return tokenizer.token_to_id("<|endoftext|>"), "<u2" if tokenizer.get_vocab_size() <= 2**16 else "<u4"


def _batched(batches: Iterator[pa.RecordBatch], kind: str, together: int) -> Iterator[list[np.ndarray]]:
    """The ids of all texts, so many texts at once that they have ``together`` ids."""
    texts, held = [], 0
    for batch in batches:
        for ids in batch.column(0):
            texts.append(np.frombuffer(ids.as_py(), kind).astype(np.int64))
            held += len(texts[-1])
            if held >= together:
                yield texts
                texts, held = [], 0
    if texts:
        yield texts


def transition_counts(texts: DataFrame, model: AttentionModel, kind: str) -> np.ndarray:
    """How often each class follows each input in all ``texts`` (ids)."""
    shape = model.weights["direct"].shape
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(shape, np.int64)
        for held in _batched(batches, kind, TOGETHER):
            total += own.transitions(held)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total.reshape(-1)[some], pa.int64())], schema=schema)

    rows = texts.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape, np.int64)
    out.reshape(-1)[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def train_in_tasks(texts: DataFrame, model: AttentionModel, kind: str) -> None:
    """Sets the attention weights to the mean, by trained ids, of what each task makes of them with all of its ``texts`` (ids)."""
    names = [k for k in model.weights if k != "direct"]
    schema = pa.schema([("part", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("numbers", pa.binary())])
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        own = copy.copy(shared.value)
        own.weights = {k: w.copy() for k, w in own.weights.items()}
        adam, draw, n = Adam(own, direct=False), np.random.default_rng(9), 0
        for held in _batched(batches, kind, TRAINED_TOGETHER):
            inputs, targets, _ = own.lay_out(held)
            order = draw.permutation(len(inputs))
            for i in range(0, len(order), TRAINED_WINDOWS):
                at = order[i : i + TRAINED_WINDOWS]
                adam.step(inputs[at], targets[at], RATE / math.sqrt(1 + adam.steps / 50))
            n += sum(map(len, held))
        if n:
            parts = np.array_split(np.concatenate([own.weights[k].reshape(-1) for k in names]), WEIGHT_PARTS)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(WEIGHT_PARTS), pa.int32()), pa.array([task] * WEIGHT_PARTS, pa.int32()), pa.array([n] * WEIGHT_PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        numbers = sum(n * np.frombuffer(x, np.float32).astype(np.float64) for n, x in zip(rows["n"], rows["numbers"], strict=True)) / rows["n"].sum()
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "numbers": [numbers.astype(np.float32).tobytes()]})

    made = texts.mapInArrow(train, "part int, task int, n long, numbers binary").groupBy("part").applyInPandas(mean, "part int, numbers binary").collect()
    if made:
        flat, at = np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in sorted(made, key=lambda r: r["part"])]), 0
        for k in names:
            w = model.weights[k]
            model.weights[k] = flat[at : at + w.size].reshape(w.shape).copy()
            at += w.size


def learn(docs: DataFrame, counts: DataFrame, vocabulary: str, sample: int = SAMPLE_DOCUMENTS, epochs: int = 2) -> AttentionModel:
    """The attention model: frequencies from ``counts``, transitions and weights from all training ``docs``.

    About ``sample`` documents only give the tasks one common beginning.  The means depend
    on how the rows are dealt to tasks, as sums of rounded numbers do, but more.
    """
    rows, folder = encoded(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), F.lit(True), vocabulary)
    model = learn_encoded(rows, counts, vocabulary, sample, epochs)
    remove_folder(docs.sparkSession, folder)
    return model


def learn_encoded(rows: DataFrame, counts: DataFrame, vocabulary: str, sample: int = SAMPLE_DOCUMENTS, epochs: int = 2) -> AttentionModel:
    """``learn`` from the usable rows of what ``encoded`` gives."""
    words = word_cache(vocabulary)
    end_id, kind = _end_and_kind(vocabulary)
    model = AttentionModel(id_counts(counts, vocabulary, words.tokenizer.get_vocab_size(), end_id))
    model.end_id = end_id
    docs = rows.where("usable")
    everything, whole = docs.select("ids"), docs.select("text")
    table = transition_counts(everything, model, kind)
    if not table.any():
        return model
    model.start_from(table)
    share = min(1.0, sample / max(1, docs.count()))
    chosen = whole.where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    texts, held = [], 0
    for row in chosen.distinct().orderBy(F.xxhash64("text")).limit(2 * sample).toLocalIterator():
        texts.append(text_ids(row["text"], word_cache(vocabulary), end_id))
        held += len(texts[-1])
        if held >= SAMPLE_IDS:
            break
    if texts:
        model.train(texts, epochs, direct=False)
    train_in_tasks(everything, model, kind)
    return model


def text_ids(text: str | None, cache: WordCache, end_id: int) -> np.ndarray:
    ids = np.frombuffer(b"".join(map(cache.__getitem__, words_of(text))), "<u4")
    return np.append(ids, end_id).astype(np.int64)


def score_documents(docs: DataFrame, usable: Column, vocabulary: str, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    Learnt from the rows where ``usable`` is true.  Tokens are words and one end.
    ``base_score`` is the log10 probability of the tokens by counts with ``SMOOTHING``
    added, ``score`` that of the subword ids and the end by the attention model.  Null
    and empty texts are the end alone.  Without training rows all counts are 0 and
    every id is as likely as the class sizes make it.  Repeated rows are scored each;
    other columns are ignored.
    """
    spark = docs.sparkSession
    training = docs.where(usable)
    counts = cut(word_counts(training))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = int(total["n"]), int(total["v"])
    known = frequent_words(counts, frequent)
    everything = len(known) == distinct
    known.pop(b"", None)
    ends = counts.where("word = X''").first()
    end_count = int(ends["n"]) if ends else 0
    floor = np.log10(train_tokens + SMOOTHING * (distinct + 1))
    rows, folder = encoded(docs, usable, vocabulary)
    _, kind = _end_and_kind(vocabulary)
    shared = spark.sparkContext.broadcast((known, learn_encoded(rows, counts, vocabulary)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("total", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        frequent_counts, model = shared.value
        end = np.log10(end_count + SMOOTHING)
        for batch in batches:
            sizes, knowns, totals, rares, scores = [], [], [], [], []
            held: list[np.ndarray] = []
            held_ids = 0
            for text, ids in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                n = np.fromiter(map(frequent_counts.get, words, repeat(0)), np.int64, len(words))
                seen = n > 0
                rare = [words[i] for i in np.flatnonzero(~seen).tolist()]
                sizes.append(len(words) + 1)
                knowns.append(int(seen.sum()) + (end_count > 0))
                totals.append(float(np.log10(n[seen] + SMOOTHING).sum() + end + (len(rare) * np.log10(SMOOTHING) if everything else 0)))
                rares.append([] if everything else rare)
                held.append(np.frombuffer(ids.as_py(), kind).astype(np.int64))
                held_ids += len(held[-1])
                if held_ids >= TOGETHER:
                    scores.append(model.scores(held))
                    held, held_ids = [], 0
            if held:
                scores.append(model.scores(held))
            if sizes:
                columns = [batch.column(0), sizes, knowns, totals, np.concatenate(scores), rares]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = "doc_id long, n_tokens long, n_known long, total double, score double, rare array<binary>"
    scored = cut(rows.select("doc_id", "text", "ids").mapInArrow(score, kinds).withColumn("row", F.monotonically_increasing_id()))
    remove_folder(spark, folder)
    if not everything:
        asked = scored.select("row", F.explode("rare").alias("word"))
        found = asked.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("more"), F.count("n").alias("also"))
        scored = scored.drop("rare").join(found, "row", "left").withColumns({"total": F.col("total") + F.coalesce("more", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("also", F.lit(0))})
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("total") - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"), "score")


def trained_on() -> Column:
    return F.coalesce(document_remainder(HELD_OUT) != 0, F.lit(False))

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintsieve.llm import common, scoring
from glintsieve.llm.attention import STRIDE, AttentionModel
from glintsieve.llm.common import VOCABULARY
from glintsieve.llm.subwords import word_cache


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base(rows):
    train = Counter()
    for d, text in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    return {(d, text): (len(tokens(text)), sum(train[t] > 0 for t in tokens(text)), n, sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))) for d, text in rows}


@pytest.mark.parametrize("frequent", [3, 10**6])
def test_base_scores(spark, frequent):
    texts = ["The cat sat on THE mat", "", None, " \n", "dog dog dog cat", "only here once é", "ÀÉ x y", "the end", "cat " * 300]
    rows = [(i, texts[i % len(texts)] if i < 30 else f"the {i} cat w{i}") for i in range(60)] + [(None, "the null id")]
    docs = spark.createDataFrame([(d, t, 1.0, 2) for d, t in rows + rows[:2]], "doc_id long, text string, n double, row int")
    got = scoring.score_documents(docs, scoring.trained_on(), VOCABULARY, frequent).collect()
    want = base(rows + rows[:2])
    assert len(got) == len(rows) + 2 and {r.train_tokens for r in got} == {x[2] for x in want.values()}
    for r in got:
        options = [x for (d, t), x in want.items() if d == r.doc_id and x[0] == r.n_tokens]
        assert any(x[1] == r.n_known and abs(x[3] - r.base_score) < 1e-9 * max(1, abs(x[3])) for x in options)
        assert math.isfinite(r.score) and r.score < 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = scoring.score_documents(docs, scoring.trained_on() & (docs["doc_id"] < 0), VOCABULARY).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0), (1, 0, 0)}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert scoring.score_documents(docs.where("false"), scoring.trained_on(), VOCABULARY).collect() == []


def random_texts(draw, count, size, longest=90):
    return [draw.integers(0, size, int(draw.integers(1, longest))) for _ in range(count)]


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(1)
    size = 300
    model = AttentionModel(draw.integers(0, 50, size))
    for w in model.weights.values():
        w += draw.standard_normal(w.shape).astype(np.float32) * 0.3
    for length in (0, 1, STRIDE - 1, STRIDE, STRIDE + 1, 40):
        start = draw.integers(0, size, length)
        whole = model.scores([np.append(start, i) for i in range(size)])
        before = model.scores([start])[0] if length else 0.0
        assert abs(np.sum(10 ** (whole - before)) - 1) < 1e-3


def test_each_target_once_and_no_look_ahead():
    draw = np.random.default_rng(2)
    model = AttentionModel(draw.integers(0, 50, 200))
    for w in model.weights.values():
        w += draw.standard_normal(w.shape).astype(np.float32) * 0.3
    text = draw.integers(0, 200, 77)
    inputs, targets, _ = model.lay_out([text])
    assert targets[targets >= 0].tolist() == text.tolist()
    steps = np.diff([0.0, *(model.scores([text[:n]])[0] for n in range(1, 78))])
    changed = text.copy()
    changed[50:] = (changed[50:] + 1) % 200
    again = np.diff([0.0, *(model.scores([changed[:n]])[0] for n in range(1, 51))])
    assert np.allclose(steps[:50], again, atol=1e-4)
    together = model.scores([text, changed, text[:5]])
    assert abs(together[0] - steps.sum()) < 1e-2 and abs(together[2] - steps[:5].sum()) < 1e-3


def test_gradients():
    draw = np.random.default_rng(3)
    model = AttentionModel(draw.integers(1, 50, 120))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    inputs, targets, _ = model.lay_out(random_texts(draw, 3, 120, 40))
    _, grads = model.gradients(inputs, targets)
    for name, g in grads.items():
        flat = model.weights[name].reshape(-1)
        at = int(np.abs(g).argmax())
        kept = flat[at]
        flat[at] = kept + 1e-4
        up, _ = model.gradients(inputs, targets)
        flat[at] = kept - 1e-4
        down, _ = model.gradients(inputs, targets)
        flat[at] = kept
        assert abs((up - down) / 2e-4 - g.reshape(-1)[at]) < 1e-3 * max(1, abs(g.reshape(-1)[at])), name


def test_gradients_without_maxima_are_the_same():
    """Where no exponential can overflow; a loss and a position without a target as well."""
    draw = np.random.default_rng(6)
    model = AttentionModel(draw.integers(1, 50, 120))
    for w in model.weights.values():
        w += draw.standard_normal(w.shape).astype(np.float32) * 0.3
    inputs, targets, _ = model.lay_out(random_texts(draw, 30, 120))
    assert (targets < 0).any() and model.fits() and model.fits() == model.fits(float(np.abs(model.weights["direct"]).max()))
    loss, grads = model.gradients(inputs, targets)
    other, again = model.gradients(inputs, targets, fits=True)
    assert abs(loss - other) < 1e-5 and grads.keys() == again.keys() == model.weights.keys()
    assert all(np.allclose(grads[k], again[k], rtol=1e-3, atol=1e-6) for k in grads)
    assert not model.fits(100.0) and AttentionModel(np.ones(5)).fits(0.0)


def test_training_beats_counts():
    draw = np.random.default_rng(4)
    # Each id mostly follows the one two places before it: only attention can tell.
    texts = []
    for _ in range(60):
        t = draw.integers(0, 8, 60)
        for i in range(2, 60):
            if draw.random() < 0.9:
                t[i] = t[i - 2]
        texts.append(t)
    model = AttentionModel(np.bincount(np.concatenate(texts), minlength=8))
    losses = model.train(texts[:50], epochs=30, rate=0.05, together=16)
    assert losses[-1] < losses[0] - 0.2


def test_all_training_texts_give_transitions_and_weights(spark):
    rows = [(f"a{i % 7} b{i % 5} " * (1 + i % 40),) for i in range(60)] + [("cat dog " * 3000,), (None,), ("",)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    counts = scoring.word_counts(docs)
    model = scoring.learn(docs, counts, VOCABULARY, sample=1)
    texts = [scoring.text_ids(r[0], word_cache(VOCABULARY), model.end_id) for r in rows]
    again = AttentionModel(scoring.id_counts(counts, VOCABULARY, len(model.class_of), model.end_id))
    again.start_from(again.transitions(texts))
    assert again.transitions(texts).sum() == sum(map(len, texts))
    assert np.allclose(model.weights["direct"], again.weights["direct"], atol=1e-5)
    assert (model.weights["value"] != again.weights["value"]).any(axis=1)[np.unique(again.lay_out(texts)[0])].all()
    assert model.scores(texts).sum() > again.scores(texts).sum()


def test_texts_are_split_into_ids_once(spark):
    """What is learnt follows the written ids, not the texts again; all rows are written, odd ones too."""
    texts = ["The cat sat on THE mat", "", None, " \n", "ÀÉ x-y z...", "cat " * 300] + [f"the {i} cat w{i}" for i in range(20)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, i % 3 > 0) for i, t in enumerate(texts)], "doc_id long, text string, own boolean")
    rows, folder = scoring.encoded(docs, docs["own"], VOCABULARY)
    cache = word_cache(VOCABULARY)
    end_id = cache.tokenizer.token_to_id("<|endoftext|>")
    got = rows.collect()
    assert len(got) == len(texts) and sum(r.usable for r in got) == sum(i % 3 > 0 for i in range(len(texts)))
    assert all(np.array_equal(np.frombuffer(r.ids, "<u2"), scoring.text_ids(r.text, cache, end_id)) for r in got)
    counts = scoring.word_counts(docs.where("own"))
    model = scoring.learn_encoded(rows, counts, VOCABULARY)
    again = scoring.learn_encoded(rows.withColumn("text", F.lit(None).cast("string")), counts, VOCABULARY)
    assert np.array_equal(model.weights["direct"], again.weights["direct"]) and (again.weights["direct"][0] != again.weights["direct"][1]).any()
    common.remove_folder(spark, folder)

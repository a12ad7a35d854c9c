import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from glintsieve.llm import packing
from glintsieve.llm.common import VOCABULARY
from glintsieve.llm.subwords import WordCache

ODD_TEXTS = [
    "", " \n\t ", "Plain words, and more.", "It's we'll DON'T 'S x's", "naïve Ñandú ÅNGSTRÖM straße ÇA", "e\u0301 cafe\u0301 \u0301x", "汉字 漢字かな 한국어",
    "<|endoftext|> and <|startoftext|>x", "a\u00a0b\u2003c\u0085d", "12,345.67 &amp;&&& !!!", "İstanbul ǅ ﬁ ß ẞ Σίσυφος ΣΑΣ", "x\x00y \x1f z\x7f", "😀👍🏽 emoji", "a" * 300, "ªº²½ µ",
    "foo_bar-baz/qux.quux@example.com", "word\u0327, ÿ! Ÿ?", "ñ\u0303 ó\u0301.", "À…Ö× ÷ø",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_cached_words_give_the_tokenizers_ids(tokenizer):
    cache = WordCache(VOCABULARY, limit=50)
    draw = random.Random(1)
    letters = "abcXYZéÑßöÜç0129.,;:!?'\"-_/()<>|@#&\u0301\u00a0\u200b\u3000漢½"
    texts = ODD_TEXTS + ["".join(draw.choice(letters + "   \n") for _ in range(200)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(cache.packed(text), "<u4").tolist() == ids_of(tokenizer, text), text
    assert cache.packed(None) == b""


def test_a_word_is_split_once_in_any_case(tokenizer):
    cache = WordCache(VOCABULARY)
    asked = []
    split = cache.tokenize
    cache.tokenize = lambda run: asked.append(run) or split(run)
    text = "Word word WORD wOrd, word, (word) Éa éa éa."
    assert np.frombuffer(cache.packed(text), "<u4").tolist() == ids_of(tokenizer, text)
    assert sorted(asked) == sorted(set(asked)) and "word" in asked and b"Word" not in cache
    for text in ("J\u030c j\u030c J H\u0331 h\u0331", "T\u0308t\u0308 W\u030a Y\u030a", "K\u0301 \u212a Å"):  # some compose in one case only
        assert np.frombuffer(cache.packed(text), "<u4").tolist() == ids_of(tokenizer, text)


def naive_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= length]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 7, 16, 100, 2048])
    lengths = [draw.randint(1, capacity) if draw.random() < 0.6 else max(1, capacity // draw.randint(2, 9)) for _ in range(draw.randint(0, 400))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan, made = packing.best_fit_decreasing(counts, capacity)
    filled = {}
    placed = dict.fromkeys(counts, 0)
    for run in sorted(plan, key=lambda r: -r.length):
        assert run.rank == placed[run.length]
        placed[run.length] += run.bins * run.per_bin
        for b in range(run.first_bin, run.first_bin + run.bins):
            assert filled.get(b, 0) == run.offset
            filled[b] = run.offset + run.per_bin * run.length
    assert placed == counts
    assert sorted(capacity - x for x in filled.values()) == naive_best_fit(lengths, capacity)
    assert made == len(filled)


def test_tree_finds_the_tightest():
    draw = random.Random(3)
    for capacity in (1, 2, 5, 64, 2048):
        tree, open_ = packing.OpenBins(capacity), set()
        for _ in range(200):
            at = draw.randint(1, capacity)
            (open_.discard if at in open_ else open_.add)(at)
            tree.set(at, at in open_)
            ask = draw.randint(1, capacity)
            assert tree.tightest(ask) == min((x for x in open_ if x >= ask), default=None)


def test_too_long_a_piece_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({9: 1}, 8)


def check_packed(rows, texts, tokenizer, capacity):
    """Every piece of every text once, in gapless sequences."""
    want = {}
    for doc_id, text in texts:
        ids = [*ids_of(tokenizer, text), packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            key = (doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) == len(naive_best_fit([r.length for r in rows], capacity))


def test_documents_of_all_kinds_are_packed(spark, tokenizer):
    texts = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100, None), (None, "no id"), (7, "again"), (7, "again"), (8, "word " * 500), *((200 + i, "the same copy") for i in range(60))]
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in texts], "doc_id long, text string, piece string, length int")
    rows = packing.pack_documents(docs, VOCABULARY, 64).collect()
    check_packed(rows, texts, tokenizer, 64)


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_sequences_hold_the_ids(spark, tokenizer):
    """Of repeated rows and null ids too."""
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five " * 30), (3, None), (3, None), (1, "one two three"), (1, "one two three"), (None, "six"), (None, "six")], "doc_id long, text string")
    placed = packing.pack(packing.tokenised_pieces(docs, VOCABULARY, 32, with_ids=True), 32)
    made = packing.sequences(placed).collect()
    assert all(len(r.ids) == 4 * r.length <= 128 for r in made)
    every = sorted(x for r in made for x in np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert every == sorted(x for r in docs.collect() for x in [*ids_of(tokenizer, r.text), 0])


def test_columns_may_have_any_names(spark):
    pieces = spark.createDataFrame([(i % 3, 1 + i % 5, i, "a", 7) for i in range(40)], "_row long, length long, _chunk long, _own string, offset int")
    rows = packing.pack(pieces, 8).collect()
    assert sorted((r._row, r.length, r._chunk) for r in rows) == sorted((i % 3, 1 + i % 5, i) for i in range(40))
    assert max(r.offset + r.length for r in rows) <= 8


@pytest.mark.parametrize("seed", range(4))
def test_packing_in_a_task_is_best_fit(seed):
    draw = random.Random(seed)
    pieces = [(i, 0, 0, bytes([i % 256]) * 4 * draw.randint(1, 16)) for i in range(draw.randint(0, 150))]
    made = packing.packed_together(pieces, 16)
    assert sorted(16 - s.length for s in made) == sorted(naive_best_fit([len(p[-1]) // 4 for p in pieces], 16))
    got = []
    for s in made:
        at = 0
        for doc_id, piece, start, length, offset in s.pieces:
            assert offset == at
            at += length
            got.append((doc_id, piece, start, s.ids[4 * offset : 4 * at]))
        assert at == s.length <= 16
    assert sorted(got) == sorted(pieces)


def test_whole_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizer, 2048)

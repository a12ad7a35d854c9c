import hashlib
import random

import pytest

from glintsieve.llm import fingerprints as fp
from glintsieve.llm import linking


def prose(draw, n):
    out = ""
    while len(out) < n:
        out += "".join(draw.choice("etaoinshrdlucmfw") for _ in range(draw.randint(1, 9))) + " "
    return out[:n]


def test_equal_texts_and_batches_do_not_matter():
    draw = random.Random(1)
    texts = [prose(draw, n) for n in (0, 1, 3, 63, 64, 65, 500, 2047, 2048, 2049, 5000, 30000)]
    together = fp.fingerprints(texts + texts[::-1])
    assert together[: len(texts)] == together[len(texts) :][::-1]
    assert [fp.fingerprints([t])[0] for t in texts] == together[: len(texts)]


@pytest.mark.parametrize("n", [200, 1000, 2048, 3000, 20000, 100000])
def test_likeness_follows_edits(n):
    draw = random.Random(n)
    one, other = prose(draw, n), prose(draw, n)
    edited = one[: n - n // 4] + other[: n // 4]
    few = list(one)
    for _ in range(max(1, n // 100)):
        at = draw.randrange(len(few))
        if draw.random() < 0.5:
            del few[at]
        else:
            few.insert(at, draw.choice("xyz"))
    a, b, c, d = fp.fingerprints([one, edited, other, "".join(few)])
    assert fp.likeness(a, a) == 1
    assert 0.6 < fp.likeness(a, b) < 0.9
    assert fp.likeness(a, c) < 0.2
    assert fp.likeness(a, d) > 0.5
    assert fp.likeness(a, b) == fp.likeness(b, a)


def test_all_of_a_long_text_counts():
    draw = random.Random(9)
    text = prose(draw, 50000)
    changed = text[:49000] + prose(draw, 1000)
    a, b = fp.fingerprints([text, changed])
    assert a != b and fp.likeness(a, b) > 0.9


def plain(rows):
    """What the order, lengths and edited texts must be; rows of (doc_id, text)."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        out[doc_id] = (len(text), text, text[: len(text) - cut] + following[:cut], following)
    return out


def test_next_documents(spark):
    draw = random.Random(3)
    rows = [(i * 7 % 401, prose(draw, draw.choice([0, 1, 5, 50, 400, 3000]))) for i in range(401)]
    rows += [(1000, None), (1001, "ünï😀 " * 30), (-5, "x" * 9), (None, "nobody"), (2000, prose(draw, 150000))]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, key string, bucket int").repartition(5)
    want = plain(rows)
    got = fp.next_and_edited(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, text, edited, following = want[r.doc_id]
        assert r.n_chars == n
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = fp.fingerprints([text, edited, following])
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        assert r.near_edited == fp.likeness(a, b) and r.near_next == fp.likeness(a, c)


def test_one_row_none_and_repeated(spark):
    one = fp.next_and_edited(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert fp.next_and_edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = fp.next_and_edited(spark.createDataFrame([(5, "abcdefgh")] * 40, "doc_id long, text string")).collect()
    assert len(rows) == 40 and len(set(rows)) == 1


def brute_classes(texts, least):
    """The least number of a text that links reach, and how many pairs are linked; every two texts are compared."""
    made, label = fp.fingerprints([t or "" for t in texts]), list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and texts[j] and fp.likeness(made[i], made[j]) >= least]
    for i, j in pairs:
        one, two = sorted((label[i], label[j]))
        label = [one if x == two else x for x in label]
    return label, pairs


def changed(draw, text, times):
    out = list(text)
    for _ in range(times):
        at = draw.randrange(len(out))
        out[at : at + 1] = draw.choice(["", "q", out[at] + "z"])
    return "".join(out)


@pytest.mark.parametrize(("least", "block", "broadcast"), [(0.8, 128, 10**6), (0.8, 4, 0), (0.7, 3, 10**6)])
def test_near_classes(spark, monkeypatch, least, block, broadcast):
    """Families of many near texts in small blocks, copies, strangers between them, texts just beyond a scale's end, and odd rows."""
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "BROADCAST_ROWS", broadcast)
    draw = random.Random(6)
    texts = [prose(draw, draw.choice([30, 66, 130, 700, 1030, 2060, 4100, 9000])) for _ in range(60)]
    texts += [changed(draw, t, draw.choice([1, 1, 2, 5])) for t in texts[:30] for _ in range(2)]
    texts += [changed(draw, texts[3], 2) for _ in range(40)]
    texts += texts[:5] * 3 + ["", None, "", "x", "x"]
    want, pairs = brute_classes(texts, least)
    rows = list(enumerate(texts)) + [(None, texts[0])]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, h1 int, near_class string").repartition(4)
    got = {r.doc_id: r for r in fp.edited_and_near(docs, least).collect()}
    assert len(got) == len(rows) and got[None].near_class == got[0].near_class
    assert all((got[i].near_class is None) == (not t) for i, t in enumerate(texts))
    # No class joins what links don't, and nearly every link is in a class.
    for i, t in enumerate(texts):
        assert all(want[i] == want[j] for j in range(i) if t and texts[j] and got[i].near_class == got[j].near_class)
        assert not t or got[i].near_class <= fp.print_digest(got[i].fingerprint)[0]
    joined = sum(got[i].near_class == got[j].near_class for i, j in pairs)
    assert len(pairs) > 400 and joined >= 0.97 * len(pairs)


def test_band_meetings_follow_likeness():
    """Of pairs at the threshold, nearly all meet in a band; of strangers, whatever their lengths, few do."""
    draw, by = random.Random(8), fp.Prints(0.8)
    near = met = strangers = chance = 0
    for _ in range(250):
        text = prose(draw, draw.choice([66, 130, 300, 1030, 2060, 5000]))
        one, two, other = by.forms([text, changed(draw, text, max(1, len(text) // 150)), prose(draw, len(text) + draw.randrange(-3, 4))])
        keys = set(by.keys(one).tolist())
        if 0.8 <= fp.likeness(one.tobytes().decode(), two.tobytes().decode()) < 0.9:
            near += 1
            met += bool(keys & set(by.keys(two).tolist()))
        strangers += 1
        chance += bool(keys & set(by.keys(other).tolist()))
    assert near >= 20 and met >= 0.97 * near
    assert chance <= 0.02 * strangers


def test_no_near_classes(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.near_classes(none).collect() == [] and fp.edited_and_near(none).collect() == []
    few = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id long, text string")
    assert fp.near_classes(few).collect() == []

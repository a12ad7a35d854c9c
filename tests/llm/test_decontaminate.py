import hashlib
import random
import re

from glintsieve.llm.decontaminate import SuffixAutomaton, automata, decontaminate, remove_spans, spans_of, words_of

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    words = plain_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        own = plain_words(item)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if own else ():
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_words():
    for text in ["Ab-c_D é\u00a0x 1.5 \x7f\x80 ÀB İ", "", None, "…", "a\ud7ffb"]:
        assert [w.decode() for w in words_of(text)] == plain_words(text)


def test_random_texts_over_few_words():
    draw = random.Random(2)
    for trial in range(60):
        alphabet = "abcd"[: draw.randint(1, 4)]
        window = draw.randint(1, 5)
        some = lambda n: " ".join(draw.choice(alphabet + "z" * (trial % 2)) for _ in range(n))
        items = [(i % 6, some(draw.randint(0, 12))) for i in range(draw.randint(0, 8))]
        automaton = SuffixAutomaton([(str(i), words_of(t)) for i, t in items], window)
        for _ in range(10):
            text = some(draw.randint(0, 30))
            hit, found = automaton.hits(words_of(text))
            want = brute(text, items, window)
            assert (int(hit.sum()), len(found)) == want[1:3], (items, text, window)


def test_longest_matches():
    automaton = SuffixAutomaton([("1", [b"a", b"b", b"c"]), ("2", [b"b", b"c", b"d"])], 2)
    codes = [automaton.vocabulary[w] for w in [b"a", b"b", b"c", b"d", b"b"]]
    assert [n for _, n in automaton.stream(codes)] == [1, 2, 3, 3, 1]


def test_documents(spark):
    draw = random.Random(5)
    word = lambda: draw.choice(["the", "of", "Ünder", "x1", "and", "to"]) + draw.choice(["", "a", "b", "c"])
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(draw.randint(14, 40))) for i in range(12)] + [(50, "Only Four short words"), (51, "Single"), (52, ""), (53, None), (None, "no id but words here"), (3, prose(20))]
    texts = [None, "", "...", "single", "SINGLE!" + " pad" * 30, prose(300), *(f"{prose(n)} {items[k][1]} {prose(n)}" for n, k in ((0, 0), (3, 1), (400, 2), (200, 12), (900, 4))), items[0][1][:40], prose(20) * 2]
    docs = spark.createDataFrame([(i, t, "own", 0) for i, t in enumerate(texts + texts[:3])] + [(None, items[1][1], None, None)], "doc_id long, text string, spans string, n_hit int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    real = [(i, t) for i, t in items if i is not None]
    rows = decontaminate(docs, benchmark).collect()
    assert len(rows) == docs.count()
    for r in rows:
        c = r.contamination
        assert (c.n_words, c.n_hit, c.n_items, c.items_sha256, c.contaminated) == brute(r.text, real)
        assert sum(s.end - s.first for s in c.spans) == c.n_hit
        assert (r.spans, r.n_hit) in (("own", 0), (None, None))


def test_several_automata_and_none(spark):
    benchmark = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(20)], "item_id long, text string")
    assert len(automata(benchmark, 13, limit=30)) == 6  # texts of 8 to 11 characters
    docs = spark.createDataFrame([(1, "w1 w2 w3 x w19 w20 w21")], "doc_id long, text string")
    row = decontaminate(docs, benchmark).first().contamination
    assert (row.n_hit, row.n_items) == (6, 2)
    row = decontaminate(docs, benchmark.where("false")).first().contamination
    assert (row.n_words, row.n_hit, row.contaminated) == (7, 0, False)
    assert decontaminate(docs.where("false"), benchmark).collect() == []


def test_spans_are_removed():
    text = "Keep this. HIT me, hard! And keep, that."
    assert remove_spans(text, [(2, 5)]) == "Keep this. ! And keep, that."
    assert remove_spans(text, []) == text
    assert remove_spans(None, []) is None
    automaton = SuffixAutomaton([("1", words_of("hit me hard"))], 13)
    hit, _ = automaton.hits(words_of(text))
    assert spans_of(hit) == [(2, 5)]

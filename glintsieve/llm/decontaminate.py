"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are one automaton over word numbers.  Training words are
streamed through it, tracking the longest suffix that occurs in some item; where it
reaches the window length, the words of the match are hit.  Words that occur in no item
lead to the root from any state, so only runs of known words are streamed at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Words of one window.
WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
COVERAGE = 20
#: Bytes of item texts in one automaton.  More items make more automata, each broadcast by itself.
AUTOMATON_BYTES = 1_000_000

# A-Z become a-z; other ASCII characters but digits and letters become spaces; the rest stays.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, a-z and characters beyond ASCII in the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of items (id, words), with their windows marked.

    ``marks[s]`` maps a window's length to the ids of the items with that window, for
    windows among the strings of state ``s``.  Items without words are left out.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        number = self.vocabulary
        coded = [(i, [number.setdefault(w, len(number)) for w in words]) for i, words in items if words]
        for _, codes in coded:
            state = 0
            for c in codes:
                state = self._extend(state, c)
        self.marks: dict[int, dict[int, set[str]]] = {}
        for i, codes in coded:
            size = min(window, len(codes))
            state = 0
            for at, c in enumerate(codes):
                state = self._suffix(self.next[state][c], size)
                if at >= size - 1:
                    self.marks.setdefault(state, {}).setdefault(size, set()).add(i)
        self.shortest = min((min(m) for m in self.marks.values()), default=0)
        #: The nearest state with marks, itself or along its suffix links.
        self.marked = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, code: int) -> int:
        """The state of ``state``'s longest string and ``code``, cut off from longer ones."""
        target = self.next[state][code]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(code) == target:
            self.next[state][code] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self._split(last, code)
        new = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and code not in self.next[last]:
            self.next[last][code] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, code)
        return new

    def _suffix(self, state: int, size: int) -> int:
        """The state that holds the suffix of ``size`` words of a state's strings."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the state and length of the longest match that ends there."""
        follow, link, length = self.next, self.link, self.length
        state = matched = 0
        for c in codes:
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state].get(c, 0)
            matched = matched + 1 if state else 0
            yield state, matched

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which of ``words`` lie in some occurrence of a window, and the ids of the items with one."""
        hit = np.zeros(len(words), bool)
        found: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return hit, found
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long_enough = ends - starts >= self.shortest
        for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            for at, (state, matched) in enumerate(self.stream(codes[start:end].tolist()), start + 1):
                if matched < self.shortest:
                    continue
                state = self.marked[state]
                while state:
                    for size, ids in self.marks[state].items():
                        if size <= matched:
                            hit[at - size : at] = True
                            found |= ids
                    state = self.marked[self.link[state]]
        return hit, found


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def automata(benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> list[SuffixAutomaton]:
    """Automata of the items, each of about ``limit`` bytes of texts at most (one item at least).

    Rows of the benchmark come to the driver one at a time.  Items with a null id or
    text, or without words, have no windows.
    """
    out: list[SuffixAutomaton] = []
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        held.append((row.i, words_of(row.t)))
        size += len(row.t)
        if size >= limit:
            out.append(SuffixAutomaton(held, window))
            held, size = [], 0
    if held:
        out.append(SuffixAutomaton(held, window))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, text_col: str = "text", out_col: str = "contamination", remove: bool = False) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, n_hit, n_items, items_sha256, contaminated, spans, and cleaned if ``remove``.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole.
    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` the items
    with one, and ``spans`` are the runs of hit words, as word numbers from 0, end
    exclusive.  ``contaminated``: some word is hit, and ``coverage`` * n_hit >= n_words.
    ``cleaned`` is the text without its spans, as it was if there are none.

    Null and empty texts have no words and are not contaminated.  All columns of
    ``docs`` stay (one named like ``out_col`` is replaced); repeated rows are judged
    alike.  Items with the same id count as one.  An empty benchmark hits nothing.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(a) for a in automata(benchmark, window)]

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:int,end:int>>" + ", cleaned string" * remove)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()  # what tasks before this one have left in the worker
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text)
                hit, found = np.zeros(len(words), bool), set()
                for one in shared:
                    more, ids = one.value.hits(words)
                    hit |= more
                    found |= ids
                n_hit = int(hit.sum())
                names = ",".join(sorted(found))
                spans = spans_of(hit) if n_hit else []
                row = (len(words), n_hit, len(found), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and coverage * n_hit >= len(words), [{"first": a, "end": b} for a, b in spans])
                rows.append((*row, remove_spans(text, spans) if spans else text) if remove else row)
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"] + ["cleaned"] * remove)
            del rows, batch
        give_back()

    # Called nondeterministic, it runs once even where a filter on its result comes before other uses of it; else a task
    # would run it twice, in two Python workers.
    return docs.withColumn(out_col, judge.asNondeterministic()(F.col(text_col).cast("string")))


def remove_spans(text: str | None, spans: Iterable[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans`` (word numbers) and what stands between them."""
    if not text:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    clean = raw.translate(_WORDS)
    places, at = [], 0
    for word in clean.split():
        at = clean.index(word, at)
        places.append((at, at := at + len(word)))
    keep, at = [], 0
    for first, end in spans:
        keep.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")



"""Language identification by words first, then by shorter and shorter character n-grams.

A known word adds its log frequency in each language.  An unseen word is scored by its
character n-grams: the longest length of which any n-gram is known counts, one length
less for each step back, at a fixed cost a step.  The language with the largest sum wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

UNDETERMINED = "und"
#: Distinct labelled texts of each language from which the model is learnt.
SAMPLE_PER_LANGUAGE = 600
#: Words of each language in the model, the most frequent ones.
WORDS_PER_LANGUAGE = 50_000
#: The part of labelled texts that may have a lower share of known words than the one that is taken as usual.
REACHED = 0.01
LONGEST, STEP_BACK = 4, math.log(0.4)
#: Added to each count.
SMOOTHING = 0.1
#: Unseen words that a worker remembers.
CACHED_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    # Every word has the marks of its ends, so alone they tell nothing.
    bound = word if n == 1 else f"^{word}$"
    return [bound[i : i + n] for i in range(len(bound) - n + 1)]


class Table:
    """Log frequencies in each language of the words, or n-grams, of one kind."""

    def __init__(self, counts: list[Counter[str]]):
        self.at = {key: i for i, key in enumerate(dict.fromkeys(k for c in counts for k in c))}
        table = np.zeros((len(self.at), len(counts)))
        for language, c in enumerate(counts):
            for key, n in c.items():
                table[self.at[key], language] = n
        self.present = (table > 0).astype(np.float64)
        self.logs = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * max(1, len(self.at))))


class LanguageModel:
    """Per-language log frequencies of words and of character n-grams."""

    def __init__(self, counts: dict[str, dict[str, int]], least_known: dict[str, float] | None = None):
        """``counts``: language to word to count.  ``least_known``: the share of known words that texts of a language exceed."""
        self.least_known = least_known or {}
        self.languages = sorted(counts)
        self.words = Table([Counter(counts[language]) for language in self.languages])
        self.grams = []
        for n in range(1, LONGEST + 1):
            # Each distinct word once: the n-grams are for words that were not seen.
            self.grams.append(Table([Counter(g for word in counts[language] for g in grams_of(word, n)) for language in self.languages]))
        self.cache: dict[str, int] = {}
        self.rows = np.empty((1024, 2 * len(self.languages)))

    def score_word(self, word: str) -> np.ndarray:
        known = self.words.at.get(word)
        if known is not None:
            return self.words.logs[known]
        for n in range(LONGEST, 0, -1):
            table = self.grams[n - 1]
            found = [at for g in grams_of(word, n) if (at := table.at.get(g)) is not None]
            if found:
                return (LONGEST + 1 - n) * STEP_BACK + table.logs[found].sum(axis=0)
        return np.zeros(len(self.languages))

    def knows(self, word: str) -> np.ndarray:
        """1 for each language that has the word, else 0."""
        at = self.words.at.get(word)
        return np.zeros(len(self.languages)) if at is None else self.words.present[at]

    def forget(self) -> None:
        """Drops the remembered words."""
        self.cache.clear()
        self.rows = np.empty((1024, 2 * len(self.languages)))

    def _remember(self, word: str) -> int:
        at = self.cache[word] = len(self.cache)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        self.rows[at] = np.concatenate((self.score_word(word), self.knows(word)))
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share, 0 to 1; ``und`` and 0 without letters or languages."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """As ``predict``, and whether the text fits: more of its words are known than the language's least share."""
        counts = Counter(words_of(text)) if text else {}
        if not self.languages or not any(map(str.isalpha, "".join(counts))):
            return UNDETERMINED, 0.0, False
        if len(self.cache) + len(counts) > CACHED_WORDS:
            self.cache.clear()
        cache = self.cache
        at = [cache[w] if w in cache else self._remember(w) for w in counts]
        times = np.fromiter(counts.values(), np.float64, len(counts))
        sums = times @ self.rows[at]
        total, known = np.split(sums, 2)
        # The winner's share grows with the text's evidence, as the square root of its words: words aren't independent.
        share = np.exp((total - total.max()) / math.sqrt(times.sum()))
        best = int(total.argmax())
        lang = self.languages[best]
        return lang, float(1 / share.sum()), bool(known[best] > self.least_known.get(lang, 0.0) * times.sum())


def _by_language(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for lang, n in values.items() for x in (lang, F.lit(n).cast("long"))])[F.col("lang")]


def learn(docs: DataFrame, usable: Column, per_language: int = SAMPLE_PER_LANGUAGE, words: int = WORDS_PER_LANGUAGE) -> LanguageModel:
    """A model from the text and lang of the rows where ``usable``: ``per_language`` distinct texts of each language, or all if fewer.

    The texts with the least hashes are taken, so the sample is the same on every run
    whatever copies there are, and it is what bounds the words that come to the driver.
    """
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("hash"))
    hashes = labelled.select("lang", "hash").distinct()
    sizes = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel({})
    # About twice as many as needed, of which the least are taken.
    near = _by_language({lang: min(2**63 - 1, int(2**64 * min(1.0, (2 * per_language + 100) / n)) - 2**63) for lang, n in sizes.items()})
    least: dict[str, list[int]] = {}
    for row in hashes.where(F.col("hash") <= near).collect():
        least.setdefault(row["lang"], []).append(row["hash"])
    last = _by_language({lang: sorted(found)[:per_language][-1] for lang, found in least.items()})
    sampled = labelled.where(F.col("hash") <= last).select("lang", "text").distinct()
    split = sampled.select("lang", F.xxhash64("text").alias("hash"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word != ''")
    each = split.groupBy("lang", "hash", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("lang", "word").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("texts"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    found = totals.select("lang", "word", "total").toArrow()  # in one job; a local iterator runs one for each partition
    for lang, word, total in zip(*(c.to_pylist() for c in found.columns), strict=True):
        counts[lang][word] = total
    # The share of each text's words that other texts of its language have: half of what nearly all texts reach is the least.
    known = each.join(totals, ["lang", "word"]).groupBy("lang", "hash").agg((F.sum(F.when(F.col("texts") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("known"))
    reached = known.groupBy("lang").agg(F.percentile_approx("known", REACHED, 10_000).alias("known")).collect()
    return LanguageModel({lang: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:words]) for lang, c in counts.items() if c}, {r["lang"]: r["known"] / 2 for r in reached})


def identify(docs: DataFrame, model: LanguageModel, out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col`` of lang_pred, score (0 to 1) and fits.

    A null, empty or letterless text is ``und`` with 0; so is any text if nothing was
    learnt.  Of languages with equal sums the first by name wins.  Whole texts are
    scored.  All columns of ``docs`` stay, but for one named like ``out_col``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, fits boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()  # what tasks before this one have left in the worker
        own = shared.value
        try:
            for batch in texts:
                yield pd.DataFrame([own.judge(t) for t in batch], columns=["lang_pred", "score", "fits"])
        finally:
            own.forget()
            give_back()

    return docs.withColumn(out_col, predict(F.col("text").cast("string")))

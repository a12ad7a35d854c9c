"""Secret scanning: fixed patterns, and a character convolutional network over all other candidates.

Candidates are runs of token characters that are long enough and mix kinds.  Each is
judged with its surroundings by a network in numpy: symbols are embedded, convolved and
pooled over the run, pass a hidden layer and become a probability.  It is trained on
labelled findings, which are what the patterns find in a sample of documents (and
candidates they don't) and made-up ones from a fixed seed, and it marks a candidate
from the largest threshold on that keeps the demanded recall on findings held out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "net")
#: Documents, about, from which labelled findings are taken.
SAMPLE_DOCUMENTS = 4000
#: Labelled findings of a sample and made-up ones, of each label at most.
SAMPLE_FINDINGS, MADE_UP = 1500, 600
#: Recall that the threshold keeps on held-out findings.
RECALL = 0.98
#: Characters of context on each side, and of one window over a candidate.
CONTEXT, WINDOW = 20, 40

# Fixed values of the query's contract.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12

# Maximal runs that can hold an access key or a hex run, both at least 16 long.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


class Span(NamedTuple):
    start: int
    kind: str
    end: int


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """What the patterns find, by start and then kind; places are code points, ends exclusive.

    Access keys and hex runs lie inside runs of token characters, and a shorter match of
    either never hides a longer one, so only such runs are searched for them.
    """
    out = []
    folded = text.lower()
    if any(k in folded for k in _KEYWORDS):
        out += [Span(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    for start, end in _runs(text) if runs is None else runs:
        out += [Span(m.start(), "access", m.end()) for m in _ACCESS.finditer(text, start, end)]
        out += [Span(m.start(), "hex", m.end()) for m in _HEX.finditer(text, start, end)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def candidates(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Runs of token characters with both letters and digits, without dots at the end."""
    out = []
    for start, end in _runs(text) if runs is None else runs:
        run = text[start:end].rstrip(".")
        if _DIGIT.search(run) and _LETTER.search(run):
            out.append((start, start + len(run)))
    return out


def _symbols() -> np.ndarray:
    """Symbols of code points: 1 to 95 printable ASCII, 96 a letter beyond, 97 a line break; 0 no character."""
    table = np.full(256, 96, np.uint8)
    table[32:127] = np.arange(1, 96)
    table[[9, 10, 13]] = 97
    return table


_SYMBOLS = _symbols()
N_SYMBOLS = 98


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a candidate and its context, a row for each ``WINDOW`` characters of the whole candidate."""
    points = np.frombuffer(text[max(0, start - CONTEXT) : end + CONTEXT + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _SYMBOLS[np.minimum(points, 255)]
    padded = np.zeros(CONTEXT + len(symbols) + 2 * WINDOW + 2 * CONTEXT, np.uint8)
    lead = CONTEXT - min(start, CONTEXT)
    padded[lead : lead + len(symbols)] = symbols
    rows = range(0, end - start, WINDOW)
    out = np.stack([padded[r : r + WINDOW + 2 * CONTEXT] for r in rows])
    # A short candidate's right context comes just after it; what is further away is left out.
    out[-1, min(WINDOW, end - start - rows[-1]) + 2 * CONTEXT :] = 0
    return out


class CharacterNetwork:
    """Embedding, convolution, pooling, a hidden layer and a logistic output, in numpy."""

    EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        shape = {"embed": (N_SYMBOLS, self.EMBED), "conv": (self.WIDTH * self.EMBED, self.FILTERS), "hidden": (2 * self.FILTERS, self.HIDDEN), "out": (self.HIDDEN, 1)}
        self.weights = {k: (draw.standard_normal(s) / math.sqrt(s[0] if k != "embed" else 2)).astype(np.float32) for k, s in shape.items()}
        self.weights |= {"conv_b": np.zeros(self.FILTERS, np.float32), "hidden_b": np.zeros(self.HIDDEN, np.float32), "out_b": np.zeros(1, np.float32)}
        self.threshold = 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        w = self.weights
        embedded = w["embed"][x] * (x > 0)[..., None]
        frames = np.lib.stride_tricks.sliding_window_view(embedded, self.WIDTH, axis=1)  # sample, place, embedding, width
        frames = np.ascontiguousarray(frames.transpose(0, 1, 3, 2)).reshape(len(x), -1, self.WIDTH * self.EMBED)
        raw = np.maximum(frames @ w["conv"] + w["conv_b"], 0)
        inside = raw[:, CONTEXT - 2 : CONTEXT + WINDOW - 2]  # frames around the candidate's characters
        pooled = np.concatenate((raw.max(axis=1), inside.mean(axis=1)), axis=1)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden_b"], 0)
        logit = (hidden @ w["out"] + w["out_b"])[:, 0]
        return frames, raw, pooled, hidden, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.empty(0, np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        frames, raw, pooled, hidden, p = self._forward(x)
        d_logit = ((p - y) * weight / len(x)).astype(np.float32)[:, None]
        d_hidden = (d_logit @ w["out"].T) * (hidden > 0)
        d_pooled = d_hidden @ w["hidden"].T
        d_raw = np.zeros_like(raw)
        top = raw.argmax(axis=1)
        rows, cols = np.indices(top.shape)
        d_raw[rows, top, cols] = d_pooled[:, : self.FILTERS]
        d_raw[:, CONTEXT - 2 : CONTEXT + WINDOW - 2] += d_pooled[:, None, self.FILTERS :] / WINDOW
        d_raw *= raw > 0
        flat = d_raw.reshape(-1, self.FILTERS)
        d_frames = (flat @ w["conv"].T).reshape(len(x), -1, self.WIDTH, self.EMBED)
        d_embed = np.zeros_like(w["embed"])
        places = d_frames.shape[1]
        for k in range(self.WIDTH):
            np.add.at(d_embed, x[:, k : k + places], d_frames[:, :, k])
        return {"embed": d_embed, "conv": frames.reshape(-1, frames.shape[-1]).T @ flat, "conv_b": flat.sum(0), "hidden": pooled.T @ d_hidden, "hidden_b": d_hidden.sum(0), "out": hidden.T @ d_logit, "out_b": d_logit.sum(0)}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.005, seed: int = 11) -> None:
        """Adam on the logistic loss; both labels weigh the same in all."""
        draw = np.random.default_rng(seed)
        share = float(np.clip(y.mean(), 0.02, 0.98))
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for i in range(0, len(x), 64):
                at = order[i : i + 64]
                step += 1
                for k, g in self._gradients(x[at], y[at], weight[at]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """The largest threshold that keeps the recall on these findings; without secrets among them, a half."""
        found = np.sort(self.probabilities(x[y > 0]))
        allowed = int(math.floor((1 - recall) * len(found)))
        self.threshold = float(found[allowed]) if len(found) else 0.5

    def secret(self, text: str, places: list[tuple[int, int]]) -> list[bool]:
        """Whether each candidate is one: the most secret of its windows counts."""
        if not places:
            return []
        parts = [windows(text, a, b) for a, b in places]
        p = self.probabilities(np.concatenate(parts))
        first = np.cumsum([0, *map(len, parts[:-1])])
        return (np.maximum.reduceat(p, first) >= self.threshold).tolist()


def made_up_findings(count: int = MADE_UP, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label) from a fixed seed: secrets of many shapes, and what is none."""
    draw = np.random.default_rng(seed)
    pick = lambda alphabet, n: "".join(draw.choice(list(alphabet), n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(lower, int(draw.integers(2, 9)))
    size = lambda a, b: int(draw.integers(a, b))
    secret = [
        lambda: pick("0123456789abcdef", size(24, 65)),
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: pick(lower + upper + digits, size(24, 48)),
        lambda: pick(lower + upper + digits + "+/", size(30, 60)) + "==",
        lambda: pick(lower, 2) + "_" + word() + "_" + pick(lower + upper + digits, size(24, 40)),
    ]
    before = ["token = \"", "secret: ", "key ", "password=", "", "api_key='", "auth "]
    plain = [
        lambda: f"{word()}.{pick(digits, 2)}@mail.example.com".replace("@", "."),
        lambda: f"{word()}-{word()}-{pick(digits, 4)}-{word()}",
        lambda: f"/{word()}/{word()}/{word()}/{pick(digits, 5)}.html",
        lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}T1{pick(digits, 1)}.{pick(digits, 2)}.00",
        lambda: f"www.{word()}{word()}.example.com/{word()}{pick(digits, 3)}",
        lambda: f"{word()}{word()}{word()}{pick(digits, size(1, 3))}{word()}",
        lambda: "-".join((pick("0123456789abcdef", 8), *(pick("0123456789abcdef", 4) for _ in range(3)), pick("0123456789abcdef", 12))),
    ]
    out = []
    for i in range(count):
        for label, made, lead in ((1, secret, before[i % len(before)]), (0, plain, word() + " ")):
            value = made[i % len(made)]()
            head = f"{word()} {word()} {lead}"
            out.append((f"{head}{value}\" {word()} {word()} {word()}", len(head), len(head) + len(value), label))
    return out


def labelled_findings(text: str) -> list[tuple[str, int, int, int]]:
    """Findings of a text: what the patterns find (1), and the candidates they don't (0)."""
    runs = _runs(text)
    base = base_spans(text, runs)
    out = []
    for start, end in candidates(text, runs):
        label = int(any(s.start < end and start < s.end for s in base))
        low = max(0, start - CONTEXT)
        out.append((text[low : end + CONTEXT + WINDOW], start - low, end - low, label))
    return out


def learn(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> CharacterNetwork:
    """A network trained on the labelled findings of about ``sample`` documents and made-up ones.

    The sample is by a hash of the text; the findings that come to the driver are
    ``SAMPLE_FINDINGS`` of each label at most.  A fifth of them, drawn at random from a
    fixed seed, is held out for the threshold.
    """
    total = max(1, docs.count())
    share = min(1.0, sample / total)

    @F.pandas_udf("array<struct<text:string,start:int,end:int,label:int>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "start": a, "end": b, "label": y} for t, a, b, y in labelled_findings(text or "")] for text in texts])

    sampled = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).distinct()
    found = cut(sampled.select(F.explode(find("text")).alias("f")).select("f.*").distinct())
    rows = []
    for label in (0, 1):
        rows += [tuple(r) for r in found.where(F.col("label") == label).orderBy(F.xxhash64("text", "start"), "text").limit(SAMPLE_FINDINGS).collect()]
    rows += made_up_findings()
    return fit(rows)[0]


def fit(findings: list[tuple[str, int, int, int]], seed: int = 13) -> tuple[CharacterNetwork, np.ndarray, np.ndarray]:
    """A network trained and calibrated on findings, and the windows and labels held out for the threshold."""
    # One window stands for a long finding in training.
    x = np.stack([windows(text, start, end)[0] for text, start, end, _ in findings])
    y = np.array([label for *_, label in findings], np.float32)
    held = np.random.default_rng(seed).random(len(x)) < 0.2
    net = CharacterNetwork()
    net.train(x[~held], y[~held])
    net.calibrate(x[held], y[held])
    return net, x[held], y[held]


def scan_text(text: str | None, net: CharacterNetwork | None) -> list[Span]:
    """All spans of a text: the patterns', and the network's on candidates that no pattern touches."""
    if not text:
        return []
    runs = _runs(text)
    base = base_spans(text, runs)
    if net is None or not runs:
        return base
    rest = [(a, b) for a, b in candidates(text, runs) if not any(s.start < b and a < s.end for s in base)]
    more = [Span(a, "net", b) for (a, b), is_secret in zip(rest, net.secret(text, rest), strict=True) if is_secret]
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind)))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with every character of a span replaced by an asterisk."""
    out, at = [], 0
    for s in spans:
        start = max(at, s.start)
        if s.end > start:
            out.append(text[at:start] + "*" * (s.end - start))
            at = s.end
    return "".join(out) + text[at:]


def scan_documents(docs: DataFrame, net: CharacterNetwork | None, out_col: str = "secrets", redact: bool = False) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_assign, n_access, n_hex, base_sha256, spans, and redacted if asked for.

    ``spans`` lists kind:start:end of all spans by start and then kind; places are code
    points, ends exclusive, and the network's kind is ``net``.  ``base_sha256`` is of the
    same list of the patterns' spans alone.  Null and empty texts have none; a null text
    stays null when redacted.  Whole texts are scanned, repeated rows alike, and all
    columns of ``docs`` stay, but for one named like ``out_col``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * redact)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()  # what tasks before this one have left in the worker
        own = shared.value
        for batch in texts:
            rows = []
            for text in batch:
                spans = scan_text(text, own)
                base = [s for s in spans if s.kind != "net"]
                row = [*(sum(s.kind == k for s in base) for k in KINDS[:3]), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)]
                rows.append([*row, redact_text(text, spans) if text else text] if redact else row)
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["redacted"] * redact)
            del rows, batch
        give_back()

    return docs.withColumn(out_col, scan(F.col("text").cast("string")))

"""A small causal self-attention language model over subword ids, in numpy.

Each of the most frequent input ids has a query, a key, a value and a row of direct
logits.  A position attends to itself and to what came before it in its window, with a
learnt bias for each distance; the sum of values adds to the direct logits of the
classes of the next id, and an id's share of its class comes from counts of the whole
corpus.  Windows of ``WINDOW`` positions overlap by half: each scores its last ``STRIDE``
targets only, so every target is scored once, with at least half a window before it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Input ids with parameters of their own; all others share one.
INPUTS = 2048
#: Classes of output ids: the most frequent ids have one each, the rest share the others.
OWN_CLASSES, SHARED_CLASSES = 96, 32
WIDTH = 16
STRIDE = 16
WINDOW = 2 * STRIDE
#: Windows that are scored together.
TOGETHER = 256
#: Positions whose logits are held at once in training.
IN_CACHE = 1024
#: Numbers up to this have an exponential of which many still add up to a 32-bit float.
LARGEST = 70.0
LN10 = float(np.log(10))


class AttentionModel:
    def __init__(self, counts: np.ndarray, seed: int = 3):
        """``counts``: how often each id occurs in the training texts; ids never seen count a little."""
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        smooth = counts + 0.1
        self.classes = OWN_CLASSES + SHARED_CLASSES
        self.class_of = np.empty(size, np.int64)
        own, rest = order[:OWN_CLASSES], order[OWN_CLASSES:]
        self.class_of[own] = np.arange(len(own))
        # The rest, by falling count, in classes of about the same weight.
        weight = np.cumsum(smooth[rest])
        if len(rest):
            self.class_of[rest] = OWN_CLASSES + np.minimum((weight / weight[-1] * SHARED_CLASSES).astype(np.int64), SHARED_CLASSES - 1)
        total = np.bincount(self.class_of, smooth, self.classes) + 1e-9
        self.log_share = np.log(smooth / total[self.class_of]).astype(np.float32)
        self.input_of = np.full(size, INPUTS, np.int64)
        self.input_of[order[:INPUTS]] = np.arange(min(INPUTS, size))
        #: The input before a text and around it.
        self.start = INPUTS + 1
        draw = np.random.default_rng(seed)
        rows = INPUTS + 2
        self.weights = {name: (draw.standard_normal((rows, WIDTH)) * scale).astype(np.float32) for name, scale in (("query", 0.3), ("key", 0.3), ("value", 0.1))}
        self.weights["direct"] = np.tile(np.log(total / total.sum()).astype(np.float32), (rows, 1))
        self.weights["out"] = (draw.standard_normal((WIDTH, self.classes)) * 0.1).astype(np.float32)
        self.weights["bias"] = np.zeros((STRIDE, WINDOW), np.float32)
        self.mask = np.where(np.arange(WINDOW)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE, 0, -1e9).astype(np.float32)

    def lay_out(self, texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows' inputs, their targets (-1 for none) and the number of the text of each window."""
        counts = np.array([-(-len(t) // STRIDE) for t in texts])
        inputs = np.full(STRIDE * (len(texts) + int(counts.sum())), self.start, np.int64)
        targets = np.full(STRIDE * int(counts.sum()), -1, np.int64)
        at = to = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            inputs[at + STRIDE + 1 : at + STRIDE + len(t)] = self.input_of[t[:-1]]
            targets[to : to + len(t)] = t
            at += STRIDE * (n + 1)
            to += STRIDE * n
        blocks = inputs.reshape(-1, STRIDE)
        text = np.repeat(np.arange(len(texts)), counts)
        second = np.arange(len(text)) + text + 1
        return np.concatenate((blocks[second - 1], blocks[second]), axis=1), targets.reshape(-1, STRIDE), text

    def _attend(self, inputs: np.ndarray, fits: bool = False) -> tuple:
        w = self.weights
        query, key, value = w["query"][inputs[:, STRIDE:]], w["key"][inputs], w["value"][inputs]
        scores = query @ key.transpose(0, 2, 1)
        scores += w["bias"] + self.mask
        if not fits:
            scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= _totals(scores)
        return query, key, value, scores, scores @ value

    def fits(self, direct: float | None = None) -> bool:
        """Whether no score or logit can be so large that its exponential overflows; then none needs its maximum taken off.

        ``direct``: the largest of the direct logits' sizes, if it is known.
        """
        w = self.weights
        longest = [float(np.sqrt((w[name].astype(np.float64) ** 2).sum(axis=1)).max()) for name in ("query", "key")]
        score = longest[0] * longest[1] + float(np.abs(w["bias"]).max())
        # A context is a mean of values, so each of its numbers is at most the largest of them.
        logit = (float(np.abs(w["direct"]).max()) if direct is None else direct) + float((np.abs(w["value"]).max(axis=0) @ np.abs(w["out"])).max())
        return max(score, logit) < LARGEST

    def scores(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """log10 of each text's probability, as a sequence of ids (one at least)."""
        inputs, targets, text = self.lay_out(texts)
        w, fits = self.weights, self.fits()
        near = w["bias"] + self.mask
        ones = np.ones(self.classes, np.float32)
        out = np.zeros(len(texts))
        for i in range(0, len(inputs), TOGETHER):
            part = inputs[i : i + TOGETHER]
            now = part[:, STRIDE:].reshape(-1)
            scores = w["query"].take(now, axis=0).reshape(-1, STRIDE, WIDTH) @ w["key"].take(part, axis=0).transpose(0, 2, 1)
            scores += near
            if not fits:
                scores -= scores.max(axis=2, keepdims=True)
            np.exp(scores, out=scores)
            context = scores @ w["value"].take(part, axis=0)
            context /= _totals(scores)
            logits = context.reshape(-1, WIDTH) @ w["out"]
            logits += w["direct"].take(now, axis=0)
            goal = targets[i : i + TOGETHER].reshape(-1)
            real = goal >= 0
            goal = np.where(real, goal, 0)
            if not fits:
                logits -= logits.max(axis=1, keepdims=True)
            picked = logits[np.arange(len(goal)), self.class_of[goal]]
            top = picked - np.log(np.exp(logits, out=logits) @ ones)
            out += np.bincount(np.repeat(text[i : i + TOGETHER], STRIDE), (top + self.log_share[goal]) * real, len(texts))
        return out / LN10

    def transitions(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """How often each class follows each input in these texts; tables of several texts add up."""
        inputs, targets, _ = self.lay_out(texts)
        now, goal = inputs[:, STRIDE:].reshape(-1), targets.reshape(-1)
        now, goal = now[goal >= 0], self.class_of[goal[goal >= 0]]
        return np.bincount(now * self.classes + goal, minlength=len(self.weights["direct"]) * self.classes).reshape(-1, self.classes)

    def start_from(self, table: np.ndarray, prior: float = 20.0) -> None:
        """Direct logits from how often classes follow inputs."""
        base = np.exp(self.weights["direct"][0].astype(np.float64))
        self.weights["direct"] = np.log((table + prior * base) / (table.sum(axis=1, keepdims=True) + prior)).astype(np.float32)

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, direct: bool = True, fits: bool = False) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss in nats, and its gradients; without ``direct``, those of the other weights.  ``fits``: what the method says."""
        w = self.weights
        query, key, value, share, context = self._attend(inputs, fits)
        now, every = inputs[:, STRIDE:].reshape(-1), inputs.reshape(-1)
        goal = targets.reshape(-1)
        rows = np.flatnonzero(goal >= 0)
        flat = context.reshape(-1, WIDTH)
        real = np.zeros(len(goal), flat.dtype)
        real[rows] = 1 / max(1, len(rows))
        d_flat, d_out = np.empty_like(flat), np.zeros_like(w["out"])
        d_direct = np.zeros((len(now), self.classes), flat.dtype) if direct else None
        total, picked = np.empty_like(real), np.empty_like(real)
        at_class = np.zeros(len(goal), np.int64)
        at_class[rows] = self.class_of[goal[rows]]
        ones = np.ones(self.classes, flat.dtype)
        # So many rows at a time that their logits stay in the processor's cache; the shares are never divided out.
        for i in range(0, len(goal), IN_CACHE):
            part = slice(i, i + IN_CACHE)
            logits = flat[part] @ w["out"]
            logits += w["direct"].take(now[part], axis=0)
            if not fits:
                logits -= logits.max(axis=1, keepdims=True)
            row, own = np.arange(len(logits)), at_class[part]
            picked[part] = logits[row, own]
            np.exp(logits, out=logits)
            total[part] = logits @ ones
            logits[row, own] -= total[part]
            scale = (real[part] / total[part])[:, None]
            d_flat[part] = (logits @ w["out"].T) * scale
            d_out += (flat[part] * scale).T @ logits
            if direct:
                np.multiply(logits, scale, out=d_direct[part])
        loss = float((np.log(total[rows]) - picked[rows]).mean()) if len(rows) else 0.0
        d_context = d_flat.reshape(context.shape)
        d_share = d_context @ value.transpose(0, 2, 1)
        d_share -= np.einsum("bsw,bsw->bs", d_context, context)[:, :, None]
        d_share *= share
        d_value = share.transpose(0, 2, 1) @ d_context
        d_key = d_share.transpose(0, 2, 1) @ query
        both = _scattered(every, np.concatenate((d_key, d_value), axis=2).reshape(len(every), -1), len(w["key"]))
        out = {"out": d_out, "bias": d_share.sum(axis=0), "key": both[:, :WIDTH], "value": both[:, WIDTH:], "query": _scattered(now, (d_share @ key).reshape(len(now), -1), len(w["query"]))}
        if direct:
            out["direct"] = _scattered(now, d_direct, len(w["direct"]))
        return loss, out

    def train(self, texts: Sequence[np.ndarray], epochs: int = 3, rate: float = 0.02, together: int = 256, seed: int = 9, direct: bool = True) -> list[float]:
        """Adam with a falling rate; the mean loss in nats of each epoch.

        Without ``direct`` the direct logits stay as they are; else they start from these
        texts and are trained as well.
        """
        if direct:
            self.start_from(self.transitions(texts))
        inputs, targets, _ = self.lay_out(texts)
        draw = np.random.default_rng(seed)
        adam = Adam(self, direct)
        steps = epochs * -(-len(inputs) // together)
        losses = []
        for _ in range(epochs):
            order, seen = draw.permutation(len(inputs)), []
            for i in range(0, len(order), together):
                at = order[i : i + together]
                seen.append(adam.step(inputs[at], targets[at], rate * (1 - (adam.steps + 1) / (steps + 1))))
            losses.append(float(np.mean(seen)))
        return losses


class Adam:
    """Steps of Adam on a model's weights; without ``direct``, its direct logits stay as they are."""

    def __init__(self, model: AttentionModel, direct: bool):
        self.model, self.direct, self.steps = model, direct, 0
        names = [k for k in model.weights if direct or k != "direct"]
        self.mean = {k: np.zeros_like(model.weights[k]) for k in names}
        self.square = {k: np.zeros_like(model.weights[k]) for k in names}
        self.largest = None if direct else float(np.abs(model.weights["direct"]).max())

    def step(self, inputs: np.ndarray, targets: np.ndarray, rate: float) -> float:
        """The loss before the step."""
        self.steps += 1
        loss, grads = self.model.gradients(inputs, targets, self.direct, self.model.fits(self.largest))
        for k, g in grads.items():
            mean, square = self.mean[k], self.square[k]
            mean += np.float32(0.1) * (g - mean)
            square += np.float32(0.01) * (g * g - square)
            down = np.sqrt(square / np.float32(1 - 0.99**self.steps))
            down += np.float32(1e-6)
            self.model.weights[k] -= mean * np.float32(rate / (1 - 0.9**self.steps)) / down
        return loss


def _totals(scores: np.ndarray) -> np.ndarray:
    """The sums over the last axis, which stays; a product is faster than a sum of short rows."""
    return (scores.reshape(-1, scores.shape[-1]) @ np.ones(scores.shape[-1], scores.dtype)).reshape(*scores.shape[:-1], 1)


def _scattered(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` that belong to each row number."""
    small = at.astype(np.int16) if rows <= 2**15 else at  # short numbers are sorted by radix
    order = np.argsort(small, kind="stable")
    sorted_ = small[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    out = np.zeros((rows, values.shape[1]), values.dtype)
    out[sorted_[first]] = np.add.reduceat(values.take(order, axis=0), first, axis=0)
    return out

"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

KINDS = ("email", "ip", "card", "phone")
# Tag 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
PUNCTUATION = "@._%+-() \n:/#$&*!,;'\"=|[]<>?"
DIGIT, LOWER, UPPER, LETTER, OTHER = range(1, 6)
PAD = 0
CLASSES = 6 + len(PUNCTUATION)


def class_table() -> np.ndarray:
    """Code point → character class, 0 being padding."""
    table = np.full(0x110000, OTHER, np.uint8)
    table[0xAA:0x2000] = LETTER
    table[ord("0") : ord("9") + 1] = DIGIT
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("A") : ord("Z") + 1] = UPPER
    for i, c in enumerate(PUNCTUATION):
        table[ord(c)] = 6 + i
    return table


TABLE = class_table()


def classes_of(text: str) -> np.ndarray:
    return TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Weights: ``x``, ``h`` and ``b`` per direction, output ``o``, ``c``, CRF ``t`` and ``first``."""

    hidden: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        made = {}
        for d in "fb":
            made[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            made[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            made[f"b{d}"] = np.zeros(4 * hidden)
            made[f"b{d}"][hidden : 2 * hidden] = 1.0
        made["o"] = rng.normal(0, 0.3, (2 * hidden, TAGS))
        made["c"] = np.zeros(TAGS)
        made["t"] = np.zeros((TAGS, TAGS))
        made["first"] = np.zeros(TAGS)
        return cls(hidden, {k: v.astype(np.float32) for k, v in made.items()})

    # -- the recurrent layer --------------------------------------------------

    def run(self, codes: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over time-major class codes (time, rows)."""
        n = self.hidden
        steps, rows = codes.shape
        wx, wh = self.weights[f"x{d}"] + self.weights[f"b{d}"], self.weights[f"h{d}"]
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        out, kept = np.empty((steps, rows, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = h @ wh
            z += wx[codes[t]]
            gates = sigmoid(z[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            before, prior = h, c
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                kept.append((t, before, prior, i, f, o, g, squashed))
        return out, kept

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Tag scores (time, rows, tags) of time-major class codes."""
        both = np.concatenate([self.run(codes, "f")[0], self.run(codes, "b")[0]], axis=2)
        return both @ self.weights["o"] + self.weights["c"]

    # -- training -------------------------------------------------------------

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tags under the CRF, and its gradients."""
        w, n = self.weights, self.hidden
        steps, rows = codes.shape
        sides = {d: self.run(codes, d, True) for d in "fb"}
        both = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        scores = both @ w["o"] + w["c"]
        loss, d_scores, d_t, d_first = crf_gradients(scores, tags, w["t"], w["first"])
        grads = {"t": d_t, "first": d_first, "o": both.reshape(-1, 2 * n).T @ d_scores.reshape(-1, TAGS), "c": d_scores.sum((0, 1))}
        d_both = d_scores @ w["o"].T
        for side, d in enumerate("fb"):
            wh = w[f"h{d}"]
            gh, each = np.zeros_like(wh), np.empty((steps, rows, 4 * n), wh.dtype)
            dh_next, dc_next = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
            for t, before, prior, i, f, o, g, squashed in reversed(sides[d][1]):
                dh = d_both[t][:, side * n : (side + 1) * n] + dh_next
                dc = dc_next + dh * o * (1 - squashed * squashed)
                dz = np.concatenate([dc * g * i * (1 - i), dc * prior * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                gh += before.T @ dz
                each[t] = dz
                dh_next, dc_next = dz @ wh.T, dc * f
            each = each.reshape(-1, 4 * n)
            chosen = np.zeros((len(each), CLASSES), wh.dtype)
            chosen[np.arange(len(each)), codes.ravel()] = 1
            grads |= {f"x{d}": chosen.T @ each, f"h{d}": gh, f"b{d}": each.sum(0)}
        return loss, grads

    def fit(self, windows: np.ndarray, tags: np.ndarray, epochs: int, seed: int, batch: int = 16, rate: float = 0.03) -> Tagger:
        """Adam over (rows, time) class codes and tags; the order is fixed by ``seed``."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            speed = rate * (0.5 if epoch >= epochs - 2 else 1.0)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                _, grads = self.gradients(windows[rows].T, tags[rows].T)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g / len(rows), -1, 1).astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    # -- decoding -------------------------------------------------------------

    def best_tags(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi path of (time, tags) or (time, rows, tags) scores."""
        alone = scores.ndim == 2
        if alone:
            scores = scores[:, None]
        t, steps = self.weights["t"], len(scores)
        best = scores[0] + self.weights["first"]
        back = np.empty(scores.shape, np.uint8)
        for s in range(1, steps):
            ways = best[:, :, None] + t
            back[s] = ways.argmax(1)
            best = ways.max(1) + scores[s]
        path = np.empty(scores.shape[:2], np.uint8)
        path[-1] = best.argmax(1)
        rows = np.arange(scores.shape[1])
        for s in range(steps - 1, 0, -1):
            path[s - 1] = back[s, rows, path[s]]
        return path[:, 0] if alone else path


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def crf_gradients(scores: np.ndarray, tags: np.ndarray, t: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss and gradients of scores, transitions and first tags by forward–backward."""
    steps, rows, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0] + first
    for s in range(1, steps):
        alpha[s] = log_sum(alpha[s - 1][:, :, None] + t, 1) + scores[s]
    for s in range(steps - 2, -1, -1):
        beta[s] = log_sum((beta[s + 1] + scores[s + 1])[:, None, :] + t, 2)
    total = log_sum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - total[:, None])
    joint = alpha[:-1, :, :, None] + t + (beta[1:] + scores[1:])[:, :, None, :] - total[:, None, None]
    d_t = np.exp(joint).sum((0, 1))
    at = np.arange(rows)
    gold = first[tags[0]] + scores[np.arange(steps)[:, None], at, tags].sum(0) + t[tags[:-1], tags[1:]].sum(0)
    d_first = d_scores[0].sum(0)
    np.add.at(d_first, tags[0], -1)
    np.add.at(d_t, (tags[:-1], tags[1:]), -1)
    d_scores[np.arange(steps)[:, None], at, tags] -= 1
    return float((total - gold).mean()), d_scores, d_t, d_first

"""A linear-chain conditional random field over word-shape features, trained and decoded in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: Fixed words that are features of their own.
CUES = frozenset("token key api_key apikey secret password passwd pwd pass = : at dot (at) [at] (dot) [dot] call tel phone mobile fax card visa email mail contact version page vol isbn".split())
#: Cells of words that a batch of sequences is decoded in, and words whose scores are remembered.
CELLS, REMEMBERED = 1 << 15, 30_000
HEX = re.compile(r"^[\"'=:]*[0-9a-fA-F]{16,}[\"'.,;]*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def features(word: str) -> list[str]:
    """Word-shape features of one token."""
    shape = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    short = re.sub(r"([Xx])[Xx]*", "x", shape)
    digits = shape.count("d")
    low = word.lower().strip(".,;")
    found = ["bias", "shape=" + re.sub(r"(d)d*", "d", short), "digits=" + str(digits if digits < 5 else 5 if digits < 9 else 9 if digits < 12 else 12 if digits < 20 else 20)]
    if digits and len(shape) < 24:
        found.append("run=" + short)
    if low in CUES:
        found.append("cue=" + low)
    if low.rstrip("=:\"'") in CUES:
        found.append("stem=" + low.rstrip("=:\"'"))
    if 12 <= digits <= 19:
        found.append(f"luhn={luhn(re.sub('[^0-9]', '', word))}")
    if "@" in word:
        found.append("has@")
    if HEX.match(word) and digits:
        found.append("hex")
    if re.search(r"[\[(](at|dot)[\])]", low):
        found.append("spelled")
    if word[-1:] in ",;":
        found.append("stop")
    return found


@dataclass
class Crf:
    """weights[s] maps features to scores of each tag, for the word itself, the one before and the one after."""

    tags: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: list[np.ndarray] = field(default_factory=list, repr=False)

    def _number(self, word: str) -> int:
        at = [self.index[f] for f in features(word) if f in self.index]
        self._scores.append(self.weights[:, at].sum(axis=1))
        self._known[word] = len(self._scores) - 1
        return len(self._scores) - 1

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each tag of each word, from its own features and its neighbours'; remembers words' scores."""
        if len(self._scores) > REMEMBERED:
            self._known.clear()
            self._scores.clear()
        known = self._known
        numbers = [known[w] if w in known else self._number(w) for w in words]
        used, at = np.unique(numbers, return_inverse=True)
        own = np.stack([self._scores[i] for i in used])[at]
        out = own[:, 0].copy()
        out[1:] += own[:-1, 1]
        out[:-1] += own[1:, 2]
        return out

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Numbers in `tags` of the likeliest tags of each sequence, by Viterbi over padded batches of like length."""
        out = [np.zeros(0, np.int8)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if sequences[i]), key=lambda i: -len(sequences[i]))
        while order:
            longest = len(sequences[order[0]])
            some, order = order[: max(1, CELLS // longest)], order[max(1, CELLS // longest) :]
            lengths = np.array([len(sequences[i]) for i in some])
            scores = np.zeros((longest, len(some), len(self.tags)))
            for row, i in enumerate(some):
                scores[: lengths[row], row] = self.emissions(sequences[i])
            best, back = self.start + scores[0], np.zeros(scores.shape, np.int8)
            for t in range(1, longest):
                n = int(np.searchsorted(-lengths, -t))  # sequences longer than t stand first
                paths = best[:n, :, None] + self.transitions
                back[t, :n] = paths.argmax(axis=1)
                best[:n] = paths.max(axis=1) + scores[t, :n]
            tags = np.zeros((longest, len(some)), np.int8)
            now, rows = best.argmax(axis=1), np.arange(len(some))
            for t in range(longest - 1, -1, -1):
                tags[t] = now
                now = np.where(t < lengths, back[t, rows, now], now)
            for row, i in enumerate(some):
                out[i] = tags[: lengths[row], row]
        return out


def train(rows: list[tuple[list[str], list[str]]], steps: int = 100, rate: float = 0.1, decay: float = 0.002) -> Crf:
    """The field of greatest penalised likelihood on labelled rows, by gradient ascent with adaptive steps.

    rows: words and their tags, O for none. Empty rows are left out; without any row the field tags everything O.
    """
    rows = [r for r in rows if r[0]]
    if not rows:
        return Crf(["O"], {}, np.zeros((3, 0, 1)), np.zeros((1, 1)), np.zeros(1))
    tags = ["O", *sorted({t for _, ys in rows for t in ys} - {"O"})]
    index: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in features(w):
                index.setdefault(f, len(index))
    n, longest, k = len(rows), max(len(w) for w, _ in rows), len(tags)
    hot = np.zeros((n, longest, len(index)))
    gold = np.zeros((n, longest, k))
    mask = np.zeros((n, longest))
    for i, (words, ys) in enumerate(rows):
        mask[i, : len(words)] = 1
        for t, (w, y) in enumerate(zip(words, ys, strict=True)):
            hot[i, t, [index[f] for f in features(w)]] = 1
            gold[i, t, tags.index(y)] = 1
    sides = [hot, np.zeros_like(hot), np.zeros_like(hot)]
    sides[1][:, 1:], sides[2][:, :-1] = hot[:, :-1], hot[:, 1:]
    flat = np.concatenate([s.reshape(n * longest, -1) for s in sides], axis=1)
    used = np.flatnonzero(mask.ravel())
    flat = flat[used]
    steps_gold = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    theta = [np.zeros((flat.shape[1], k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        scores = np.zeros((n * longest, k))
        scores[used] = flat @ theta[0]
        scores = scores.reshape(n, longest, k)
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = theta[2] + scores[:, 0]
        for t in range(1, longest):
            x = alpha[:, t - 1, :, None] + theta[1]
            top = x.max(axis=1)
            now = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, now, alpha[:, t - 1])
        top = alpha[:, -1].max(axis=1)
        total = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1))
        expected_steps = np.zeros((k, k))
        for t in range(longest - 1, 0, -1):
            x = theta[1] + (scores[:, t] + beta[:, t])[:, None, :]
            pair = np.exp(alpha[:, t - 1, :, None] + x - total[:, None, None]) * mask[:, t, None, None]
            expected_steps += pair.sum(axis=0)
            top = x.max(axis=2)
            beta[:, t - 1] = np.where(mask[:, t, None] > 0, top + np.log(np.exp(x - top[:, :, None]).sum(axis=2)), 0)
        marginal = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        grads = [flat.T @ (gold - marginal).reshape(-1, k)[used], steps_gold - expected_steps, (gold[:, 0] - marginal[:, 0]).sum(axis=0)]
        for x, g, a, b in zip(theta, grads, m, v, strict=True):
            g = g / n - decay * x
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Crf(tags, index, theta[0].reshape(3, len(index), k), theta[1], theta[2])

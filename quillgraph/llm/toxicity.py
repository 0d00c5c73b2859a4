"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Tokens that look disguised (leetspeak, letters spaced out,
letters repeated) become lattices of what they may stand for, and Viterbi decoding under the model restores them.
A lexicon of the restored words is learned from labelled documents, and a logistic curve over what a text holds of it
gives the score.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, any_names, stage, tidy

#: Symbols of the model: 0 a word's end, 1-26 a-z, 27 any other letter.
SYMBOLS = 28
#: Letters that a leetspeak character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log-probabilities of the channel: writing a letter in leetspeak, putting a mark or a digit between letters, a true
#: word's end, a letter repeated.
SUBSTITUTE, INSERT, DIGIT, BREAK, REPEAT = -1.0, -1.0, -12.0, -4.0, -0.5
#: At most so many labelled documents are learned from, those with the least hashes of their ids.
MOST_LABELLED = 20_000
#: Each unit of the lexicon is in at least so many toxic texts among the labelled ones, which bounds the lexicon.
LEAST_SEEN = 3
#: Smallest certain log-odds of a unit.
LEAST_WEIGHT = 2.5
#: A text's evidence is the sum of its TOP largest weights, each counted up to CAP.
TOP, CAP = 3, 4.0
#: Tokens that a worker remembers, and units that it counts before it hands the counts on.
REMEMBERED, COUNTED = 100_000, 60_000
#: Runs of characters after which a decoder looks for the beginning that all its paths share, which it need not hold.
SHARED = 1024

SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
THRICE = re.compile(r"(.)\1\1", re.DOTALL)
RUN = re.compile(r"(.)\1*", re.DOTALL)
#: Tokens without letters that are left alone: numbers, prices, dates, times, shares.
NUMBER = re.compile(r"[+$€£(|]?[0-9][0-9.,:;/()|-]*[%!$€£+|]*")


@functools.cache
def _symbol_table() -> np.ndarray:
    """The symbol of each code point, upper-case A-Z as lower-case, as _symbol gives it."""
    return np.array([_symbol(chr(i).lower() if i < 128 else chr(i)) for i in range(0x110000)], np.uint8)


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else SYMBOLS - 1 if c.isalpha() else 0


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of symbol trigrams over all texts; what reaches the driver is at most SYMBOLS ** 3 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                data = " ".join(t or "" for t in batch.column(0).slice(at, 256).to_pylist())
                for cut in range(0, len(data), 1 << 20):
                    s = table[np.frombuffer(data[max(0, cut - 2) : cut + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
                    if len(s) > 2:
                        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["trigram", "n"])

    counts = np.zeros(SYMBOLS**3)
    for row in docs.select(text_col).mapInArrow(tidy(run), "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[row.trigram] = row.n
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Restorer:
    """Viterbi decoding of disguised tokens under a trigram model."""

    def __init__(self, counts: np.ndarray) -> None:
        smooth = counts + 0.1
        self.logp = np.log(smooth / smooth.sum(axis=2, keepdims=True)).tolist()

    @staticmethod
    def options(run: str) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with the channel's log-probability."""
        c, n = run[0], len(run)
        if c.isalpha():
            return [(c * n, 0.0)] if n < 3 else [(c, REPEAT), (c * 2, REPEAT)]
        found = [(x * k, SUBSTITUTE * k) for x in LEET.get(c, "") for k in {min(n, 2), 1 if n > 2 else n}]
        return [*found, ("", min(n, 2) * (DIGIT if c.isdigit() else INSERT)), (" ", BREAK)]

    def restore(self, token: str) -> list[str]:
        """The likeliest words behind a token. What all paths begin with is put aside every SHARED runs; it is certain."""
        states: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, ["", None])}
        done: list[str] = []
        for n, match in enumerate(RUN.finditer(token), 1):
            after: dict[tuple[int, int], tuple[float, list]] = {}
            choices = self.options(match[0])
            for (a, b), (score, path) in states.items():
                for text, cost in choices:
                    x, y, total = a, b, score + cost
                    for c in text:
                        s = _symbol(c)
                        total += self.logp[x][y][s]
                        x, y = y, s
                    if (x, y) not in after or after[x, y][0] < total:
                        after[x, y] = (total, [text, path])
            states = after
            if n % SHARED == 0:
                done.append(self.put_aside([path for _, path in states.values()]))
        best = max(states, key=lambda state: states[state][0] + self.logp[state[0]][state[1]][0])
        return "".join(done + self.spelled(states[best][1])).split()

    @classmethod
    def put_aside(cls, paths: list[list]) -> str:
        """What all paths, of as many steps each, begin with; they go on without it. A step is [text, step before]."""
        now = {id(p): p for p in paths}
        while len(now) > 1:
            now = {id(p[1]): p[1] for p in now.values()}
        shared = next(iter(now.values()))
        text = "".join(cls.spelled(shared))
        shared[:] = ["", None]
        return text

    @staticmethod
    def spelled(path: list | None) -> list[str]:
        parts = []
        while path is not None:
            text, path = path
            parts.append(text)
        return parts[::-1]

    def words(self, token: str) -> list[str]:
        """The words of a token in lower case, restored if it looks disguised."""
        core = token.strip(".,;:!?\"'()[]{}<>|*#%&$@~`^=_-+/\\")
        if core.isalpha() and token[0] not in LEET and not THRICE.search(core):
            return [core.lower()]
        low = token.lower()
        if not any(c.isalpha() for c in low) and (NUMBER.fullmatch(low) or sum(c in LEET for c in low) < 3 or all(c.isdigit() or c.isspace() for c in low)):
            return []
        tail = low.rstrip(".,;:?\"'()[]{}<>*#%&~`^=_-/\\")
        return self.restore(tail if len(tail) - len(tail.rstrip("!$@|+")) < 2 else tail.rstrip("!$@|+"))


def units(words: list[str]) -> Iterator[str]:
    """What is weighed of words: each word and its first four and five letters."""
    for word in words:
        if len(word) > 2:
            yield word
        if len(word) > 5:
            yield "^" + word[:4]
            yield "^" + word[:5]


@dataclass
class Model:
    """counts: the character model; weights: the lexicon; bias and slope: the logistic curve over a text's evidence."""

    counts: np.ndarray
    weights: dict[str, float]
    bias: float = 0.0
    slope: float = 1.0


class Scorer:
    """Evidence of texts; remembers the words of tokens and the weights of those that have any."""

    def __init__(self, model: Model) -> None:
        self.model, self.restorer = model, Restorer(model.counts)
        self.seen: set[str] = set()
        self.heavy: dict[str, dict[str, float]] = {}

    def tokens(self, text: str) -> set[str]:
        return {*text.split(), *SPACED.findall(text)}

    def evidence(self, texts: list[str]) -> list[float]:
        split = [self.tokens(t) for t in texts]
        every = set().union(*split)
        if len(self.seen) + len(every) > REMEMBERED:
            self.seen.clear()
            self.heavy.clear()
        for token in every.difference(self.seen):
            weighed = {}
            for word in self.restorer.words(token):
                if w := max((self.model.weights.get(u, 0.0) for u in units([word])), default=0.0):
                    weighed[word] = w
            if weighed:
                self.heavy[token] = weighed
        self.seen |= every
        out = []
        for tokens in split:
            found: dict[str, float] = {}
            for token in tokens.intersection(self.heavy):
                found |= self.heavy[token]
            out.append(sum(sorted((min(w, CAP) for w in found.values()), reverse=True)[:TOP]))
        return out

    def score(self, texts: list[str]) -> list[float]:
        return [1 / (1 + math.exp(-self.model.bias - self.model.slope * x)) for x in self.evidence(texts)]


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(True))


def _unit_counts(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts)
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(found[0].keys() | found[1].keys())
            columns = [pa.array(keys, pa.string()), *(pa.array([found[y][k] for k in keys], pa.int64()) for y in (1, 0))]
            found[0].clear()
            found[1].clear()
            return pa.RecordBatch.from_arrays(columns, ["unit", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                text, have = text.as_py(), set()
                for token in {*text.split(), *SPACED.findall(text)}:
                    have.update(units(restorer.words(token)))
                found[toxic.as_py()].update(have)
                if len(found[0]) + len(found[1]) > COUNTED:
                    yield flush()
        yield flush()

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model: trigram counts of all docs, lexicon and curve of at most MOST_LABELLED labelled texts.

    Equal texts are learned from once, as toxic ones if their labels differ. Labels other than 0 and 1, null ids and null
    texts are left out; rows with one id all take its label. Without labels of both kinds, as of empty tables, every text
    scores 0. Other columns play no part.
    """
    counts = trigram_counts(docs, text_col)
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(id_col, F.col(label_col).cast("int").alias(f"{P}toxic"))
    some = known.orderBy(F.xxhash64(id_col), id_col).limit(MOST_LABELLED)
    texts = docs.join(F.broadcast(some), id_col).where(F.col(text_col).isNotNull()).select(F.col(text_col).alias(f"{P}text"), f"{P}toxic")
    texts = stage(texts.groupBy(F.sha2(f"{P}text", 256).alias("h")).agg(F.first(f"{P}text").alias("text"), F.max(f"{P}toxic").alias("toxic")).select("text", "toxic"), "labelled")
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(counts, {}, -30.0, 0.0)
    found = texts.mapInArrow(tidy(_unit_counts(counts)), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / c) - F.lit(math.log((n[1] + 1) / (n[0] + 1))) - F.sqrt(1 / t + 1 / c)
    found = found.where(F.col("t") >= LEAST_SEEN).select("unit", weight.alias("weight")).where(F.col("weight") > LEAST_WEIGHT)
    weights = {r.unit: r.weight for r in found.collect()}  # bounded by MOST_LABELLED and LEAST_SEEN
    model = Model(counts, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                yield pa.RecordBatch.from_arrays([pa.array(scorer.evidence(batch.column(0).to_pylist()), pa.float64()), batch.column(1)], ["x", "y"])

    rows = texts.mapInArrow(tidy(run), "x double, y int").groupBy(F.round("x", 2).alias("x")).agg(F.sum("y").alias("ones"), F.count("*").alias("all")).orderBy("x").collect()
    model.bias, model.slope = _logistic(np.array([r.x for r in rows]), np.array([r.ones for r in rows], float), np.array([r["all"] for r in rows], float))
    return model


def _logistic(x: np.ndarray, ones: np.ndarray, of: np.ndarray) -> tuple[float, float]:
    """Bias and slope of greatest likelihood under a weak pull to 0, by Newton's method."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.array([0.0, 0.02])
        step = np.linalg.solve(a.T @ (a * (of * p * (1 - p))[:, None]) + np.diag(pull + 1e-9), a.T @ (ones - of * p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


@any_names
def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of docs with `out`, from 0 to 1. Null and empty texts score as texts without evidence.

    A column named as `out` is replaced; repeated rows stay; an empty table gives an empty table.
    """
    rows = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                found = scorer.score([t or "" for t in batch.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, out])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))

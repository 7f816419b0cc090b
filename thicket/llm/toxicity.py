"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Labels mark documents, so tokens are labelled first: in toxic training documents
a token is toxic if its word, or how it begins, is much more frequent in toxic
documents than in others. A two-state chain over the tokens of a line learns from
these, with the word and its beginnings as features. Forward and backward passes
give each token's marginal probability of being toxic. A document's score is a
logistic function of its expected number of toxic tokens and of the largest
marginal; tokens above one half are the offending spans.

Training takes a bounded sample, ``SAMPLE`` documents of each label of at most
``LONGEST`` characters, one of each set of copies, in an order that a hash of the
id gives. It runs in the driver in a few seconds and gives a table of weights.
Scoring is one narrow pass over all whole texts, with no shuffle. Inputs are words
only: neither labels, language, source nor ids.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable

SAMPLE = 2000
LONGEST = 20_000
BEGINNINGS = (3, 4, 5, 6)
LEAST_DOCS = 6  # a feature in fewer toxic documents is no evidence
LEAST_RATIO = 12.0
CLEAN_FEATURES = 20_000
STEPS = 60
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_CACHE = 400_000


@dataclass
class Model:
    weights: dict[str, float]  # of the toxic state against the other
    bias: float
    moves: np.ndarray  # 2 x 2 log weights of going from one state to the next
    score: np.ndarray  # intercept, weight of the expected number, weight of the largest marginal


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, spans``.

    ``held_out``: crc32 of the id as text is divisible by 5 (a null id: of the empty
    text); those labels are never read. ``score`` is 0 to 1, ``predicted`` 1 from
    0.5 on, ``spans`` the toxic stretches as ``start:end`` in code points, joined
    by commas. Null and empty texts get the score of no toxic token. A document
    with several labels is toxic if one says so; without any labels every score is
    0. Repeated rows are scored each for itself; other columns are ignored.
    """
    model = train(training_sample(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                scores, spans = tagger.tag(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()),
                     pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                    ["doc_id", "held_out", "score", "predicted", "spans"],
                )

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string"
    )


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """Texts and labels of at most ``SAMPLE`` documents of each label, none held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(F.length(s), F.xxhash64(s)))
    # Only ids and hashes are joined and shuffled, no texts.
    usable = (
        docs.filter(~_held_out() & (F.length("text") <= LONGEST))
        .select("doc_id", F.array_max(lines).alias("longest_line"), F.xxhash64("doc_id").alias("order"))
        .join(known, "doc_id")
    )
    single = durable(usable.groupBy("toxic", "longest_line").agg(F.min(F.struct("order", "doc_id")).alias("m")))
    chosen = [
        single.filter(F.col("toxic") == label).select("toxic", "m.*").orderBy("order", "doc_id").limit(SAMPLE)
        for label in (0, 1)
    ]
    picked = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "toxic"))  # at most 2 x SAMPLE rows
    rows = docs.select("doc_id", "text").filter(F.length("text") <= LONGEST).join(picked, "doc_id")
    return sorted((r["text"], r["toxic"]) for r in rows.select("text", "toxic").distinct().collect())


def train(sample: list[tuple[str, int]]) -> Model:
    """Label the tokens, fit the chain, then the document score."""
    if not any(toxic for _, toxic in sample) or all(toxic for _, toxic in sample):
        always = 20.0 if sample and sample[0][1] else -20.0
        return Model({}, -20.0, np.zeros((2, 2)), np.array([always, 0.0, 0.0]))
    tokens = [[_features_key(w) for w in _WORD.findall(text)] for text, _ in sample]
    evidence, clean = _evidence(tokens, [toxic for _, toxic in sample])
    names = {f: i for i, f in enumerate(sorted(evidence | clean))}
    words = {w: i for i, w in enumerate(sorted({w for doc in tokens for w in doc}))}
    active = [[names[f] for f in _features(w) if f in names] for w in words]
    marked = np.array([any(f in evidence for f in _features(w)) for w in words])
    lines: list[np.ndarray] = []
    truth: list[np.ndarray] = []
    for (text, toxic), doc in zip(sample, tokens):
        start = 0
        for line in text.split("\n"):
            size = len(_WORD.findall(line))
            ids = np.array([words[w] for w in doc[start : start + size]], np.int64)
            start += size
            if size:
                lines.append(ids)
                truth.append(marked[ids] & bool(toxic))
    weights, bias, moves = _fit_chain(lines, truth, active, len(names))
    model = Model(
        {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-6}, bias, moves, np.zeros(3)
    )
    facts = Tagger(model).facts([text for text, _ in sample])
    model.score = _fit_score(facts, np.array([toxic for _, toxic in sample], float))
    return model


class Tagger:
    """Marginals of whole texts. Keeps the potential of at most ``_CACHE`` words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        marginals, bounds = self._marginals(texts)
        facts = _facts(marginals, bounds)
        scores = 1 / (1 + np.exp(-np.clip(facts @ self.model.score, -30, 30)))
        hits = np.flatnonzero(marginals >= 0.5)
        of = np.searchsorted(bounds, hits, side="right") - 1
        toxic: dict[int, set[int]] = {}
        for token, i in zip(hits.tolist(), of.tolist()):
            toxic.setdefault(i, set()).add(token - int(bounds[i]))
        return scores, [_spans(text, toxic[i]) if i in toxic else "" for i, text in enumerate(texts)]

    def facts(self, texts: list[str]) -> np.ndarray:
        return _facts(*self._marginals(texts))

    def _marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A marginal for every token, and where each text's tokens begin."""
        if len(self.known) > _CACHE:
            self.known.clear()
        known, sizes, lengths, potentials = self.known, [], [], []
        for text in texts:
            count = 0
            for line in text.split("\n"):
                line_words = _WORD.findall(line)
                if line_words:
                    for word in line_words:
                        value = known.get(word)
                        if value is None:
                            value = known[word] = self._potential(word)
                        potentials.append(value)
                    lengths.append(len(line_words))
                    count += len(line_words)
            sizes.append(count)
        chain = _Chain(np.array(lengths, np.int64))
        marginals = chain.run(np.array(potentials), self.model.moves)[0]
        return marginals, np.append(0, np.cumsum(sizes)).astype(np.int64)

    def _potential(self, word: str) -> float:
        weights = self.model.weights
        return self.model.bias + sum(weights.get(f, 0.0) for f in _features(_features_key(word)))


class _Chain:
    """Forward and backward passes over many lines at once, the longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        starts = np.cumsum(lengths) - lengths
        self.starts, self.lengths = starts[self.order], lengths[self.order]
        longest = int(lengths.max()) if len(lengths) else 0
        # How many lines have a token at each place.
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), side="left")

    def run(self, potential: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the toxic state, and summed marginals of the four moves.

        Only ratios of the two states are carried, so nothing over- or underflows.
        """
        t = np.exp(moves)
        x = np.exp(np.clip(potential, -30, 30))
        ahead, behind = np.empty_like(x), np.ones_like(x)
        for place, n in enumerate(self.active.tolist()):
            at = self.starts[:n] + place
            if place == 0:
                ahead[at] = x[at]
            else:
                a = ahead[at - 1]
                ahead[at] = x[at] * (t[0, 1] + a * t[1, 1]) / (t[0, 0] + a * t[1, 0])
        expected = np.zeros((2, 2))
        for place in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[place + 1]] + place
            y = x[at + 1] * behind[at + 1]
            behind[at] = (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y)
            a = ahead[at]
            parts = np.array([t[0, 0] + 0 * a, t[0, 1] * y, a * t[1, 0], a * t[1, 1] * y])
            expected += (parts / parts.sum(0)).sum(1).reshape(2, 2)
        odds = ahead * behind
        return odds / (1 + odds), expected


def _held_out():
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 5 == 0


def _features_key(word: str) -> str:
    return _EDGES.sub("", word).lower()


def _features(word: str) -> list[str]:
    """The word, marked off, and its beginnings."""
    if not word:
        return []
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def _evidence(tokens: list[list[str]], toxic: list[int]) -> tuple[set[str], set[str]]:
    """Features much more frequent in toxic documents, and the most frequent others."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for doc, label in zip(tokens, toxic):
        counts[label].update({f for word in set(doc) for f in _features(word)})
    n_toxic = sum(toxic)
    n_clean = len(toxic) - n_toxic
    evidence = {
        f
        for f, n in counts[1].items()
        if n >= LEAST_DOCS and n * n_clean >= LEAST_RATIO * (counts[0][f] + 1) * n_toxic
    }
    frequent = sorted(((n, f) for f, n in counts[0].items() if f not in evidence and n > 1), reverse=True)
    return evidence, {f for _, f in frequent[:CLEAN_FEATURES]}


def _fit_chain(lines, truth, active, n_features) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights that make the token labels likely: gradient steps with adapted rates and decay."""
    ids, label = np.concatenate(lines), np.concatenate(truth).astype(float)
    chain = _Chain(np.array([len(line) for line in lines], np.int64))
    word_of = np.repeat(np.arange(len(active)), [len(a) for a in active])
    feature_of = np.array([f for a in active for f in a], np.int64)
    observed = np.zeros((2, 2))
    for line in truth:
        np.add.at(observed, (line[:-1].astype(int), line[1:].astype(int)), 1)
    by_word = np.bincount(ids, label, len(active))
    state = np.zeros(n_features + 5)
    mean, square = np.zeros_like(state), np.zeros_like(state)
    state[n_features] = -4.0
    for step in range(1, STEPS + 1):
        potential = np.bincount(word_of, state[feature_of], len(active)) + state[n_features]
        marginals, expected = chain.run(potential[ids], state[n_features + 1 :].reshape(2, 2))
        miss = by_word - np.bincount(ids, marginals, len(active))
        slope = np.concatenate(
            [
                np.bincount(feature_of, miss[word_of], n_features) - 0.1 * state[:n_features],
                [miss.sum()],
                (observed - expected).ravel() - 0.1 * state[n_features + 1 :],
            ]
        )
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        rate = 0.3 if step < STEPS * 2 // 3 else 0.1
        state = state + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return state[:n_features], float(state[n_features]), state[n_features + 1 :].reshape(2, 2)


def _facts(marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text: 1, the logarithm of the expected number of toxic tokens, the largest marginal."""
    counts = np.diff(bounds)
    facts = np.zeros((len(counts), 3))
    facts[:, 0] = 1
    full = counts > 0
    if full.any():
        starts = bounds[:-1][full]
        facts[full, 1] = np.log1p(np.add.reduceat(marginals, starts))
        facts[full, 2] = np.maximum.reduceat(marginals, starts)
    return facts


def _fit_score(facts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with decay."""
    weights = np.zeros(facts.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(facts @ weights, -30, 30)))
        slope = facts.T @ (label - p) - 1.0 * weights
        bend = facts.T @ (facts * (p * (1 - p))[:, None]) + np.eye(len(weights))
        weights = weights + np.linalg.solve(bend, slope)
    return weights


def _spans(text: str, toxic: set[int]) -> str:
    """Stretches of toxic tokens that stand side by side."""
    out: list[list[int]] = []
    last = -2
    for i, match in enumerate(_WORD.finditer(text)):
        if i in toxic:
            if i == last + 1:
                out[-1][1] = match.end()
            else:
                out.append([match.start(), match.end()])
            last = i
    return ",".join(f"{start}:{end}" for start, end in out)

"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence with a telling word has a
probability from a linear model on its words and word stems; the document's is
their noisy-or with one leak, so length alone makes no document toxic.
Only document labels are needed to train, by the gradient of the document
likelihood, and the sentence scores then tell where the offending sentences
are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import lowest_hashed, share, shared

#: Bound of the labelled sample that training takes, for each label.
SAMPLE_PER_LABEL = 1_500
#: A sentence is cut after so many words where no full stop or line end comes first.
SENTENCE_WORDS = 64
#: A feature is kept when it marks the toxic documents of the sample more often than chance would, at this level.
LEVEL = 1e-3

_WORD = re.compile(r"[^\W_]+|[.!?\n]+")
_RUN, _STOP = re.compile(r"[^\W_]+"), re.compile(r"[.!?\n]+")


def _features(word: str) -> tuple[str, ...]:
    """The word itself, and its beginnings of 4 to 6 and endings of 4 letters, which stand for compounds."""
    n = len(word)
    return (word, *(f"{word[:k]}-" for k in (4, 5, 6) if n > k), *((f"-{word[-4:]}",) if n > 4 else ()))


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each sentence that has words; ends are exclusive, in code points."""
    out: list[tuple[int, int, list[str]]] = []
    words: list[str] = []
    start = end = 0
    for m in _WORD.finditer(text or ""):
        token = m.group()
        if token[0] in ".!?\n":
            if words:
                out.append((start, m.end(), words))
                words = []
            continue
        if not words:
            start = m.start()
        words.append(token.lower())
        end = m.end()
        if len(words) == SENTENCE_WORDS:
            out.append((start, end, words))
            words = []
    if words:
        out.append((start, end, words))
    return out


def log_tail(k: int, n: int, p: float) -> float:
    """log P(X >= k) for X binomial(n, p), bounded from above by its first term and the ratio of the next."""
    if k <= n * p:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = (n - k) / (k + 1) * p / (1 - p)
    return min(0.0, first - math.log(max(1e-12, 1.0 - ratio)))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float  #: of a sentence with telling words
    leak: float  #: logit of what no sentence explains

    def scorer(self) -> BagScorer:
        return BagScorer(self)


class _WordWeights(dict):
    """Summed feature weights of words, worked out when first asked for."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.features = weights

    def __missing__(self, word: str) -> float:
        get = self.features.get
        w = self[word] = sum(get(f, 0.0) for f in _features(word))
        return w


class BagScorer:
    """Scores texts with one model; keeps the weights of up to ``LIMIT`` words it has seen."""

    LIMIT = 400_000

    def __init__(self, model: ToxicityModel) -> None:
        self.bias, self.leak, self.words = model.bias, model.leak, _WordWeights(model.weights)

    def sentence_logits(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence with telling words."""
        weight = self.words.__getitem__
        sums = ((start, end, sum(map(weight, set(words)))) for start, end, words in sentences(text))
        out = [(start, end, self.bias + z) for start, end, z in sums if z]
        self._trim()
        return out

    def _trim(self) -> None:
        if len(self.words) > self.LIMIT:
            self.words.clear()

    def score(self, text: str | None) -> float:
        """Noisy-or over the leak and the sentences with telling words."""
        low = (text or "").lower()
        if len(low) == len(text or ""):  # the same sentences, without their places
            weight, bias, logits = self.words.__getitem__, self.bias, [self.leak]
            for part in _STOP.split(low):
                words = _RUN.findall(part)
                for i in range(0, len(words), SENTENCE_WORDS):
                    z = sum(map(weight, set(words[i : i + SENTENCE_WORDS])))
                    if z:
                        logits.append(bias + z)
            self._trim()
        else:
            logits = [self.leak, *(z for _, _, z in self.sentence_logits(text))]
        return float(-np.expm1(-np.logaddexp(0.0, np.asarray(logits)).sum()))


def fit(texts: list[str | None], labels: list[int], prior: float = 0.5, epochs: int = 150, rate: float = 0.1, decay: float = 2e-5) -> ToxicityModel:
    """Train on bags by full-batch Adam on the noisy-or likelihood; ``prior`` is the share of toxic documents outside the sample."""
    seen: dict[str, int] = {}  # documents with a feature: clean ones, and toxic ones times 2^32
    for text, label in zip(texts, labels, strict=True):
        words = {w for _, _, ws in sentences(text) for w in ws}
        one = 1 << 32 if label > 0 else 1
        for f in {f for w in words for f in _features(w)}:
            seen[f] = seen.get(f, 0) + one
    rate_of_toxic = sum(y > 0 for y in labels) / len(labels)
    counts = ((f, n >> 32, n & 0xFFFFFFFF) for f, n in seen.items() if n >> 32 > 2)
    index = {f: i for i, f in enumerate(sorted(f for f, toxic, clean in counts if log_tail(toxic, clean + toxic, rate_of_toxic) < math.log(LEVEL)))}
    del seen
    rows, cols, doc_of = [], [], []
    for d, text in enumerate(texts):
        for _, _, words in sentences(text):
            ids = [index[f] for f in {f for w in set(words) for f in _features(w)} if f in index]
            if not ids:
                continue
            cols += ids
            rows += [len(doc_of)] * len(ids)
            doc_of.append(d)
    rows_, cols_, docs = np.asarray(rows, dtype=np.int64), np.asarray(cols, dtype=np.int64), np.asarray(doc_of, dtype=np.int64)
    y = np.asarray(labels, dtype=float)
    n_sentences, n_features = len(docs), len(index)
    share = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum()))
    w, lone = np.zeros(n_features), np.array([-4.0, -4.0])  # bias and leak
    m, v, ml, vl = np.zeros(n_features), np.zeros(n_features), np.zeros(2), np.zeros(2)
    for t in range(1, epochs + 1):
        z = lone[0] + np.bincount(rows_, weights=w[cols_], minlength=n_sentences)
        # -log of "no sentence offends"
        survive = np.logaddexp(0.0, lone[1]) + np.bincount(docs, weights=np.logaddexp(0.0, z), minlength=len(y))
        p = -np.expm1(-survive)
        # d loss / d survive: for y = 0 it is 1, for y = 1 it is -(1 - p) / p
        slope = share * np.where(y > 0, -np.exp(-survive) / np.maximum(p, 1e-9), 1.0)
        g = slope[docs] / (1.0 + np.exp(-z))
        gw = np.bincount(cols_, weights=g[rows_], minlength=n_features) + decay * w
        gl = np.array([g.sum(), slope.sum() / (1.0 + np.exp(-lone[1]))])
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        ml, vl = 0.9 * ml + 0.1 * gl, 0.999 * vl + 0.001 * gl * gl
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        lone -= rate * (ml / c1) / (np.sqrt(vl / c2) + 1e-9)
    kept = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}
    return ToxicityModel(kept, float(lone[0]), float(lone[1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Train on a bounded sample of the labelled documents.

    The sample is, for each label, the ``per_label`` labelled rows whose
    doc_id hashes lowest; ``usable`` (a condition on doc_id) restricts it.
    Rows with a null doc_id, or a label other than 0 and 1, are not used.  Of
    repeated labels of a doc_id the highest counts, of repeated documents the
    text that sorts first.  Without rows of both labels the model scores every
    text near 0.02.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    if usable is not None:
        known = known.where(usable)
    toxic, n = known.agg(F.sum((F.col("_label") == 1).cast("double")), F.count(F.lit(1))).first()
    if not toxic or toxic == n:
        return ToxicityModel({}, -4.0, -4.0)
    chosen = [lowest_hashed(known.where(F.col("_label") == y), "doc_id", per_label, size) for y, size in ((0, n - int(toxic)), (1, int(toxic)))]
    ids = chosen[0].unionByName(chosen[1])
    # at most 2 * per_label ids
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    if len({r._label for r in rows}) < 2:
        return ToxicityModel({}, -4.0, -4.0)
    return fit([r.text for r in rows], [int(r._label) for r in rows], toxic / n)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the document probability.  Null and empty texts get the leak."""
    sent = share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared(sent).scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, score(F.col(text)))


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5, text: str = "text", out: str = "offending") -> DataFrame:
    """Add array ``out`` of struct(start, end, probability) of the sentences that reach ``least``, in order."""
    sent = share(docs.sparkSession, model)

    @F.pandas_udf("array<struct<start:int,end:int,probability:double>>")
    def locate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared(sent).scorer()
        for texts in batches:
            rows = []
            for t in texts:
                probs = [(s, e, float(1.0 / (1.0 + np.exp(-z)))) for s, e, z in scorer.sentence_logits(t)]
                rows.append([{"start": s, "end": e, "probability": p} for s, e, p in probs if p >= least])
            yield pd.Series(rows)

    return docs.withColumn(out, locate(F.col(text)))

"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon that labelled rows give, how near its words are to a second person, rates of capitals and
punctuation, and rates of obfuscation (letters replaced by look-alikes, or parted by signs).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labels import held_out, labelled_sample

#: Labelled rows that lexicon, trees and calibration are fitted on, at most; words of the lexicon, at most.
SAMPLE_ROWS, LEXICON_WORDS = 8000, 5000
FOLD = (4, 2)
THRESHOLD = 0.3
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur thou thee thy tu te toi ton ta tes vous votre vos du dich dir dein deine deiner deinen dein euch euer ihr sie tú ti usted ustedes vosotros vuestro".split()
)
_LOOKALIKE = str.maketrans("013457@$!|+€", "oieastasiite")
_SIGNS = re.compile(r"[\W_]+")
_INNER = re.compile(r"[^\W\d_][\d@$!|+*.\-_€]+[^\W\d_]")
#: Log-odds at which a lexicon word counts to a tier.
TIERS = (2.0, 3.5, 5.0, 6.5)
NAMES = (
    *(f"density over {t}" for t in TIERS), *(f"count over {t}" for t in TIERS), "largest", "sum by word", "nearest second person", "second person",
    "lexicon near second person", "capitals", "shouted words", "exclamations", "punctuation", "digits", "hidden lexicon words", "mixed words", "words",
)


def _plain(token: str) -> str:
    return token.lower().strip("#*$%&|<>!?.,;:\"'()[]{}…-_")


class Tokens(dict):
    """Raw token -> code, for a bounded number of tokens: log-odds in hundredths, then bits: second person, hidden, mixed."""

    most = 200_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        plain = _plain(token)
        weight = self.lexicon.get(plain, 0.0)
        hidden = mixed = False
        if not plain.isalpha() and plain:
            mixed = bool(_INNER.search(plain))
            if mixed and not weight:
                weight = max((self.lexicon.get(x, 0.0) for x in {_SIGNS.sub("", plain), _SIGNS.sub("", plain.translate(_LOOKALIKE)), plain.translate(_LOOKALIKE)}))
                hidden = weight > 0
        code = self[token] = (int(weight * 100) << 3) | (plain in SECOND_PERSON) | hidden << 1 | mixed << 2
        return code


def features(text: str, tokens: Tokens) -> np.ndarray:
    words = text.split()
    n = len(words)
    codes = np.fromiter(map(tokens.__getitem__, words), np.int64, n)
    weight = (codes >> 3) / 100.0
    you = np.flatnonzero(codes & 1)
    bad = np.flatnonzero(weight >= TIERS[0])
    out = np.zeros(len(NAMES))
    if n:
        counts = [int((weight >= t).sum()) for t in TIERS]
        out[0:4], out[4:8] = np.array(counts) / n, counts
        out[8], out[9] = weight.max(), weight.sum() / n
        out[10] = 1000
        if len(bad) and len(you):
            i = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - bad), np.abs(you[np.maximum(i - 1, 0)] - bad))
            out[10], out[12] = min(gap.min(), 1000), (gap <= 5).sum() / n
        out[11] = len(you) / n
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        letters = counts[65:91].sum() + counts[97:123].sum()
        out[13] = counts[65:91].sum() / max(letters, 1)
        out[15], out[16], out[17] = counts[33] / n, (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n, counts[48:58].sum() / n
        out[14] = out[13] > 0.6
        out[18], out[19] = (codes & 2).astype(bool).sum() / n, (codes & 4).astype(bool).sum() / n
        out[20] = n
    return out


def learn_lexicon(texts: list[str], y: np.ndarray, most: int = LEXICON_WORDS) -> dict[str, float]:
    """Words by smoothed log-odds of their document frequency in toxic and in other rows; at least three toxic rows hold each."""
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, y, strict=True):
        if label:
            toxic.update({_plain(w) for w in text.split()})
    known = {w for w, c in toxic.items() if c >= 3 and len(w) > 1}
    for text, label in zip(texts, y, strict=True):
        if not label:
            clean.update({_plain(w) for w in text.split()} & known)
    n, m = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    odds = {w: float(np.log((toxic[w] + 0.5) / (n + 1)) - np.log((clean[w] + 0.5) / (m + 1))) for w in known}
    best = sorted((w for w, o in odds.items() if o >= TIERS[0]), key=lambda w: (-odds[w], w))[:most]
    return {w: odds[w] for w in best}


@dataclass
class Trees:
    """Boosted trees of one depth on the log loss. A tree: by level, the feature and the cut of each node; then its leaves."""

    depth: int = 3
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3, ridge: float = 2.0, bins: int = 48) -> Trees:
    share = min(max(y.mean() if len(y) else 0.1, 0.01), 0.99)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for k in range(2**depth - 1):
            own = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf, -1)
            if len(own) >= 2:
                g, h = grad[own], curve[own]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for j, c in enumerate(cuts):
                    if len(c):
                        gs = np.cumsum(np.bincount(binned[own, j], g, len(c) + 1))[:-1]
                        hs = np.cumsum(np.bincount(binned[own, j], h, len(c) + 1))[:-1]
                        gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], j, c[i], i)
            feature[k], cut[k] = best[1], best[2]
            node[own] = 2 * k + 1 + (binned[own, best[1]] > best[3] if best[3] >= 0 else 0)
        leaf_of = node - (2**depth - 1)
        leaf = -rate * np.bincount(leaf_of, grad, 2**depth) / (np.bincount(leaf_of, curve, 2**depth) + ridge)
        raw += leaf[leaf_of]
        model.trees.append((feature, cut, leaf))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their probabilities, rising; between knots a line. Equal scores are one pool from the start."""
    knot, place, rows = np.unique(raw, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, n, labels in zip(knot, rows, np.bincount(place, y, len(knot)), strict=True):
        pools.append([float(labels), float(n), float(s * n)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a, strict=True)]
    knots = np.array([p[2] / p[1] for p in pools])
    values = np.array([(p[0] + 0.5 * 0.1) / (p[1] + 0.5) for p in pools])
    return knots, np.maximum.accumulate(values)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str], tokens: Tokens) -> np.ndarray:
        x = np.array([features(t, tokens) for t in texts]).reshape(len(texts), len(NAMES))
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.values), 0, 1)


def fit(texts: list[str], y: np.ndarray, parts: int = 4) -> Model:
    """Lexicon of all rows; trees on features whose lexicon comes from the other parts of the rows, so that it is no memory of
    them; calibration on what trees of the other parts say."""
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, Trees(), np.array([-1.0, 1.0]), np.array([share, share]))
    part = np.arange(len(y)) % parts
    x = np.zeros((len(y), len(NAMES)))
    for k in range(parts):
        tokens = Tokens(learn_lexicon([t for t, p in zip(texts, part, strict=True) if p != k], y[part != k]))
        own = np.flatnonzero(part == k)
        x[own] = [features(texts[i], tokens) for i in own]
    told = np.zeros(len(y))
    for k in range(parts):
        told[part == k] = fit_trees(x[part != k], y[part != k]).raw(x[part == k])
    return Model(learn_lexicon(texts, y), fit_trees(x, y), *isotonic(told, y))


def _scored(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(model.lexicon)
    for part in common.slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(common.texts(part), tokens), pa.float64())], ["doc_id", "score"])


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, fold: tuple[int, int] = FOLD) -> Model:
    return fit(*labelled_sample(docs, labels, "toxic", fold, sample_rows))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs(doc_id, text): one pass without a shuffle.

    Null and empty texts get the score of a text without words; repeated rows stay; without labels of both kinds every
    score is the labels' mean (0 without labels).
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scored(b, model), "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, train_toxicity(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned embeddings and one more channel: whether the last eight bytes stood a few bytes earlier as well. Learned
filters read overlapping chunks that cover the whole document; each filter's largest answer is combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labels import held_out, labelled_sample

#: Labelled rows that the network is fitted on, at most.
SAMPLE_ROWS = 4000
FOLD = (5, 0)
THRESHOLD = 0.3
#: A chunk is two neighbouring blocks of BLOCK bytes; chunks overlap by one block.
BLOCK, EMBEDDING, FILTERS = 16, 6, 24
#: Distances at which the repeat channel looks for the same eight bytes.
LAGS = range(2, 41)


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBEDDING; row 256 is padding and stays 0
    repeat: np.ndarray  # 2 x BLOCK x FILTERS: kernel of the repeat channel
    kernel: np.ndarray  # 2 x BLOCK * EMBEDDING x FILTERS
    bias: np.ndarray
    head: np.ndarray  # FILTERS + 1

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.repeat, self.kernel, self.bias, self.head]


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    embed = draw(257, EMBEDDING, s=0.5)
    embed[256] = 0
    return Network(embed, draw(2, BLOCK, FILTERS, s=0.1), draw(2, BLOCK * EMBEDDING, FILTERS, s=0.12), np.zeros(FILTERS, np.float32), draw(FILTERS + 1, s=0.1))


def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as blocks (256: padding), the repeat channel, and each document's first block; an empty text has one block."""
    counts = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    first = np.concatenate([[0], np.cumsum(counts)])
    data = np.full(first[-1] * BLOCK, 256, np.int16)
    again = np.zeros(len(data), np.float32)
    for t, at in zip(texts, first * BLOCK, strict=False):
        raw = np.frombuffer(t, np.uint8)
        data[at : at + len(raw)] = raw
        if len(raw) > 10:
            eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
            hit = np.zeros(len(eight), bool)
            for lag in LAGS:
                if lag < len(eight):
                    hit[lag:] |= eight[lag:] == eight[:-lag]
            again[at + 7 : at + len(raw)] = hit
    return data.reshape(-1, BLOCK), again.reshape(-1, BLOCK), first


def pooled(net: Network, data: np.ndarray, again: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Answers of the filters to every chunk, and the largest by document."""
    x = net.embed[data].reshape(len(data), -1)
    answer = x @ net.kernel[0] + again @ net.repeat[0]
    right = x @ net.kernel[1] + again @ net.repeat[1]
    right[first[1:-1]] = 0  # a document's last chunk does not reach into the next document
    answer[:-1] += right[1:]
    answer += net.bias
    return answer, np.maximum(np.maximum.reduceat(answer, first[:-1], axis=0), 0)


def probability(net: Network, best: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(best @ net.head[:-1] + net.head[-1], -30, 30)))


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss. Only a filter's largest chunk of a document has a gradient, so a step costs little more than a score."""
    net, rng = new_network(seed), np.random.default_rng(seed)
    share = min(max(y.mean() if len(y) else 0.5, 0.02), 0.98)
    net.head[-1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        net.head[:-1] = 0
        return net
    epochs = max(epochs, min(60, 20_000 // len(y)))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            data, again, first = blocks([texts[i] for i in rows])
            answer, best = pooled(net, data, again, first)
            error = ((probability(net, best) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = [np.zeros_like(p) for p in net.parameters()]
            grads[4][:-1], grads[4][-1] = error @ best, error.sum()
            back = error[:, None] * net.head[:-1] * (best > 0)
            for d in range(len(rows)):
                at = first[d] + answer[first[d] : first[d + 1]].argmax(axis=0)
                for side in (0, 1):
                    use = (at + side < first[d + 1]) & (back[d] != 0)
                    i, f = at[use] + side, np.flatnonzero(use)
                    if len(f) == 0:
                        continue
                    g = back[d, f]
                    seen = data[i]
                    grads[2][side][:, f] += (net.embed[seen].reshape(len(f), -1) * g[:, None]).T
                    grads[1][side][:, f] += (again[i] * g[:, None]).T
                    np.add.at(grads[0], seen, (net.kernel[side][:, f].T * g[:, None]).reshape(len(f), BLOCK, EMBEDDING))
            grads[3] += back.sum(axis=0)
            step += 1
            now = rate * min(1.0, 3 * (1 - epoch / epochs))
            for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + now * 1e-4 * p
            net.embed[256] = 0
    return net


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    return probability(net, pooled(net, *blocks(texts))[1]) if texts else np.empty(0)


def score_long(net: Network, text: bytes, part: int = 1 << 16) -> np.ndarray:
    """score() of one text, a part of so many blocks at a time: the same chunks, in bounded memory."""
    n = max(1, -(-len(text) // BLOCK))
    best = np.zeros((1, FILTERS), np.float32)
    for a in range(0, n, part):
        low, high = max(0, a - 4), min(n, a + part + 1)  # four blocks hold every lag
        answer, _ = pooled(net, *blocks([text[low * BLOCK : high * BLOCK]]))
        best = np.maximum(best, answer[a - low : min(a + part, n) - low].max(axis=0))
    return probability(net, best)


def _scored(batches: Iterable[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        own = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text").cast(pa.binary())]
        out: list[np.ndarray] = []
        at = 0
        while at < len(own):  # about half a megabyte at once
            to, size = at, 0
            while to < len(own) and (size == 0 or size + len(own[to]) < 500_000):
                size += len(own[to])
                to += 1
            out.append(score_long(net, own[at]) if size > 500_000 else score(net, own[at:to]))
            at = to
        scores = pa.array(np.concatenate(out).astype(np.float64)) if out else pa.array([], pa.float64())
        yield part.select([n for n in part.schema.names if n != "text"]).append_column("score", scores)


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, fold: tuple[int, int] = FOLD) -> Network:
    texts, y = labelled_sample(docs, labels, "quality", fold, sample_rows)
    return fit([t.encode() for t in texts], y)


def quality_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of each row of docs(doc_id, text): one pass without a shuffle; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scored(b, net), "doc_id long, score double")


def with_quality(docs: DataFrame, net: Network, column: str = "quality_score") -> DataFrame:
    """docs with a column more; whatever other columns they have, texts whole. The network is the only thing that is sent along."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    marked = inner.withColumn("text", F.col(text))
    schema = ", ".join(f"{n} {docs.schema[i].dataType.simpleString()}" for i, n in enumerate(names))
    scored = marked.mapInArrow(lambda b: _scored(b, net), f"{schema}, score double")
    return scored.toDF(*docs.columns, column)


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    net = train_quality(docs, common.read(spark, sf_dir, "labels"))
    scored = quality_scores(docs, net)
    return scored.select("doc_id", held_out(FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

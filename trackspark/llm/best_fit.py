"""Best-fit packing under several capacities.

Documents become token ids; only those longer than a sequence are cut. Each piece then goes to the sequence that a vector
best fit selects: of those with room left in every capacity (tokens, documents, attention cost) the one whose weighted
residual norm is least, or whose weighted dot product with the piece is greatest.
"""

from __future__ import annotations

import array
import base64
import os
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces that one task packs, about. A shard of this size leaves a sequence or two that are not full.
SHARD_PIECES = 16_384
_IDS_BITS = 20


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most. Attention cost is the sum of squared lengths. The weights are those of the score."""

    tokens: int = 2048
    documents: int = 1024
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


class TokenBytes(dict):
    """A text without its leading space -> its ids as little-endian 32-bit numbers; remembered for a bounded number of texts.

    Byte-level BPE never joins across a space that follows no white space, so a document's ids are those of its parts.
    Parts are encoded from the rank file of the same vocabulary, which gives the same ids in a fifth of the time of
    `tokenizers`; `exact` is the latter. Its pattern walks back over white space, so parts with very long runs go to `exact`.
    """

    _LONG_RUN = re.compile(r"(?<!\s)\s{10000}")

    most = 200_000

    def __init__(self, path: str, lead: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.lead, self.exact = path, lead, Tokenizer.from_file(path).encode
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_ordinary
        else:
            self.encode = lambda text: self.exact(text, add_special_tokens=False).ids

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        long_run = len(part) >= 10_000 and self._LONG_RUN.search(part)
        ids = _packed(self.exact(self.lead + part, add_special_tokens=False).ids if long_run else self.encode(self.lead + part))
        if len(part) < 64:
            self[part] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def token_bytes(text: str, later: TokenBytes, first: TokenBytes) -> bytes:
    """Ids of a text, 4 bytes each."""
    if "<|" in text:  # may hold a special token, which may span a space
        return _packed(first.exact(text, add_special_tokens=False).ids)
    parts = text.split(" ")
    if "" in parts[1:] or re.search(r"\s ", text):  # runs of white space belong together
        parts = re.split(r"(?<!\s) ", text)
    return b"".join([first[parts[0]], *map(later.__getitem__, parts[1:])]) if text else b""


def _pieces(batches: Iterable[pa.RecordBatch], path: str, most: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    later, first = TokenBytes(path, " "), TokenBytes(path, "")
    first.most = 10_000
    for part in common.slices(batches):
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(common.texts(part)):
            all_ids = token_bytes(text, later, first) + b"\0\0\0\0"
            n = len(all_ids) // 4
            cuts = [0, *range((n - 1) % most + 1, n + 1, most)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                own = all_ids[4 * a : 4 * b]
                row.append(i)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(own))
                ids.append(own if keep_ids else None)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("rid").take(at), part.column("doc_id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
            ["rid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
        )


def token_pieces(docs: DataFrame, path: str, most: int = 2048, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> rid (a number of the row), doc_id, piece, start, length, ids_crc32, ids (4 bytes each).

    A document's ids end with id 0; null text is empty and gives that id alone. Only documents of more than `most` ids
    are cut: all pieces but the first have `most`. Repeated rows are packed as often as they occur. Texts of any length are
    encoded whole, also runs of millions of spaces; other columns, whatever their names, are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        lambda batches: _pieces(batches, path, most, keep_ids), "rid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )


def vector_best_fit(lengths: np.ndarray, caps: Capacities = Capacities(), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the longest go first. score: "norm" or "dot".

    A bin takes a piece only with room in every capacity; a piece that fits no open bin opens one, and a piece beyond a
    capacity on its own gets a bin to itself.
    """
    lengths = np.asarray(lengths, np.int64)
    limit = np.array([caps.tokens, caps.documents, caps.attention], float)
    w = np.array(caps.weights) if score == "dot" else np.array(caps.weights) / limit**2
    wt, wd, wa = w / limit if score == "dot" else w
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tok, doc, att = (np.empty(len(lengths)) for _ in range(3))  # room left in open bins
    name = np.empty(len(lengths), np.int64)
    n_open = n_bins = 0
    least = lengths.min(initial=0)
    for i in order:
        size = float(lengths[i])
        cost = size * size
        at = -1
        if n_open:
            t, d, a = tok[:n_open], doc[:n_open], att[:n_open]
            fit = np.flatnonzero((t >= size) & (d >= 1) & (a >= cost))
            if len(fit):
                t, d, a = t[fit] - size, d[fit] - 1, a[fit] - cost
                if score == "dot":
                    at = fit[np.argmax(wt * t * size / limit[0] + wd * d / limit[1] + wa * a * cost / limit[2])]
                else:
                    at = fit[np.argmin(wt * t * t + wd * d * d + wa * a * a)]
        if at < 0:
            at = n_open
            tok[at], doc[at], att[at], name[at] = caps.tokens, caps.documents, caps.attention, n_bins
            n_open += 1
            n_bins += 1
        bins[i], offsets[i] = name[at], caps.tokens - tok[at]
        tok[at] -= size
        doc[at] -= 1
        att[at] -= cost
        if tok[at] < max(least, 1) or doc[at] < 1 or att[at] < 1:  # nothing fits any more
            n_open -= 1
            for x in (tok, doc, att, name):
                x[at] = x[n_open]
    return bins, offsets


def pack_pieces(pieces: DataFrame, caps: Capacities = Capacities(), score: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(rid, piece, length, ...), which should be a staged table: it is read twice.

    Pieces that fill a sequence alone are done. The rest go by hash to shards of about `shard_pieces`, so no document,
    source or group of copies fills a task, and the number of tasks grows with the input. An empty table gives no rows.
    """
    alone = (F.col("length") >= caps.tokens) | (F.col("length") * F.col("length") >= caps.attention)
    rest = pieces.where(~alone)
    shards = max(1, -(-rest.count() // shard_pieces))
    fields = pieces.schema.simpleString()[7:-1]

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rid", "piece"])
        bins, offsets = vector_best_fit(group.length.to_numpy(), caps, score)
        return group.drop(columns="shard").assign(sequence_id=(key[0] << _IDS_BITS) + bins, offset=offsets)

    packed = (
        rest.withColumn("shard", F.pmod(F.xxhash64("rid", "piece"), F.lit(shards))).groupBy("shard")
        .applyInPandas(pack, f"{fields.replace(':', ' ')}, sequence_id long, offset long")
    )
    full = pieces.where(alone).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, caps: Capacities = Capacities(), score: str = "norm", keep_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) with the sequence and the offset of each; with keep_ids also their ids."""
    pieces = token_pieces(docs, path, caps.tokens, keep_ids)
    return pack_pieces(common.staged(pieces if keep_ids else pieces.drop("ids"), "pieces"), caps, score).drop("rid")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> sequence_id, input_ids, and where each document begins: what a trainer reads."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("input_ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts")
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"), tokenizer_path())

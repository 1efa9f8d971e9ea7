"""Benchmark decontamination by a size-partitioned MinHash containment search.

Benchmark items are sets of word shingles, partitioned by size. A MinHash compares sets of like size only, so for each
partition a document is read as blocks of an eighth of the partition's upper size; an item meets a document when, under one
of the hash functions, its least shingle is the least of one of the document's blocks. Such pairs are verified by the exact
share of the item's shingles that the whole document holds.

Under one function an item whose shingles are found to four fifths meets with probability 0.3 at least: blocks that lie
inside the item, at least (0.8 - 2/4) of it, each catch the item's least shingle with their share of the item. FUNCTIONS
functions miss it with probability 0.7 ** FUNCTIONS.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, FUNCTIONS = 5, 44
#: An item is found when SHARE[0] of SHARE[1] of its shingles are.
SHARE = (4, 5)
#: Items, and characters of them, that tasks get at once; more are searched block by block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32_000_000
_CHUNK = 40_000  # shingles hashed at once


def _factors() -> np.ndarray:
    return common.mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Partition:
    """Items of one size: blocks of `block` shingles, and by function the items' least values in order, the items, and a filter."""

    block: int
    least: list[np.ndarray]
    items: list[np.ndarray]
    filters: list[np.ndarray]


class Items:
    """Shingle sets of benchmark items, indexed for the search."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.sets, self.short = [], [], {}
        sizes = []
        for i, text in zip(ids, texts, strict=True):
            words = (text or "").encode().lower().split()
            s = np.unique(common.shingle_hashes(common.word_hashes(words), SHINGLE))
            if len(s) == 0:
                continue
            if len(words) < SHINGLE:  # one shingle of fewer words: looked up among the document's runs of as many
                self.short.setdefault(len(words), {}).setdefault(int(s[0]), []).append(len(self.ids))
                sizes.append(0)
            else:
                sizes.append(1 << int(len(s) - 1).bit_length() if len(s) > 1 else 1)
            self.ids.append(i)
            self.sets.append(s)
        self.partitions = []
        for upper in sorted(set(sizes) - {0}):
            own = np.flatnonzero(np.array(sizes) == upper)
            part = Partition(max(1, upper // 8), [], [], [])
            for factor in _factors():
                low = np.array([((self.sets[i] * factor) >> np.uint64(32)).min() for i in own], np.uint32)
                order = np.argsort(low, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[low & 0xFFFF] = True
                part.least.append(low[order])
                part.items.append(own[order])
                part.filters.append(seen)
            self.partitions.append(part)

    def meet(self, shingles: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) of documents that lie one after the other in shingles, `counts` of each."""
        levels = []
        for part in self.partitions:
            blocks = -(-counts // part.block)
            doc = np.repeat(np.arange(len(counts)), blocks)
            first = np.cumsum(counts) - counts
            levels.append((part, doc, (first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * part.block)))
        found = set()
        for j, factor in enumerate(_factors()):
            values = ((shingles * factor) >> np.uint64(32)).astype(np.uint32)
            for part, doc, starts in levels:
                low = np.minimum.reduceat(values, starts) if part.block > 1 else values
                hits = np.flatnonzero(part.filters[j][low & 0xFFFF])
                if len(hits):
                    a, b = np.searchsorted(part.least[j], low[hits], "left"), np.searchsorted(part.least[j], low[hits], "right")
                    for h, x, y in zip(hits[a < b], a[a < b], b[a < b], strict=True):
                        found.update((int(doc[h]), int(i)) for i in part.items[j][x:y])
        return found

    def search(self, texts: list[list[bytes]]) -> list[list[tuple[int, int]]]:
        """For the words of each text: the items found and how many of their shingles it holds."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        hashed = [common.word_hashes(w) for w in texts]
        shingles = [common.shingle_hashes(h, SHINGLE) if len(h) >= SHINGLE else h[:0] for h in hashed]
        at = 0
        while at < len(texts):
            to, size, own = at, 0, []
            while to < len(texts) and (size == 0 or size + len(shingles[to]) <= _CHUNK):
                if len(shingles[to]):
                    own.append(to)
                    size += len(shingles[to])
                to += 1
            if own and self.partitions:
                met = self.meet(np.concatenate([shingles[i] for i in own]), np.array([len(shingles[i]) for i in own]))
                by_doc: dict[int, list[int]] = {}
                for d, i in met:
                    by_doc.setdefault(own[d], []).append(i)
                for d, items in by_doc.items():
                    held = np.unique(shingles[d])
                    for i in sorted(items):
                        s = self.sets[i]
                        n = int((held[np.minimum(np.searchsorted(held, s), len(held) - 1)] == s).sum())
                        if SHARE[1] * n >= SHARE[0] * len(s):
                            out[d].append((i, n))
            at = to
        for length, known in self.short.items():
            keys = np.array(sorted(known), np.uint64)
            for d, h in enumerate(hashed):
                if len(h) >= length:
                    runs = np.unique(common.shingle_hashes(h, length))
                    out[d] += [(i, 1) for x in runs[np.isin(runs, keys)] for i in known[int(x)]]
        return out


def item_blocks(items: DataFrame, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[Items, bool]]:
    """items(item_id, text) in blocks whose size is checked, so that what goes to the tasks does not grow with the table; and whether it is the only
    block. The driver holds one block: who reads several ends each one's work in a table before the next."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Items([r.item_id for r in own], [r.text for r in own]), blocks == 1


def _pairs(batches: Iterable[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        row, item, size, n = [], [], [], []
        for d, found in enumerate(items.search(list(common.word_bytes(part)))):
            for i, shared in found:
                row.append(d)
                item.append(items.ids[i])
                size.append(len(items.sets[i]))
                n.append(shared)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (item, size, n))],
            ["doc_id", "item_id", "n_item_shingles", "n_shared"],
        )


def contained_items(docs: DataFrame, items: DataFrame, **blocks: int) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: items of which docs(doc_id, text) hold four fifths of the 5-word shingles.

    Words lie between ASCII white space, A-Z in lower case; items of fewer words are one shingle, which a document holds
    where these words follow each other. Null and word-free texts neither hold nor are held. Rows repeat as docs and items
    do. One pass over docs for each block of items, without a shuffle; a task holds a batch of documents. With several blocks each pass ends
    in a table in the shared folder, so that neither the driver nor a task holds more than one block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for own, alone in item_blocks(items, **blocks):
        part = rows.mapInArrow(lambda b, own=own: _pairs(b, own), "doc_id long, item_id long, n_item_shingles long, n_shared long")
        part = part if alone else common.staged(part, "contained")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def _clean(batches: Iterable[pa.RecordBatch], items: Items, text: str) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, text):
        yield part.filter(pa.array([not x for x in items.search(list(common.word_bytes(part, text)))], pa.bool_()))


def decontaminated(docs: DataFrame, items: DataFrame, **blocks: int) -> DataFrame:
    """docs without the rows that hold an item; their columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {docs.schema[i].dataType.simpleString()}" for i, n in enumerate(names))
    text, out = names[docs.columns.index("text")], docs.toDF(*names)
    for own, alone in item_blocks(items, **blocks):
        before, out = out, out.mapInArrow(lambda b, own=own: _clean(b, own, text), schema)
        if not alone:
            out = common.staged(out, "clean")
            common.unstage(before)
    return out.toDF(*docs.columns)


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with t as (
  select 0 as kind, doc_id as id, coalesce(text, '') as text from documents
  union all select 1, item_id, coalesce(text, '') from benchmark
), w as (
  select kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from t
), k as (
  select unnest([1, 2, 3, 4, 5]) as k
), i as (
  select distinct id, least(len(w), 5) as k, sh from (
    select id, w, unnest(list_transform(range(1, cast(greatest(len(w) - 3, 2) as bigint)), lambda j: array_to_string(w[j:j+4], ' '))) as sh
    from w where kind = 1 and len(w) > 0)
), d as (
  select distinct id, k, sh from (
    select id, k, unnest(list_transform(range(1, cast(len(w) - k + 2 as bigint)), lambda j: array_to_string(w[j:j+k-1], ' '))) as sh
    from w, k where kind = 0 and len(w) >= k and k in (select k from i))
), n as (select id, count(*) as n from i group by id)
select d.id as doc_id, i.id as item_id, any_value(n.n) as n_item_shingles, count(*) as n_shared, count(*) / any_value(n.n) as containment
from i join d on d.sh = i.sh and d.k = i.k join n on n.id = i.id
group by d.id, i.id having 5 * count(*) >= 4 * any_value(n.n)
"""

"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles. Two documents link when 100 * intersection >= percent * union. Sets that are equal
form one class; classes that share a shingle of their prefixes, and that parity bits do not prove apart, fall into one
family; inside a family an inverted index is searched for the classes that reach the required overlap: short lists are merged by a heap,
long ones are only probed for what the short ones left (DivideSkip).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .gear_chunks import beside, tagged

#: Frequent shingles that come last in the prefix order, at most. Only the order, never the result, depends on them.
FREQUENT = 262_144
#: Classes, and shingles of them, that one task indexes. Larger families are searched block by block.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 2_000_000
_LOCAL = 1_000_000
#: Classes under one shingle that are compared by their parity bits; more are all joined to one of them.
COMPARED = 4000


class FrequentCounter:
    """Counts of frequent numbers in bounded memory: what was seen once is forgotten when the table is full."""

    def __init__(self, most: int = _LOCAL):
        self.most, self.keys, self.counts, self.new, self.n_new = most, np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.new.append(values)
        self.n_new += len(values)
        if self.n_new >= self.most:
            self.merge()

    def merge(self) -> None:
        if self.new:
            keys, counts = np.unique(np.concatenate(self.new), return_counts=True)
            often = counts > 1
            known = np.isin(keys, self.keys, assume_unique=True)
            keep = known | often if len(self.keys) + len(keys) > self.most else slice(None)
            every, inverse = np.unique(np.concatenate([self.keys, keys[keep]]), return_inverse=True)
            self.counts = np.bincount(inverse, np.concatenate([self.counts, counts[keep]]), len(every)).astype(np.int64)
            self.keys = every
            if len(every) > self.most:
                stay = self.counts > 1
                self.keys, self.counts = every[stay], self.counts[stay]
            if len(self.keys) > self.most:
                stay = np.argsort(-self.counts, kind="stable")[: self.most // 2]
                stay.sort()
                self.keys, self.counts = self.keys[stay], self.counts[stay]
        self.new, self.n_new = [], 0

    def top(self, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        at = np.flatnonzero(self.counts >= least)
        at = at[np.argsort(-self.counts[at], kind="stable")[:n]]
        return self.keys[at], self.counts[at]


def _digest(sorted_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sorted_set.tobytes())


def _short(digest: bytes) -> int:
    """A shorter name of a class, for candidates only: two classes of one name cost work, not correctness."""
    return xxhash.xxh3_64_intdigest(digest) - (1 << 63)


def parity_bits(s: np.ndarray) -> bytes:
    """Parities of the set's hash values in about half as many bits as it has shingles, a power of two from 64.

    The bits in which two sets differ are at most the shingles in which they do, so many differing bits prove two sets apart.
    """
    size = max(64, 1 << int(max(len(s) - 1, 1) // 2).bit_length())
    return np.packbits(np.bincount((common.mixed(s) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(bits: int, size: int, n: int, other_bits: int, other_size: int, m: int, percent: int) -> bool:
    """False only for sets that do not link. Bits of unequal length compare after the longer is folded."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    while size > other_size:
        size //= 2
        bits = (bits & ((1 << size) - 1)) ^ (bits >> size)
    while other_size > size:
        other_size //= 2
        other_bits = (other_bits & ((1 << other_size) - 1)) ^ (other_bits >> other_size)
    return (100 + percent) * (bits ^ other_bits).bit_count() <= (100 - percent) * (n + m)


def _sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for words in common.word_bytes(part):
        yield np.unique(common.shingle_hashes(common.word_hashes(words), k))


def _classes(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tag", "n", "digest", "short", "bits", "h", "c"]
    often = FrequentCounter()
    for part in common.slices(batches):
        sets = list(_sets(part, k))
        often.add(np.concatenate(sets))
        digests = [_digest(s) if len(s) else None for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([d and _short(d) for d in digests], pa.int64()),
             pa.array([parity_bits(s) if len(s) else None for s in sets], pa.binary()), none, none],
            names,
        )
    keys, counts = often.top(FREQUENT // 2, 4)
    none = pa.nulls(len(keys), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(keys), pa.binary()), none, pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts)], names)


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles of a set of n, in any one order for all sets: two sets that link share one of theirs."""
    return n - -(-percent * n // 100) + 1


def _prefixes(batches: Iterable[pa.RecordBatch], k: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    told: set[bytes] = set()
    for part in common.slices(batches):
        names, tokens = [], []
        for s in _sets(part, k):
            digest = _digest(s)
            if len(s) and digest not in told:
                if len(told) < _LOCAL // 4:
                    told.add(digest)
                late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                own = np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)]
                names.append(np.full(len(own), _short(digest), np.int64))
                tokens.append(own.view(np.int64))
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, names)], ["token", "short"])


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, short) in order of both -> the different rows of tokens that stand with several classes."""
    last, told = None, False  # the last row so far, and whether it has gone out
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("token", "short")], 1)
        if last is not None:
            rows = np.concatenate([last, rows])
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows
        if len(rows) == 0:
            continue
        same = rows[1:, 0] == rows[:-1, 0]
        out = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        last, final = rows[-1:].copy(), bool(out[-1]) or told and len(rows) == 1
        out[0] &= not told
        told = final
        yield pa.RecordBatch.from_arrays([pa.array(rows[out, i]) for i in (0, 1)], ["token", "short"])


def _candidates(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, short, n, bits) in order of the token -> edges (a, b) that connect all classes under a token that may link."""
    token, run, hub = None, [], None
    seen: set[tuple[int, int]] = set()

    def connected() -> Iterator[tuple[int, int]]:
        groups: list[list[tuple]] = []  # of members that are connected so far
        for x in run:
            own: list[list[tuple]] = []
            for g in groups:
                y = next((y for y in g if may_link(x[3], x[2], x[1], y[3], y[2], y[1], percent)), None)
                if y:
                    own.append(g)
                    yield (y[0], x[0])
            if own:
                for g in own[1:]:
                    own[0].extend(g)
                    groups = [z for z in groups if z is not g]
                own[0].append(x)
            else:
                groups.append([x])

    for batch in batches:
        edges: list[tuple[int, int]] = []
        for t, short, n, bits in zip(*(batch.column(c).to_pylist() for c in ("token", "short", "n", "bits")), strict=True):
            if t != token:
                edges += connected()
                token, run, hub = t, [], None
            if hub is None:
                run.append((short, n, 8 * len(bits), int.from_bytes(bits, "little")))
                if len(run) > COMPARED:
                    hub = short
                    edges += ((hub, x[0]) for x in run[:-1])
                    run = []
            else:
                edges.append((hub, short))
        new = {(min(e), max(e)) for e in edges if e[0] != e[1]} - seen
        seen = seen | new if len(seen) < _LOCAL // 8 else new
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in new], pa.int64()) for i in (0, 1)], ["a", "b"])
    new = set(connected()) - seen
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in new], pa.int64()) for i in (0, 1)], ["a", "b"])


def _full_sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted classes; of rows that repeat one, few a task go on."""
    told: set[bytes] = set()
    for part in common.slices(batches):
        sets = list(_sets(part, k))
        keep = []
        for s, d in zip(sets, part.column("digest").to_pylist(), strict=True):
            keep.append(len(s) > 0 and d not in told and _digest(s) == d)
            if keep[-1] and len(told) < _LOCAL // 4:
                told.add(d)
        out = part.select(["family", "blocks", "digest", "copies"]).append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary()))
        yield out.filter(pa.array(keep))


#: Entries of short lists that are merged one by one; more are merged run by run.
_SINGLY = 2000


def heap_merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rising lists of numbers -> the different numbers in order, and how many lists hold each.

    Few entries pass a heap one by one; else the heap holds whole runs with their counts, and the two shortest merge until one is left.
    """
    if sum(map(len, lists)) <= _SINGLY:
        found: list[int] = []
        counts: list[int] = []
        for x in heapq.merge(*(own.tolist() for own in lists)):
            if found and found[-1] == x:
                counts[-1] += 1
            else:
                found.append(x)
                counts.append(1)
        return np.array(found, np.int64), np.array(counts, np.int64)
    runs = [(len(own), i, own, np.ones(len(own), np.int64)) for i, own in enumerate(lists)]
    heapq.heapify(runs)
    while len(runs) > 1:
        _, _, b, nb = heapq.heappop(runs)
        _, i, a, na = heapq.heappop(runs)
        at = np.searchsorted(a, b)
        hit = a[np.minimum(at, len(a) - 1)] == b
        na = na.copy()
        na[at[hit]] += nb[hit]
        if not hit.all():
            a, na = np.insert(a, at[~hit], b[~hit]), np.insert(na, at[~hit], nb[~hit])
        heapq.heappush(runs, (len(a), i, a, na))
    return runs[0][2], runs[0][3]


class Index:
    """Inverted lists of sets of numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        all_ = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(all_, kind="stable")  # so each list is in order of the sets
        self.tokens, starts = np.unique(all_[order], return_index=True)
        self.at = np.append(starts, len(all_))
        self.lists = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Sets that link with the query."""
        n = len(query)
        need = -(-percent * n // 100)  # no smaller overlap links, whatever the other's size
        i = np.searchsorted(self.tokens, query)
        i = i[self.tokens[np.minimum(i, len(self.tokens) - 1)] == query] if len(self.tokens) else i[:0]
        if len(i) < need:
            return np.empty(0, np.int64)
        lengths = self.at[i + 1] - self.at[i]
        i = i[np.argsort(-lengths, kind="stable")]
        n_long = min(need - 1, int(need / (0.05 * np.log2(lengths.max() + 1) + 1)))
        long_, short = i[:n_long], i[n_long:]
        found, counts = heap_merge([self.lists[self.at[x] : self.at[x + 1]] for x in short])
        keep = (counts >= need - n_long) & (100 * np.minimum(self.sizes[found], n) >= percent * np.maximum(self.sizes[found], n))
        found, counts = found[keep], counts[keep]
        required = -(-percent * (n + self.sizes[found]) // (100 + percent))
        for j, x in enumerate(long_[::-1]):  # shorter ones first
            if len(found) == 0:
                break
            own = self.lists[self.at[x] : self.at[x + 1]]
            p = np.searchsorted(own, found)
            counts = counts + (own[np.minimum(p, len(own) - 1)] == found)
            alive = counts + (n_long - 1 - j) >= required
            if not alive.all():
                found, counts, required = found[alive], counts[alive], required[alive]
        return found[counts >= required]


def _search(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows of one pair of blocks -> for each class: a root inside the task, and the documents it links with here."""
    one, two = int(group.one.iat[0]), int(group.two.iat[0])
    group = group.drop_duplicates("digest").sort_values("digest").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in group.shingles]
    copies = group.copies.to_numpy()
    block = group.block.to_numpy()
    asks, held = (np.flatnonzero(block == x) for x in (one, two))
    index = Index([sets[i] for i in held])
    root, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q in asks:
        hits = held[index.search(sets[q], percent)]
        hits = hits[hits != q]
        links[q] += copies[hits].sum()
        if one != two:
            links[hits] += copies[q]
        own = top(q)
        for other in np.unique([top(h) for h in hits]) if len(hits) else ():
            a, b = min(own, other), max(own, other)
            root[b] = a
            own = a
    roots = [top(i) for i in range(len(sets))]
    return pd.DataFrame({"digest": group.digest, "root": group.digest.to_numpy()[roots], "links": links})


def ngram_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, n_links.

    A document's set: its distinct k-word shingles, of words between ASCII white space with A-Z in lower case; the whole
    sequence where it has fewer words. component_id: the smallest doc_id reachable by links, itself included; n_links:
    other rows that it links with. Null and word-free texts have empty sets, link with nothing and are their own component.
    Rows without doc_id link like others; a component of such rows alone has a null component_id.
    Repeated rows are copies of each other. Only doc_id and text are read. An empty table gives no rows.
    """
    return row_groups(docs, k, percent, block_sets, block_shingles).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "n_links")


def row_groups(docs: DataFrame, k: int, percent: int, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, tag, n_shingles, n_links and first, the component's row (no_id, doc_id, tag)
    of least doc_id, or where none has one, of least tag; null for empty sets. The tag is a digest of the text.

    Scale: prefixes pass one shuffle, at every size, and only those of tokens with several classes are written; sets travel only for classes that share a prefix shingle with another class; exact copies collapse to one class
    before any pairing; counts and minima combine before their shuffles; families beyond a block are searched as pairs of
    blocks, each a task of bounded memory. All links count: nothing is capped.
    """
    rows = tagged(docs)
    told = common.staged(rows.mapInArrow(lambda b: _classes(b, k), "doc_id long, tag long, n long, digest binary, short long, bits binary, h long, c long"), "sets")
    counts = told.where("h is not null").groupBy("h").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).select("h").toPandas()
    frequent = np.sort(top.h.to_numpy(np.int64).view(np.uint64))

    per_row = told.where("h is null").select("doc_id", "tag", F.col("n").alias("n_shingles"), "digest")
    classes = (
        told.where("digest is not null").groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("short").alias("short"), F.max("bits").alias("bits"))
    )
    postings = rows.mapInArrow(lambda b: _prefixes(b, k, percent, frequent), "token long, short long")
    met = common.staged(postings.repartition("token").sortWithinPartitions("token", "short").mapInArrow(_met, "token long, short long"), "met")
    known = classes.select("short", "n", "bits").join(met.select("short").distinct(), "short", "left_semi")
    in_order = met.join(known, "short").select("token", "short", "n", "bits").repartition("token").sortWithinPartitions("token", "n", "short")
    families = common.staged(connected_components(in_order.mapInArrow(lambda b: _candidates(b, percent), "a long, b long")), "families")
    common.unstage(met)

    members = families.select(F.col("node").alias("short"), F.col("root").alias("family")).join(classes.drop("bits"), "short")
    members = common.staged(members.select("family", "digest", "first", "copies", "n"), "members")
    common.unstage(families)
    sizes = members.groupBy("family").agg(F.count("*").alias("f_sets"), F.sum("n").alias("f_shingles")).where("f_sets > 1").withColumn(
        "blocks", F.greatest(F.ceil(F.col("f_sets") / block_sets), F.ceil(F.col("f_shingles") / block_shingles)).cast("int")
    )
    wanted = common.staged(members.join(sizes.select("family", "blocks"), "family").select("family", "blocks", "digest", "copies", "first.doc_id", "first.tag"), "wanted")
    full = beside(rows, common.small(wanted)).select("family", "blocks", "digest", "copies", "text").mapInArrow(
        lambda b: _full_sets(b, k), "family long, blocks int, digest binary, copies long, shingles binary"
    )
    placed = full.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", "digest", "copies", "shingles", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
    )
    found = pairs.groupBy("family", "one", "two").applyInPandas(lambda g: _search(g, percent), "digest binary, root binary, links long")
    found = common.staged(found, "links")
    common.unstage(wanted)
    common.unstage(members)
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("digest <> root").select(F.col("digest").alias("a"), F.col("root").alias("b")))

    labelled = classes.join(links, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "first", F.coalesce("root", "digest").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    lowest = labelled.groupBy("root").agg(F.min("first").alias("first"))
    by_class = labelled.drop("first").join(lowest, "root").select("digest", "first", "n_links")
    return per_row.join(by_class, "digest", "left").select(
        "doc_id", "tag", "n_shingles", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(common.read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
           else list_transform(range(1, cast(len(w) - 2 as bigint)), lambda i: array_to_string(w[i:i+3], ' ')) end) as sh from w)
), n as (
  select w.doc_id, count(s.sh) as n_shingles from w left join s using (doc_id) group by w.doc_id
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all
), l as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y
  where 100 * shared >= 85 * (a.n_shingles + b.n_shingles - shared)
), r as (
  select doc_id, doc_id as c from n
  union select l.y, r.c from r join l on l.x = r.doc_id
)
select n.doc_id, any_value(n_shingles) as n_shingles, min(c) as component_id,
       (select count(*) from l where l.x = n.doc_id) as n_links
from n join r using (doc_id) group by n.doc_id
"""

"""Phrase collocation mining by stripes.

A stripe is a prefix of one or two words of a language with an associative counter of the words that follow it; the empty next
word counts where the piece ends. Stripes merge elementwise. A merged stripe gives the extensions of its prefix (its entries),
the prefix total (their sum) and, as the largest of them, what subsumes the prefix.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Occurrences a candidate has at least; percent of a phrase's own occurrences that a longer candidate takes over it.
LEAST, SUBSUMED = 10, 50
#: Phrases of each language in the report.
TOP = 2000
#: Parts that the stripe of any prefix is cut into by the next word, so that a common word's stripe meets in no single bucket.
SEGMENTS = 8
#: Characters of text for each bucket of stripes, and buckets at least.
BUCKET_CHARS, BUCKETS = 8_000_000, 32
#: Words whose stripes a task builds before it sends them on, and entries that are merged at once.
_WORDS, _ENTRIES = 2_000_000, 1_000_000
#: Bytes of blocks that a task sends at once.
_SENT_BYTES = 2_000_000
#: Parts of a language that are ranked apart before their first rows meet.
_PARTS = 256

#: A-Z in lower case, and whatever ends a piece as a line feed.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
_STRIPES = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])


class _Words:
    """Words of one language in order, numbered from 1; 0 stands after each piece."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(lambda: len(self.number))
        self.number[b""]
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words: list[bytes] = []
        for piece in text.translate(_FOLD).split(b"\n"):
            if own := piece.split():
                words += own
                words.append(b"")
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def entries(self) -> Iterator[tuple[pa.Array, tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]]:
        """The words in order; numbers of prefixes' words and of next words, counts and the hashes that choose the bucket: of prefixes of one word, then of two.

        Entries are numbers only and come in order of their prefix: strings of all of them at once would take most of a task's memory.
        """
        listed = sorted(self.number)  # numbers in order of the words, b"" first: neighbours in a block then share their beginnings
        words, hashes = pa.array(listed, pa.binary()).cast(pa.string()), common.word_hashes(listed)
        parts = (hashes % np.uint64(SEGMENTS)).astype(np.uint8)
        place = np.empty(len(listed), np.int32)
        place[np.fromiter(map(self.number.__getitem__, listed), np.int32, len(listed))] = np.arange(len(listed), dtype=np.int32)
        n, ids = np.int64(len(listed)), np.zeros(self.size + 2, np.int32)
        at = 0
        for own in self.ids:
            ids[at : at + len(own)] = place[own]
            at += len(own)
        self.number.clear()
        self.ids.clear()
        del listed, place
        inside = np.flatnonzero(ids[:-2]).astype(np.int32)
        pairs, at, counts = _counted(ids[inside].astype(np.int64) * n + ids[inside + 1])
        a, b = (x.astype(np.int32) for x in np.divmod(pairs, n))
        del pairs
        yield words, (a,), b, counts, common.mixed(hashes[a]) + parts[b]
        longer = np.flatnonzero(ids[inside + 1])
        triples = at[longer].astype(np.int64) * n + ids[inside[longer] + 2]
        del at, ids, inside, longer
        triples, _, counts = _counted(triples, False)
        p, c = (x.astype(np.int32) for x in np.divmod(triples, n))
        del triples
        a, b = a[p], b[p]
        yield words, (a, b), c, counts, common.mixed(common.mixed(hashes[a]) ^ hashes[b]) + parts[c]


def _counted(keys: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Different keys in order (without places they are sorted where they stand), each key's place among them (if asked for) and their counts; np.unique holds twice as much."""
    if places:
        order = np.argsort(keys)
        keys = keys[order]
    else:
        keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(first)
    at = None
    if places:
        at = np.empty(len(keys), np.int32)
        at[order] = np.cumsum(first, dtype=np.int32) - 1
    return keys[heads], at, np.diff(heads, append=len(keys)).astype(np.int32)


def _packed(lang: str | None, prefix: pa.Array, following: pa.Array, counts: np.ndarray, heads: np.ndarray) -> bytes:
    """A table of stripes; heads are the places of their first entries."""
    ends = pa.array(np.append(heads, len(counts)).astype(np.int32))
    rows = pa.RecordBatch.from_arrays([pa.array([lang] * len(heads), pa.string()), prefix, pa.ListArray.from_arrays(ends, following), pa.ListArray.from_arrays(ends, pa.array(counts))], schema=_STRIPES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STRIPES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _sent(lang: str, held: _Words, buckets: int) -> Iterator[pa.RecordBatch]:
    for words, prefix, following, counts, where in held.entries():
        bucket = (common.mixed(where) % np.uint64(buckets)).astype(np.int32)
        del where
        order = np.argsort(bucket, kind="stable")  # entries come in order of their prefix
        if not len(order):
            continue
        bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ids, blobs = [], []
        for i, j in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
            own = order[i:j]
            codes = [x[own] for x in prefix]
            heads = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in codes], axis=0)]))
            texts = [words.take(pa.array(x[heads])) for x in codes]
            ids.append(bucket[i])
            blobs.append(_packed(lang, texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, " "), words.take(pa.array(following[own])), counts[own], heads))
            if len(ids) == 64 or sum(map(len, blobs)) >= _SENT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "stripes"])
                ids, blobs = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "stripes"])


def _build(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> bucket, stripes: those of about _WORDS words at a time, combined over documents."""
    held: dict[str, _Words] = defaultdict(_Words)
    size = 0
    for part in common.slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()), strict=True):
            if text.is_valid and (raw := text.as_buffer().to_pybytes()):
                for piece in _pieces(raw):
                    before = held[lang].size
                    held[lang].add(piece)
                    size += held[lang].size - before
                    if size >= _WORDS:
                        while held:
                            yield from _sent(*held.popitem(), buckets)
                        size = 0
    while held:
        yield from _sent(*held.popitem(), buckets)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A very long text in parts that end where a piece ends; one without such an end stays whole."""
    at = 0
    while len(text) - at > common.SLICE_CHARS:
        cut = max(text.rfind(c, at, at + common.SLICE_CHARS) for c in (b"\n", b".", b",", b";", b":", b"!", b"?"))
        if cut < at:
            break
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


class _Stripes(NamedTuple):
    """Stripes of one language: prefixes, how many entries each has, and the entries' next words (a dictionary) and counts."""

    prefix: pa.Array
    sizes: np.ndarray
    following: pa.DictionaryArray
    n: np.ndarray


def _flat(stripes: pa.RecordBatch) -> _Stripes:
    """Words are copied, so that the block itself can go."""
    column = stripes.column("next")
    prefix = stripes.column("prefix").take(pa.array(np.arange(stripes.num_rows, dtype=np.int32)))
    return _Stripes(prefix, np.diff(np.asarray(column.offsets)), pc.list_flatten(column).dictionary_encode(), np.array(pc.list_flatten(stripes.column("n"))))


def _merged(held: list[_Stripes]) -> _Stripes:
    """Elementwise sums of stripes of one language, by numbers of their prefixes and next words."""
    prefix = pa.chunked_array([s.prefix for s in held]).combine_chunks().dictionary_encode()
    following = pa.chunked_array([s.following for s in held]).unify_dictionaries()
    names = following.chunk(0).dictionary
    keys = np.repeat(np.asarray(prefix.indices), np.concatenate([s.sizes for s in held])).astype(np.int64) * len(names)
    at = 0
    for chunk in following.chunks:
        keys[at : at + len(chunk)] += np.asarray(chunk.indices)
        at += len(chunk)
    n = np.concatenate([s.n for s in held])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    del order
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n, keys = np.add.reduceat(n, heads, dtype=np.int64), keys[heads]
    owner, following = np.divmod(keys, len(names))
    return _Stripes(prefix.dictionary, np.bincount(owner, minlength=len(prefix.dictionary)), pa.DictionaryArray.from_arrays(pa.array(following.astype(np.int32)), names), n)


def _read_off(lang: str, stripes: _Stripes, least: int) -> Iterator[pa.RecordBatch]:
    """Merged stripes -> (lang, size, prefix, next, n): totals of prefixes of one word (size 1), then extensions of at least `least` occurrences."""
    prefix, sizes, following, n = stripes
    two = np.asarray(pc.match_substring(prefix, " "))
    one = np.flatnonzero(~two)
    totals = np.add.reduceat(n, np.cumsum(sizes) - sizes)[one]  # no stripe is empty
    ends = np.asarray(pc.equal(following.dictionary, ""))[np.asarray(following.indices)]
    wanted = np.flatnonzero((n >= least) & ~ends)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[wanted]
    for words, size, after, counts in ((one, np.ones(len(one)), None, totals), (owner, two[owner] + 2, wanted, n[wanted])):
        for i in range(0, len(words), 50_000):
            own = words[i : i + 50_000]
            nexts = pa.nulls(len(own), pa.string()) if after is None else following.take(pa.array(after[i : i + 50_000])).dictionary_decode()
            columns = [pa.array([lang] * len(own), pa.string()), pa.array(size[i : i + 50_000].astype(np.int32)), prefix.take(pa.array(own)), nexts, pa.array(counts[i : i + 50_000])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "prefix", "next", "n"])


def _merge(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(bucket, stripes) in order of bucket -> what is read off each bucket's merged stripes."""
    now, held, size = None, defaultdict(list), 0
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("stripes"), strict=True):
            if bucket != now and held:
                yield from _bucket(held, least)
                size = 0
            now = bucket
            with pa.ipc.open_stream(blob.as_buffer()) as stream:
                for stripes in stream:
                    own = held[stripes.column("lang")[0].as_py()]
                    own.append(_flat(stripes))
                    size += len(own[-1].n)
            if size >= _ENTRIES:
                for lang, own in held.items():
                    held[lang] = [_merged(own)]
                size = sum(len(own[0].n) for own in held.values()) // 2  # what is merged already counts half, so that a large bucket is not merged anew for each blob
    yield from _bucket(held, least)


def _bucket(held: dict[str, list[_Stripes]], least: int) -> Iterator[pa.RecordBatch]:
    """What is read off the stripes held, language by language; they go meanwhile."""
    while held:
        lang, own = held.popitem()
        merged = _merged(own)
        own.clear()
        yield from _read_off(lang, merged, least)
        del merged
        pa.default_memory_pool().release_unused()


def stripe_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(text, lang) -> staged lang, size, prefix, next, n: totals of words (size 1, next null, in parts that have to be added), and phrases of 2 and 3 words that occur `least` times or more."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(BUCKETS, -(-chars // BUCKET_CHARS))
    stripes = rows.mapInArrow(lambda b: _build(b, buckets), "bucket int, stripes binary")
    dealt = stripes.repartition("bucket").sortWithinPartitions("bucket")
    return common.staged(dealt.mapInArrow(lambda b: _merge(b, least), "lang string, size int, prefix string, next string, n long"), "stripes")


def scored(l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) of the columns a, l and r, in decimals: exact up to counts of 10 ** 15."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")


def collocations(docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED) -> DataFrame:
    """docs(text, lang) -> lang, phrase, words, a, l, r, n, score of all phrases of 2 and 3 words that no longer candidate subsumes.

    Texts are folded (A-Z only), cut into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs. a: occurrences
    of the phrase; l and r: of its two parts at the cut of least score, ties at the earlier cut; n: words of the language; score:
    floor(1000000 a a / (l r)), in exact decimals. A phrase goes when a longer candidate that holds it has `subsumed` percent of its
    occurrences or more. Null lang is `und`, null and empty texts have no words; repeated rows and copies count as often as they
    stand; an empty table gives no rows; other columns are not read.

    Scale: a task combines the stripes of two million words before they leave it, as compressed blocks by bucket; a stripe is cut by
    its next words, so a common word or a language with most rows fills no bucket, and buckets are as many as the texts are long. A
    reducer merges block by block and holds one bucket. Only words and phrases of `least` occurrences are joined.
    """
    found = stripe_counts(docs, least)
    totals = found.where("size = 1").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
    words = common.staged(totals, "words")
    n = F.broadcast(words.groupBy("lang").agg(F.sum("n").alias("n_words"))) if words.select("lang").distinct().count() <= 10_000 else words.groupBy("lang").agg(F.sum("n").alias("n_words"))
    often = common.small(common.staged(words.where(F.col("n") >= least).select("lang", F.col("prefix").alias("word"), F.col("n").alias("f")), "often"))
    two = common.small(common.staged(found.where("size = 2").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("prefix").alias("w1"), F.col("next").alias("w2"), F.col("n").alias("a")), "two"))
    part = F.split("prefix", " ", 2)
    three = found.where("size = 3").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "prefix", part[0].alias("w1"), F.concat(part[1], F.lit(" "), F.col("next")).alias("rest"), F.col("next").alias("w3"), F.col("n").alias("a"))

    def of(word: str, name: str) -> DataFrame:
        return often.select("lang", F.col("word").alias(word), F.col("f").alias(name))

    def phrase(column: str, name: str) -> DataFrame:
        return two.select("lang", F.col("phrase").alias(column), F.col("a").alias(name))

    pairs = two.join(of("w1", "l"), ["lang", "w1"]).join(of("w2", "r"), ["lang", "w2"]).select("lang", "phrase", F.lit(2).alias("words"), "a", "l", "r", scored("l", "r").alias("score"))
    triples = three.join(of("w1", "l1"), ["lang", "w1"]).join(phrase("rest", "r1"), ["lang", "rest"]).join(phrase("prefix", "l2"), ["lang", "prefix"]).join(of("w3", "r2"), ["lang", "w3"])
    first, second = scored("l1", "r1"), scored("l2", "r2")
    cut = triples.select("lang", "phrase", "a", F.struct(first.alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")).alias("x"), F.struct(second.alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r")).alias("y"))
    cut = cut.select("lang", "phrase", F.lit(3).alias("words"), "a", F.least("x", "y").alias("z")).select("lang", "phrase", "words", "a", "z.l", "z.r", "z.score")
    over = three.select("lang", F.col("prefix").alias("phrase"), "a").unionAll(three.select("lang", F.col("rest").alias("phrase"), "a")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alive = pairs.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a"))).drop("longer")
    return alive.unionByName(cut).join(n, "lang").select("lang", "phrase", "words", "a", "l", "r", F.col("n_words").alias("n"), "score")


def top_collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, subsumed: int = SUBSUMED) -> DataFrame:
    """The first `top` collocations of each language by score, occurrences and phrase, with their rank from 1.

    A language is ranked in parts first; of each part at most `top` rows meet, so the last ranking has a fixed bound for each language.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = collocations(docs, least, subsumed).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("place", "part")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(common.read(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with p as (
  select lang, piece, row_number() over () as piece_id from (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)
), w as (
  select lang, piece_id, unnest(ws) as w1, unnest(range(len(ws))) as i
  from (select lang, piece_id, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p)
), g as (
  select lang, w1, lead(w1) over (partition by piece_id order by i) as w2, lead(w1, 2) over (partition by piece_id order by i) as w3 from w
), f1 as (select lang, w1, count(*) as f from g group by all
), ns as (select lang, sum(f) as n from f1 group by lang
), f2 as (select lang, w1, w2, count(*) as f from g where w2 is not null group by all having count(*) >= 10
), f3 as (select lang, w1, w2, w3, count(*) as f from g where w3 is not null group by all having count(*) >= 10
), c2 as (
  select f2.lang, f2.w1, f2.w2, concat(f2.w1, ' ', f2.w2) as phrase, f2.f as a, x.f as l, y.f as r, 1000000::hugeint * f2.f * f2.f // (x.f::hugeint * y.f) as score
  from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
), c3 as (
  select f3.lang, f3.w1, f3.w2, f3.w3, concat(f3.w1, ' ', f3.w2, ' ', f3.w3) as phrase, f3.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2,
         1000000::hugeint * f3.f * f3.f // (x.f::hugeint * yz.f) as s1, 1000000::hugeint * f3.f * f3.f // (xy.f::hugeint * z.f) as s2
  from f3 join f1 x on x.lang = f3.lang and x.w1 = f3.w1 join f2 yz on yz.lang = f3.lang and yz.w1 = f3.w2 and yz.w2 = f3.w3
       join f2 xy on xy.lang = f3.lang and xy.w1 = f3.w1 and xy.w2 = f3.w2 join f1 z on z.lang = f3.lang and z.w1 = f3.w3
), longer as (
  select lang, u, v, max(a) as most from (select lang, w1 as u, w2 as v, a from c3 union all select lang, w2, w3, a from c3) group by all
), kept as (
  select c2.lang, phrase, a, l, r, score from c2 left join longer on longer.lang = c2.lang and u = w1 and v = w2 where most is null or 100 * most < 50 * a
  union all
  select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from c3
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(ns.n as bigint) as n, cast(score as bigint) as score
from ranked join ns using (lang) where rank <= 2000
"""

"""Spelling variant grouping by a dictionary of trie-node pairs.

The words' prefixes are nodes of a forward trie, their suffixes nodes of a trie of the reversed words; both are numbered. A word of m
letters is met at the pairs (prefix node, suffix node) that part it at i = 0..m, and with the letter at i skipped at the pair
(prefix node at i, suffix node at i + 1). Two words differ by one replaced letter where their skipping pairs are equal, and by one
inserted or deleted letter where a skipping pair of the longer is a parting pair of the shorter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .hilbert_shards import CRC_TABLE_SQL, crc_sql

#: Letters and occurrences of a word at least; times that a form occurs as often as the word.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: A run of letters loses one where this divides its hash.
EVERY = 199
#: Nodes of this depth and less are numbered by their letters, a byte each, so no dictionary row is met by a large part of the words.
SHALLOW = 3
#: Different words that a task counts before it sends them on.
_HELD = 400_000

_RUN = re.compile(r"[a-zÀ-ÿ]+")


def _count(batches: Iterable[pa.RecordBatch], letters: int, every: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> word, n, summed over many documents of the task."""
    held: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for part in common.slices(batches):
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()), strict=True):
            if not text.is_valid:
                continue
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                if len(run) >= letters:
                    h = zlib.crc32(run.encode(), seed)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < letters:
                            continue
                    held[run] += n
        if len(held) > _HELD:
            yield sent()
            held.clear()
    yield sent()


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, every: int = EVERY) -> DataFrame:
    """docs(doc_id, text) -> word, n of the words of at least `letters` code points and `occurrences` occurrences over all documents.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; a run whose crc32 after `doc_id:` is divided by
    `every` loses one letter (a planted slip). A null doc_id stands as nothing before the colon; null texts have no words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(lambda b: _count(b, letters, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _packed(part: Column) -> Column:
    """The number of a shallow node: its letters, a byte each."""
    return F.when(part == "", F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.encode(part, "ISO-8859-1")), 16, 10).cast("long"))


def numbered_nodes(parts: DataFrame) -> DataFrame:
    """parts(part) -> part, node: numbers of the tries' deep nodes, from 2 ** 32 on, above those of shallow ones."""
    deep = parts.where(F.length("part") > SHALLOW).select("part").distinct()
    return common.staged(deep.select("part", (F.monotonically_increasing_id() + F.lit(1 << 32)).alias("node")), "nodes")


def trie_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """words(id, word) -> the parting pairs and the skipping pairs, each id, at, prefix, suffix (numbers of nodes).

    Letters must be code points up to U+00FF. Of equal neighbouring letters only the first is skipped, so that a word and what is
    left of it meet at one pair.
    """
    m = F.length("word")
    cuts = words.select("id", "word", F.explode(F.sequence(F.lit(0), m)).alias("at"))
    ends = common.staged(cuts.select("id", "at", F.expr("substring(word, 1, at)").alias("head"), F.expr("substring(word, at + 1)").alias("tail"), m.alias("m")), "cuts")

    def nodes(column: str) -> DataFrame:
        return common.small(numbered_nodes(ends.select(F.col(column).alias("part")))).toDF(column, f"{column}_node")

    number = lambda c: F.when(F.length(c) <= SHALLOW, _packed(F.col(c))).otherwise(F.col(f"{c}_node"))
    deep = ends.join(nodes("head"), "head", "left").join(nodes("tail"), "tail", "left")
    parted = common.staged(deep.select("id", "at", "m", number("head").alias("prefix"), number("tail").alias("suffix"), F.substring("tail", 1, 1).alias("letter"), F.expr("substring(head, at, 1)").alias("before")), "pairs")
    after = parted.select("id", (F.col("at") - 1).alias("at"), F.col("suffix").alias("suffix"))
    own = parted.where("at < m").select("id", "at", "prefix", (F.col("at") > 0).alias("inner"), "letter", "before")
    skipping = own.join(after, ["id", "at"]).select("id", "at", "prefix", "suffix", (~F.col("inner") | (F.col("letter") != F.col("before"))).alias("first_of_run"))
    return parted.select("id", "at", "prefix", "suffix"), skipping


def near_words(words: DataFrame) -> DataFrame:
    """words(id, word), all different -> id, near: ids of all words that differ by one inserted, deleted or replaced code point, both ways.

    Pairs meet by an integer join. At most one word for each letter of the alphabet has a given skipping pair, and a word has at most
    one parting pair with the two nodes, so no group grows with the vocabulary.
    """
    parting, skipping = trie_pairs(words)
    skips = common.staged(skipping, "skips")
    one, two = skips.select("prefix", "suffix", "id"), skips.select("prefix", "suffix", F.col("id").alias("near"))
    replaced = one.join(two, ["prefix", "suffix"]).where("id <> near").select("id", "near")
    longer = skips.where("first_of_run").select("prefix", "suffix", "id").join(parting.select("prefix", "suffix", F.col("id").alias("near")), ["prefix", "suffix"]).select("id", "near")
    return replaced.unionByName(longer).unionByName(longer.select(F.col("near").alias("id"), F.col("id").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) without circles, form null at an end -> word, root: the last word that forms lead to, by doubling of the steps."""
    now = common.staged(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = common.staged(now.join(step, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        common.unstage(now)
        now = longer.drop("moved")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """docs(doc_id, text) -> word, form, root, n, n_near, form_n of every word of word_counts().

    form: the near word of largest n, ties the smallest by code points, where that n is at least `times` the word's (times > 1, so forms
    make no circle); else null, as is form_n. n_near: near words. root: the last word that forms lead to, the word itself if it has none.
    Repeated rows count as often as they stand; empty tables and texts without words give no rows; other columns are not read.

    Scale: tasks count words before the shuffle, so texts stay where they are read. From there on work grows with the letters of the
    vocabulary: deep trie nodes are numbered by a table of different prefixes and suffixes, shallow ones by their letters, so that
    no node that many words share is a hot key.
    """
    if times <= 1:
        raise ValueError("times must be above 1: else forms could go in circles")
    counted = common.staged(word_counts(docs, letters, occurrences, every), "words")
    words = common.staged(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    common.unstage(counted)
    pairs = near_words(words.select("id", "word"))
    named = pairs.join(common.small(words.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))), "near")
    best = named.groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", F.lit(1))).alias("most"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("w"))).alias("best"))
    chosen = F.col("best.less") * -1 >= times * F.col("n")
    forms = common.staged(words.join(best, "id", "left").select("word", F.when(chosen, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, -F.col("best.less")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def variant_groups(variants: DataFrame) -> DataFrame:
    """spelling_variants() -> root, n_words, n: the groups of more than one word; members are the rows of variants themselves."""
    return variants.groupBy("root").agg(F.count("*").alias("n_words"), F.sum("n").alias("n")).where("n_words > 1")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.read(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
with recursive {CRC_TABLE_SQL}, runs as (
  select doc_id, run, count(*) as c from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run
    from documents) where length(run) >= 6 group by all
), hashed as (
  select run, c, {crc_sql("concat(cast(doc_id as varchar), ':', run)")} as h from runs, crc_table
), slipped as (
  select case when h % 199 = 0 then concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)) else run end as word, c from hashed
), words as (
  select word, cast(sum(c) as bigint) as n from slipped where length(word) >= 6 group by word having sum(c) >= 5
), gaps as (
  select word, n, i, concat(substring(word, 1, i), '_', substring(word, i + 2)) as gap, concat(substring(word, 1, i), substring(word, i + 2)) as rest
  from (select word, n, unnest(range(0, length(word)))::int as i from words)
), near as (
  select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.gap = b.gap and a.word <> b.word
  union select g.word, w.word, w.n from gaps g join words w on g.rest = w.word
  union select w.word, g.word, g.n from gaps g join words w on g.rest = w.word
), best as (
  select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as most from near group by word
), forms as (
  select words.word, case when most >= 5 * n then other end as form, n, coalesce(n_near, 0) as n_near, case when most >= 5 * n then most end as form_n
  from words left join best using (word)
), chain as (
  select word, word as root, 0 as steps from forms
  union all select chain.word, forms.form, steps + 1 from chain join forms on forms.word = chain.root where forms.form is not null
), last as (select word, arg_max(root, steps) as root from chain group by word)
select word, form, root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from forms join last using (word)
"""

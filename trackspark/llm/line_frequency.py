"""Quality rules by cross-document line frequency.

Lines are normalised (words joined by one space, lower case) and hashed; for each host the distinct documents
that hold a line are counted; lines above the limits are removed, and documents that this depletes are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: A line goes when more than LINE_DOCS documents of its host hold it, however large the host is.
LINE_DOCS = 20
#: A document is depleted when fewer words are left than the base rule asks of any document, or a smaller share of its words.
LEFT_WORDS, LEFT_SHARE = 10, 0.2

_SCHEMA = (
    "rid long, doc_id long, host string, digest binary, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>"
)


def repeat_words(words: list[str], k: int = 5) -> int:
    """Words inside runs of k words that the list holds twice or more, the first run included. Exact: no hashing."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    run = ids[:n]
    for j in range(1, k):
        _, run = np.unique(run * len(seen) + ids[j : j + n], return_inverse=True)
    hit = np.bincount(run)[run] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        out: list[tuple] = []
        for text in common.texts(part):
            words: list[str] = []
            full: set[str] = set()
            dup = 0
            lines: dict[int, int] = {}
            for line in text.split("\n"):
                own = common.WORD.findall(line)
                if own:
                    words += own
                    dup += line in full
                    full.add(line)
                    h = _hash(own)
                    lines[h] = lines.get(h, 0) + len(own)
            out.append((
                xxhash.xxh3_128_digest(text), len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup,
                repeat_words(words), [{"h": h, "w": w} for h, w in lines.items()],
            ))
        digest, n, chars, symbols, dups, repeats, lines_ = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [part.column("rid"), part.column("doc_id"), part.column("host"), pa.array(digest, pa.binary()),
             *(pa.array(x, pa.int64()) for x in (n, chars, symbols, dups, repeats)),
             pa.array(lines_, pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())])))],
            ["rid", "doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


def _hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).lower()) - (1 << 63)


def _rows(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))


def _frequent(lines: DataFrame, line_docs: int) -> DataFrame:
    """lines(host, h, digest) -> host, h of the lines that more than line_docs different documents of the host hold."""
    return lines.select("host", "h", "digest").distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_docs).select("host", "h")


def line_frequency_rules(
    docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE,
) -> DataFrame:
    """One row for each row of docs(doc_id, text, host): the base measures, the words that frequent lines take, and the verdict.

    Documents count as distinct by their text, so exact copies of a page do not turn its lines into boilerplate.
    Null text and text without words: all measures 0, base_failed. Null hosts form one host. A repeated row is
    judged as often as it occurs. Other columns of docs are not read, whatever their names. An empty table gives
    no rows.

    Scale: one Python pass writes the measures and the line hashes (not the text) to the shared folder; the counts
    combine before each shuffle, so a host or line with a third of all rows is no hot group; the join back meets only
    lines above the limits, of which there are at most (all lines / line_docs), and Spark broadcasts or splits it.
    """
    measured = common.staged(_rows(docs, host).mapInArrow(_measure, _SCHEMA), "lines")
    lines = measured.select("rid", "host", "digest", F.explode("lines").alias("x")).select("rid", "host", "digest", "x.h", "x.w")
    frequent = _frequent(lines, line_docs)
    taken = lines.join(frequent, ["host", "h"]).groupBy("rid").agg(F.sum("w").cast("long").alias("n_removed_words"), F.count("*").alias("n_removed_lines"))
    removed, n = F.coalesce("n_removed_words", F.lit(0).cast("long")), F.col("n_words")
    base = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    left = n - removed
    return measured.drop("digest", "lines").join(taken, "rid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (left >= left_words) & (left >= left_share * n)).alias("kept"), removed.alias("n_removed_words"),
        F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"),
    )


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        out = []
        for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
            if gone:
                taken = set(gone)
                text = "\n".join(x for x in text.split("\n") if not (own := common.WORD.findall(x)) or _hash(own) not in taken)
            out.append(text)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), pa.array(out, pa.string())], ["doc_id", "host", "text"])


def without_frequent_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """doc_id, host and text of each row of docs(doc_id, text, host), without the lines that more than line_docs documents of its host hold.

    Lines without words stay, and so do null texts and texts that hold no such line. Rows, limits and odd cases are those of
    line_frequency_rules(). Each text meets the list of its own frequent lines, so no list grows with the corpus.
    """
    rows = _rows(docs, host)
    keyed = rows.drop("rid").withColumns({"id_": F.col("doc_id"), "tag_": F.xxhash64("text")})
    lines = common.staged(keyed.mapInArrow(_line_hashes, "id_ long, tag_ long, host string, digest binary, h long"), "lines")
    found = lines.join(_frequent(lines, line_docs), ["host", "h"]).groupBy("id_", "tag_", "host").agg(F.collect_set("h").alias("gone"))
    gone = common.small(common.staged(found, "gone"), "gone").toDF("id2", "tag2", "host2", "gone")
    same = F.col("id_").eqNullSafe(F.col("id2")) & (F.col("tag_") == F.col("tag2")) & (F.col("host") == F.col("host2"))
    return keyed.join(gone, same, "left").select("doc_id", "host", "text", "gone").mapInArrow(_without, "doc_id long, host string, text string")


def _line_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches):
        row, digest, hashes = [], [], []
        for i, text in enumerate(common.texts(part)):
            own = {_hash(w) for line in text.split("\n") if (w := common.WORD.findall(line))}
            hashes += own
            row += [i] * len(own)
            digest += [xxhash.xxh3_128_digest(text)] * len(own)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("id_", "tag_", "host")), pa.array(digest, pa.binary()), pa.array(hashes, pa.int64())], ["id_", "tag_", "host", "digest", "h"])


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(common.read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         string_split(coalesce(text, ''), chr(10)) as ls
  from documents
), l as (
  select doc_id, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw
  from (select doc_id, host, text, unnest(ls) as line from d)
), lw as (
  select doc_id, host, text, line, lower(array_to_string(lw, ' ')) as norm, len(lw) as k from l where len(lw) > 0
), dups as (
  select doc_id, cast(count(*) - count(distinct line) as bigint) as n_dup_lines from lw group by doc_id
), frequent as (
  select host, norm from lw group by host, norm having count(distinct text) > 20
), taken as (
  select doc_id, cast(sum(k) as bigint) as n_removed_words, cast(count(distinct norm) as bigint) as n_removed_lines
  from lw join frequent using (host, norm) group by doc_id
), g as (
  select doc_id, i, w[i:i+4] as run from (select doc_id, w, unnest(range(1, cast(len(w) - 3 as bigint))) as i from d where len(w) >= 5)
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, run) as c from g) where c > 1
), rep as (
  select doc_id, count(distinct i + j) as n_repeat_words from r, (select unnest(range(0, 5)) as j) group by doc_id
), m as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         coalesce(n_removed_words, 0) as n_removed_words, coalesce(n_removed_lines, 0) as n_removed_lines
  from d left join dups using (doc_id) left join rep using (doc_id) left join taken using (doc_id)
), b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - n_removed_words >= 10 and n_words - n_removed_words >= 0.2 * n_words as kept,
       n_removed_words, n_removed_lines
from b
"""

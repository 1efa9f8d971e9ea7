"""Collocations, Hilbert shards and spelling variants against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from duck import assert_same  # noqa: E402

from trackspark.llm import collocations, common, hilbert_shards, queries, spelling_variants  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_hilbert_shards", "op13_spelling_variants"])
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


# ---- collocations

EXTRA = "text string, lang string, phrase string, prefix string, n long, bucket int"


def texts_of_phrases():
    rng = random.Random(4)
    words = ["New", "york", "city", "of", "the", "É", "a b", "x"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""])) for _ in range(80)]
    rows += [("new york city hall. " * 30, "en"), ("ties one, ties two; " * 12, "en"), ("a.b\rc\x0bd\x0ce\nf:g!h?i a\tb", "en"), (None, "en"), ("", None), ("  \t", "fr"), ("one", "fr")]
    return rows + rows[:20]


def brute_collocations(rows, least, subsumed, top):
    grams, size = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    grams[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in grams.items():
        rows_ = []
        for g, a in f.items():
            if len(g) == 1 or a < least or any(len(h) > len(g) and c >= least and 100 * c >= subsumed * a and g in (h[:2], h[1:]) for h, c in f.items()):
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], size[lang], -r[0]) for i, r in enumerate(sorted(rows_)[:top])]
    return sorted(out)


@pytest.mark.parametrize("words,entries,top", [(2_000_000, 1_500_000, 2000), (50, 40, 5)])
def test_collocations_equal_brute_force(spark, monkeypatch, words, entries, top):
    monkeypatch.setattr(collocations, "_WORDS", words)
    monkeypatch.setattr(collocations, "_ENTRIES", entries)
    rows = texts_of_phrases()
    docs = spark.createDataFrame([(*r, "clash", "clash", 1, 1) for r in rows], EXTRA).repartition(5)
    got = collocations.top_collocations(docs, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = brute_collocations(rows, 10, 50, top)
    assert len(want) > 10 and sorted(map(tuple, got)) == want


def test_tasks_hold_numbers_of_entries_not_their_strings(monkeypatch):
    packed, held = collocations._packed, []

    def watched(*parts):
        held.append(pa.total_allocated_bytes())
        return packed(*parts)

    monkeypatch.setattr(collocations, "_packed", watched)
    rng = np.random.default_rng(3)
    text = " ".join(f"commonword{i:06d}" for i in rng.zipf(1.3, 200_000) % 5_000)
    docs, before = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]}), pa.total_allocated_bytes()
    sent = [(b, s) for part in collocations._build([docs], 8) for b, s in zip(part.column("bucket").to_pylist(), part.column("stripes").to_pylist(), strict=True)]
    assert len(sent) == len(held) == 16 and max(held) - before < 20 * 200_000  # 30 bytes and more of a word when prefixes and next words of all entries were strings
    first = [pa.RecordBatch.from_pydict({"bucket": [0], "stripes": [s]}) for b, s in sent if b == 0]
    once, thrice = (sorted((r["size"], r["prefix"], r["next"] or "", r["n"]) for part in collocations._merge(first * k, least) for r in part.to_pylist()) for k, least in ((1, 4), (3, 12)))
    assert once and thrice == [(*r[:3], 3 * r[3]) for r in once]


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_000, 3_000_000_001, 3_000_000_007
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations.scored("l", "r").alias("s")).first().s
    assert got == 10**6 * a * a // (l * r) and 10**6 * a * a > 2**63


def test_long_texts_are_cut_between_pieces_only():
    text = b"one two. " * (common.SLICE_CHARS // 6)
    parts = list(collocations._pieces(text))
    assert len(parts) > 1 and b"".join(parts) == text and all(p.endswith(b".") for p in parts[:-1])
    assert list(collocations._pieces(b"w" * (common.SLICE_CHARS + 9))) == [b"w" * (common.SLICE_CHARS + 9)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert collocations.top_collocations(docs).count() == 0
    assert spelling_variants.spelling_variants(docs).count() == 0
    assert hilbert_shards.hilbert_shards(hilbert_shards.document_metadata(docs)).count() == 0


# ---- Hilbert shards


def test_the_curve_visits_each_cell_once_in_steps_of_one(spark):
    bits, n = 3, 3
    cells = spark.range(1 << bits * n).select(*((F.shiftright("id", bits * k) % (1 << bits)).alias(f"c{k}") for k in range(n)))
    steps = hilbert_shards.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)
    for name, value in steps:
        cells = cells.withColumn(name, value)
    path = [tuple(r) for r in cells.orderBy("curve").select("c0", "c1", "c2").collect()]
    assert sorted(r.curve for r in cells.select("curve").collect()) == list(range(1 << bits * n))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(path, path[1:], strict=False))


def odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["s1", "s2", "s3", None]), rng.choice(["en", "de"]), rng.randint(1, 4000)) for i in range(150)]
    rows += [(None, None, None, 1)] * 90 + [rows[3]] * 60  # a third are repeated rows without id
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, size long")


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_hold_their_law_and_slots_have_no_gaps(spark, law):
    rows = odd_rows(spark)
    placed = hilbert_shards.hilbert_shards(rows, shards=7, law=law, ties=("doc_id",)).toPandas()
    assert len(placed) == rows.count() and Counter(map(str, placed.doc_id)) == Counter(map(str, rows.toPandas().doc_id))
    for _, own in placed.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    runs = placed.sort_values(["shard", "slot"]).curve
    assert runs.is_monotonic_increasing
    counts, sums = placed.groupby("shard").size(), placed.groupby("shard")["size"].sum()
    assert len(counts) == 7
    if law == "rows":
        assert counts.max() - counts.min() <= 1
    else:
        assert abs(sums - placed["size"].sum() / 7).max() <= placed["size"].max()


def test_written_shards_prune_every_dimension(spark, tmp_path):
    rows = odd_rows(spark).where("source is not null")
    ranges = hilbert_shards.write_shards(rows, f"{tmp_path}/out", ("source", "size"), shards=8).toPandas()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == rows.count() and set(back.columns) == {*rows.columns, "curve", "shard", "slot"}
    whole = rows.selectExpr("max(size) - min(size) as w").first().w
    assert ((ranges.greatest_size - ranges.least_size) < 0.8 * whole).mean() >= 0.5
    assert (ranges.least_source == ranges.greatest_source).any()


def test_shards_reject_unknown_laws(spark):
    with pytest.raises(ValueError):
        hilbert_shards.hilbert_shards(odd_rows(spark), law="weight")


def test_main_path_has_no_python(spark):
    plan = hilbert_shards.hilbert_shards(odd_rows(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- spelling variants


def edits(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= times * n[w] else None for w, v in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out)


def spelled(seed=0):
    rng = random.Random(seed)
    base = ["different", "aaaaaa", "aaaaaaa", "abababab", "Übergröße", "receive", "banana", "mississippi", "ÀÀÀÀÀÀ", "xxxxxx"]
    words = ["diferent"] * 60 + ["dferent"] * 8  # two steps to their root
    for w in base:
        words += [w] * 400
        for _ in range(12):
            v, i = list(w), rng.randrange(len(w))
            kind = rng.randrange(3)
            v[i : i + (kind > 0)] = [] if kind == 1 else [rng.choice("aeàx")]
            words += ["".join(v)] * rng.choice([3, 5, 20, 90])
    rng.shuffle(words)
    cut = [words[i : i + 40] for i in range(0, len(words), 40)]
    rows = [(i if i % 9 else None, rng.choice([" ", ", ", "1"]).join(c)) for i, c in enumerate(cut)]
    return [*rows, rows[0], rows[0], (5, None), (6, ""), (7, "DIFFERENT " * 300), (8, "short ab")]


@pytest.mark.parametrize("held", [400_000, 3])
def test_variants_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(spelling_variants, "_HELD", held)
    rows = spelled()
    docs = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], "doc_id long, text string, word string, n long, id long").repartition(3)
    got = sorted(tuple(r) for r in spelling_variants.spelling_variants(docs).collect())
    want = brute_variants(rows)
    assert sum(r[1] is not None for r in want) > 5 and any(r[2] not in (r[0], r[1]) for r in want)
    assert got == want


def test_near_words_of_runs_and_every_position(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "aabaaa", "abcdef", "bcdefg", "abcdefg", "abcdeg", "abdcef", "acdef", "ÿbcdef", "abc", "ab", "abd", "b", "a", "bc"]
    table = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = Counter((words[r.id], words[r.near]) for r in spelling_variants.near_words(table).collect())
    assert got == Counter((a, b) for a in words for b in words if edits(a, b))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 20 else None) for i in range(21)]
    assert {r.root for r in spelling_variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w20"}
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), times=1)


def test_groups_name_their_root(spark):
    rows = spark.createDataFrame([("a", None, "a", 9), ("b", "a", "a", 2), ("c", None, "c", 3)], "word string, form string, root string, n long")
    assert [tuple(r) for r in spelling_variants.variant_groups(rows).collect()] == [("a", 2, 11)]

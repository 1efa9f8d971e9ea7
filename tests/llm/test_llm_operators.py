"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from duck import assert_same  # noqa: E402

from trackspark.llm import (  # noqa: E402
    best_fit,
    byte_cnn,
    chat_format,
    common,
    containment,
    gear_chunks,
    html_extract,
    jaccard_join,
    line_frequency,
    queries,
    suffix_dedup,
    suffix_grouping,
    toxicity,
)
from trackspark.llm.components import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, tag string, spans string"


def small_docs(spark, seed=0, n=60):
    """Random short texts with copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(seed)
    words = ["the", "of", "Ant", "bee", "é", "dog,", "x1", "zz"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    passage = " ".join(f"w{i}" for i in range(70))
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + passage + "\n" + texts[i + 1 if i + 1 < n else 0]
    base = [f"t{i}" for i in range(60)]
    for i in range(3, n, 5):
        own = list(base)
        own[rng.randrange(60)] = f"u{i}"
        texts[i] = " ".join(own)
    texts += [None, "", " \n ", "one", "a b c", "x" * 5000, "ab " * 3000, texts[3], texts[3], texts[8]]
    rows = [(i, t, f"s{i % 3}" if i % 11 else None, "clash", None) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[4], (None, "null id", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def without_ids(docs):
    """A third of the rows without doc_id, another third with reused ids."""
    return docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") % 4).otherwise(F.col("doc_id"))))


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_line_limits_and_depletion(spark):
    shared = "\n".join(" ".join(f"m{i}{c}" for c in "abcdef") for i in range(6))
    rows = [(i, f"{shared}\nown text {i}", "h") for i in range(8)] + [(100 + i, f"{shared}\n" + " ".join(f"w{i}_{j}" for j in range(80)), "h") for i in range(2)]
    rows += [(200, shared, "other"), (201, None, "h"), (202, "", None)] + [(300 + i, " ".join(f"c{j}" for j in range(20)), "h") for i in range(9)]
    got = line_frequency.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_docs=5).toPandas().set_index("doc_id")
    assert not got.kept.loc[:7].any() and got.kept.loc[[100, 101, 200]].all()
    assert got.kept.loc[300:308].all(), "copies of a text are one document"
    assert got.base_failed.loc[[201, 202]].all() and (got.n_removed_lines.loc[:7] == 6).all()
    assert line_frequency.line_frequency_rules(empty(spark)).count() == 0


def test_texts_without_frequent_lines(spark):
    shared = ["Subscribe  to us", "All rights RESERVED"]
    rows = [(i if i % 3 else None, f"{shared[0]}\nown {i}\n\n{shared[1].lower()}\nend", "h") for i in range(7)] + [(50, shared[0], "other"), (51, None, "h"), (52, "", None), (53, "own 1", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"gone": F.lit("clash"), "tag_": F.lit(1)})
    got = line_frequency.without_frequent_lines(docs.unionByName(docs.limit(1)), line_docs=5).toPandas()
    assert got.columns.tolist() == ["doc_id", "host", "text"] and len(got) == len(rows) + 1
    want = [f"own {i}\n" for i in range(7)]  # "end" goes as well: seven documents hold it
    assert sorted(t for t in got.text.dropna() if t.startswith("own") and t != "own 1") == sorted([*want, want[0]]) and got.text.isna().sum() == 1
    assert got[got.doc_id == 50].text.tolist() == [shared[0]]
    assert line_frequency.without_frequent_lines(empty(spark)).count() == 0


def test_line_rules_ignore_other_columns_and_read_long_lines(spark):
    long_ = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, long_, "h", 1, "x"), (None, long_, "h", 1, "x"), (3, "a b c d e f g h i j k", None, 1, "x")]
    got = line_frequency.line_frequency_rules(spark.createDataFrame(rows, "doc_id int, text string, source string, rid long, host string")).toPandas()
    assert sorted(got.n_words) == [11, 200_000, 200_000] and got.kept.all() and got.doc_id.isna().sum() == 2


def test_repeat_words():
    assert line_frequency.repeat_words("a b c d e a b c d e".split()) == 10
    assert line_frequency.repeat_words("a b c d e f".split()) == 0
    assert line_frequency.repeat_words(["a"] * 6) == 6 and line_frequency.repeat_words(["a"] * 5) == 0


def test_token_bytes_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = best_fit.tokenizer_path()
    t = Tokenizer.from_file(path)
    later, first = best_fit.TokenBytes(path, " "), best_fit.TokenBytes(path, "")
    rng = random.Random(1)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "b c", "é", "1", "23", "!!", "'s", "<|endoftext|>", "<|end", "　", "\xa0 ", "日本", "🙂", "\r\n", " x"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert best_fit.token_bytes(text, later, first) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_whole_and_gapless(spark):
    docs = small_docs(spark)
    got = best_fit.pack_documents(docs, best_fit.tokenizer_path(), best_fit.Capacities(tokens=256, documents=8, attention=256 * 256), keep_ids=True).toPandas()
    sizes = got.groupby("sequence_id").agg(tokens=("length", "sum"), docs=("length", "size"), cost=("length", lambda x: (x**2).sum()))
    assert (sizes.tokens <= 256).all() and (sizes.docs <= 8).all() and (sizes.cost <= 256 * 256).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got.itertuples())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(best_fit.tokenizer_path())
    n = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in docs.toPandas().text)
    assert got.length.sum() == n
    packed = best_fit.sequences(best_fit.pack_documents(docs, best_fit.tokenizer_path(), keep_ids=True))
    assert packed.agg(F.sum(F.length("input_ids"))).first()[0] == 4 * n
    assert best_fit.pack_documents(empty(spark), best_fit.tokenizer_path()).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\u3000", " \n", "a", "7", "!", "\u00e9"])
def test_very_long_runs_are_encoded_whole(run):
    from tokenizers import Tokenizer

    path = best_fit.tokenizer_path()
    text = "a" + run * (2_000_000 // len(run) if not run.strip() else 50_000) + "b c"
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert best_fit.token_bytes(text, best_fit.TokenBytes(path, " "), best_fit.TokenBytes(path, "")) == np.array(ids, "<u4").tobytes()


def test_packing_equals_a_naive_cutter_and_is_near_the_lower_bound(spark):
    """The query's pieces against a document-by-document cutter on `tokenizers`; sequences against total tokens / 2048."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "long text, " * 4000), (-2, None), (None, "no id"), (-3, "w " * 2047)], docs.schema))
    got = best_fit.pack_documents(docs.withColumns({"rid": F.lit(1), "piece": F.lit("clash"), "ids": F.lit(0)}), best_fit.tokenizer_path()).toPandas()
    encode = Tokenizer.from_file(best_fit.tokenizer_path()).encode
    want = []
    for r in docs.collect():
        ids = encode(r.text or "", add_special_tokens=False).ids + [0]
        at = 0
        while at < len(ids):
            size = (len(ids) - at) % 2048 or 2048
            want.append((r.doc_id, sum(w[0] == r.doc_id for w in want) if r.doc_id is not None else 0, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
    key = lambda rows: sorted(tuple(-9 if pd.isna(x) else int(x) for x in r) for r in rows)
    assert key(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == key(want)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_vector_best_fit_selects_by_its_score(score):
    """Against a plain loop over all open bins, where every capacity binds."""
    lengths = np.random.default_rng(1).integers(1, 60, 150)
    caps = best_fit.Capacities(100, 4, 4200, (1.0, 0.5, 0.7))
    bins, offsets = best_fit.vector_best_fit(lengths, caps, score)
    limit = np.array([100, 4, 4200.0])
    open_, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = np.array([lengths[i], 1, lengths[i] ** 2], float)
        fit = [b for b in open_ if (b["left"] >= need).all()]
        w = np.array(caps.weights)
        value = (lambda b: -(w * (b["left"] - need) / limit * need / limit).sum()) if score == "dot" else (lambda b: (w * ((b["left"] - need) / limit) ** 2).sum())  # noqa: B023
        best = min(fit, key=value, default=None)
        if best is None:
            best = {"left": limit.copy(), "name": len(open_)}
            open_.append(best)
        want[i] = (best["name"], value(best))
        best["left"] -= need
    assert len(set(bins)) <= len(open_) + 1 and (offsets >= 0).all()
    first = [i for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))][:40]
    assert [int(bins[i]) for i in first] == [want[i][0] for i in first]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(score):
    lengths = np.random.default_rng(0).integers(1, 100, 400)
    caps = best_fit.Capacities(100, 3, 6000, (1.0, 0.1, 0.1))
    bins, _ = best_fit.vector_best_fit(lengths, caps, score)
    f = pd.DataFrame({"b": bins, "n": lengths, "c": lengths**2}).groupby("b").agg(n=("n", "sum"), k=("n", "size"), c=("c", "sum"))
    alone = f.k == 1
    assert (f.n <= 100).all() and (f.k <= 3).all() and ((f.c <= 6000) | alone).all()


def test_layouts_become_canonical_turns(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}],"id":3}'),
        (3, '{"instruction":"hi","input":"","output":"yo"}'), (4, '{"prompt":"hi","completion":"yo"}'), (5, '{"question":"hi","answer":"yo"}'),
        (6, '{"what":1}'), (7, None), (8, "{"), (9, '{"turns":[]}'),
        (10, '{"messages":[{"role":"user","content":"hi"},null,"x",[1],{"role":"assistant","content":"yo"}]}'), (11, "[" * 100_000), (12, '{"a":' * 20_000 + "1" + "}" * 20_000),
        (13, '{"messages":[{"role":"user","content":[{"type":"text","text":"h"},{"type":"text","text":"i"},null]},{"role":"assistant","content":[{"text":"yo"}]}]}'),
        (14, '{"data":{"chat":{"prompt":"hi","completion":"yo"}}}'), (15, '{"row":{"turns":[{"role":"user","text":"hi"},{"role":"assistant","text":"yo"}]}}'), (15, '{"messages":7}'),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in records], "id long, r string, formatted string")
    got = chat_format.format_chats(frame, "id", "r").toPandas()
    assert len(got) == len(records) and chat_format.format_chats(frame.limit(0), "id", "r").count() == 0
    assert got[got.id == 15].layout.tolist() == ["turn rows", None]
    got = got[~((got.id == 15) & got.layout.isna())].set_index("id")
    assert got.formatted.loc[[1, 2, 3, 4, 5, 10, 13, 14, 15]].nunique() == 1 and got.layout.loc[[11, 12]].isna().all()
    assert chat_format.parse(got.formatted[1]) == [("user", "hi"), ("assistant", "yo")]
    assert got.layout.loc[[6, 7, 8, 9]].isna().all() and (got.n_turns.loc[[6, 7, 8, 9]] == 0).all()
    assert got.fingerprint[1] != got.fingerprint[2]


def test_template_reads_back_exactly():
    rng = random.Random(2)
    bits = ["\\", "#", "###", "</turn>", " </turn>\n", "</", "<", "/", ": ", "\n", "a", "### user: "]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "a: b", "#"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, spans = chat_format.render(turns)
        assert chat_format.parse(text) == turns
        assert [chat_format.unescape(text[s["start"] : s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]


def naive_ends(text):
    """Cuts of the rolling hash, byte by byte: shift, add, cut after at least 48 bytes at six leading zeros, or at 1024."""
    gear, ends, at, h = [int(x) for x in gear_chunks.gear_table()], [], 0, 0
    for i, byte in enumerate(text):
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        if i + 1 - at >= 48 and h >> 26 == 0 or i + 1 - at == 1024:
            ends.append(i + 1)
            at = i + 1
    return ends if at == len(text) else [*ends, len(text)]


def test_chunk_ends_equal_a_byte_by_byte_hash():
    rng = np.random.default_rng(9)
    for size, letters in ((0, 256), (1, 256), (47, 4), (48, 4), (49, 256), (5000, 256), (5000, 3), (40_000, 26), (3000, 1)):
        text = rng.integers(0, letters, size).astype(np.uint8).tobytes()
        assert gear_chunks.chunk_ends(text, gear_chunks.gear_table()) == naive_ends(text)


def brute_chunks(texts):
    seen, out = set(), []
    for text in texts:
        at, kept = 0, []
        for end in naive_ends(text):
            if text[at:end] not in seen:
                kept.append(text[at:end])
            seen.add(text[at:end])
            at = end
        out.append(b"".join(kept))
    return out


def test_chunk_dedup_keeps_first_places(spark):
    docs = small_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = gear_chunks.chunk_dedup(docs).toPandas().sort_values("doc_id")
    frame = docs.toPandas().sort_values("doc_id")
    want = brute_chunks([(t or "").encode() for t in frame.text])
    assert [bytes(k) for k in got.kept] == want
    assert (got.n_removed == [len((t or "").encode()) - len(w) for t, w in zip(frame.text, want, strict=True)]).all() and got.n_removed.sum() > 0
    assert gear_chunks.chunk_dedup(empty(spark)).count() == 0


def test_chunk_dedup_of_rows_without_ids(spark):
    docs = without_ids(small_docs(spark).dropDuplicates(["text"])).withColumn("tag", F.xxhash64("text"))
    got = gear_chunks.chunk_dedup(docs).toPandas()
    frame = docs.orderBy("doc_id", "tag").toPandas()
    texts = [(t or "").encode() for t in frame.text]
    want = [(len(t), len(t) - len(k), len(gear_chunks.chunk_ends(t, gear_chunks.gear_table())), k) for t, k in zip(texts, brute_chunks(texts), strict=True)]
    assert sorted((r.n_bytes, r.n_removed, r.n_chunks, bytes(r.kept)) for r in got.itertuples()) == sorted(want)


def test_chunks_resist_insertions():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 20_000).astype(np.uint8).tobytes()
    moved = text[:5000] + b"inserted" + text[5000:]
    gear = gear_chunks.gear_table()
    cut = lambda t: {t[a:b] for e in [gear_chunks.chunk_ends(t, gear)] for a, b in zip([0, *e], e, strict=False)}
    assert len(cut(text) - cut(moved)) <= 4


def test_containment_finds_edited_items_in_long_documents(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(10**6)}"
    items, docs, want = [], [], set()
    for i, size in enumerate([1, 2, 4, 5, 6, 9, 12, 16, 17, 30, 60, 200, 700]):
        item = [word() for _ in range(size)]
        items.append((i, " ".join(item).upper()))
        held = list(item)
        if size >= 60:
            held[size // 2] = word()
        docs.append((i, " ".join([word() for _ in range(3000)] + held + [word() for _ in range(500)])))
        want.add((i, i))
    items += [(90, None), (91, " "), (92, items[9][1])]
    want.add((9, 92))
    docs += [(50, " ".join(word() for _ in range(400))), (51, None), (52, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for blocks in ({}, {"block_items": 4}):
        got = containment.contained_items(d, b, **blocks).toPandas()
        assert set(zip(got.doc_id, got.item_id, strict=True)) == want
        assert {r.doc_id for r in containment.decontaminated(d, b, **blocks).collect()} == {50, 51, 52}
    assert containment.contained_items(empty(spark), b).count() == 0 and containment.contained_items(d, b.limit(0)).count() == 0


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(5)
    for _ in range(60):
        texts = [[int(x) for x in rng.integers(1, rng.integers(2, 5) + 1, rng.integers(0, 40))] + [0] for _ in range(15)]
        texts += [[1] * 20 + [0], [1, 2] * 12 + [0], [2, 1, 1] * 9 + [0]]
        length = np.array([len(t) for t in texts])
        base = np.cumsum(length) - length
        order = suffix_grouping.suffix_arrays(np.concatenate([np.array(t) for t in texts]), base, length)
        for t, b, n in zip(texts, base, length, strict=True):
            assert (order[b : b + n] - b).tolist() == sorted(range(n), key=lambda i: t[i:])
    long_ = [int(x) for x in rng.integers(1, 4, 5000)] + [0]
    assert suffix_grouping.suffix_arrays(np.array(long_), np.array([0]), np.array([5001])).tolist() == sorted(range(5001), key=lambda i: long_[i:])


def brute_repeats(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                cover[i] += 1
                cover[i + width] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("group_bytes,batch_bytes", [(24_000_000, 1_000_000), (24_000_000, 400), (1500, 1_000_000), (1000, 300)])
def test_suffix_dedup_equals_brute_force(spark, group_bytes, batch_bytes):
    docs = small_docs(spark)
    got = suffix_dedup.suffix_dedup(docs, group_bytes=group_bytes, batch_bytes=batch_bytes).collect()
    want = brute_repeats([(t or "").encode() for t in docs.toPandas().text], 200)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("group_bytes,batch_bytes", [(24_000_000, 1_000_000), (24_000_000, 400), (1500, 1_000_000), (1000, 300)])
def test_suffix_dedup_of_rows_without_ids(spark, group_bytes, batch_bytes):
    docs = without_ids(small_docs(spark))
    docs = docs.unionByName(docs.where("doc_id is null and length(text) > 200").limit(3))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = suffix_dedup.suffix_dedup(docs, group_bytes=group_bytes, batch_bytes=batch_bytes).collect()
    want = brute_repeats([(t or "").encode() for t in docs.toPandas().text], 200)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    plain = docs.where("text is not null and text rlike '^[ -~\\\\n]*$'")
    want = brute_repeats([t.encode() for t in plain.toPandas().text], 200)
    assert sorted(r.text for r in suffix_dedup.without_repeats(plain).collect()) == sorted(w[3].decode() for w in want)


def test_texts_without_repeats_keep_rows_and_columns(spark):
    docs = small_docs(spark)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_main_text_drops_templates():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site head</header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">We use cookies a lot here</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>  text.<br>More<p>Second&nbsp;one</p><div class="ad">Buy it now please</div></article>
    <aside>Other stories for you</aside><section class="comments"><p>I disagree with this a lot indeed</p></section><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line\nFirst bold text. More\nSecond one"
    assert html_extract.main_text("") == "" and html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("just words & more") == "just words & more"


@pytest.mark.parametrize("around", [
    "<body class='has-sidebar'><div class='content no-sidebar'>%s</div></body>", "<body class='sidebar search'><div id='page-header widget'>%s</div></body>",
    "<body><article><div class='entry-content share-enabled'>%s</div></article></body>", "<body><article class='post legal'><div class='entry share'>%s</div></article></body>",
    "<head><title>T</title><body class='nav-menu'><div class='side'>%s</div>",
])
def test_wrappers_with_marked_names_keep_their_text(around):
    paragraphs = [f"Paragraph {i} of the text has some words of its own." for i in range(8)]
    body = "<nav class='menu'><a href=x>Home</a> <a href=y>News</a></nav>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class='ad'>Buy it now please</div>"
    assert html_extract.main_text(f"<html>{around % body}</html>") == "\n".join(paragraphs)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", "")], pages.schema)
    got = html_extract.extract_main_text(pages.unionByName(odd)).toPandas().set_index("page_id")
    assert got.text[-1] == "" and got.n_chars[-2] == 0 and len(got) == pages.count() + 2
    for r in pages.limit(30).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer)", r.html, re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert got.text[r.page_id] == "\n".join(b for b in blocks if b)
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_network_learns_and_scores_whole_texts():
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "sun", "rose", "over", "hills"]) for _ in range(rng.randint(3, 60))).encode() for _ in range(120)]
    bad = [b" ".join(w + b"$$$" for w in g.split()) for g in good]
    net = byte_cnn.fit(good + bad, np.array([1] * 120 + [0] * 120), epochs=10)
    assert (byte_cnn.score(net, good) > 0.5).mean() > 0.95 and (byte_cnn.score(net, bad) < 0.5).mean() > 0.95
    late = b" ".join(good) + bad[0]
    assert byte_cnn.score(net, [late])[0] < byte_cnn.score(net, [b" ".join(good)])[0], "junk at the end of a long text counts"
    assert np.allclose(byte_cnn.score(net, [late]), byte_cnn.score_long(net, late, 16))
    assert 0 <= byte_cnn.score(net, [b""])[0] <= 1
    assert byte_cnn.fit([], np.array([])) and byte_cnn.fit([b"a"], np.array([1]))


def test_pooled_equals_a_sliding_convolution():
    net, rng = byte_cnn.new_network(3), np.random.default_rng(4)
    net.bias[:] = rng.normal(size=len(net.bias))
    texts = [b"", b"a", bytes(rng.integers(0, 256, 700).astype(np.uint8)), b"over and over again " * 40]
    _, best = byte_cnn.pooled(net, *byte_cnn.blocks(texts))
    for text, got in zip(texts, best, strict=True):
        n = max(1, -(-len(text) // byte_cnn.BLOCK))
        codes = np.full((n + 1) * byte_cnn.BLOCK, 256)
        codes[: len(text)] = np.frombuffer(text, np.uint8)
        again = np.zeros(len(codes), np.float32)
        for i in range(7, len(text)):
            again[i] = any(i - 7 - lag >= 0 and text[i - 7 : i + 1] == text[i - 7 - lag : i + 1 - lag] for lag in byte_cnn.LAGS) if len(text) > 10 else 0
        want = np.full(len(got), 0.0)
        for k in range(n):
            total = net.bias.astype(float).copy()
            for side in (0, 1):
                if side and k == n - 1:
                    continue
                for j in range(byte_cnn.BLOCK):
                    at = (k + side) * byte_cnn.BLOCK + j
                    total += net.embed[codes[at]] @ net.kernel[side][j * byte_cnn.EMBEDDING : (j + 1) * byte_cnn.EMBEDDING] + again[at] * net.repeat[side][j]
            want = np.maximum(want, total)
        assert np.allclose(got, want, atol=1e-3)


def test_classifiers_take_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(i, t, None, None) for i, t in enumerate([None, "", "the sun", "you idiot " * 50_000, "the sun"])] + [(2, "the sun", None, None), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, c0 string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(2, None, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0), labels.where("quality = 1")):
        net, model = byte_cnn.train_quality(docs, own), toxicity.train_toxicity(docs, own)
        for scored in (byte_cnn.quality_scores(docs, net), toxicity.toxicity_scores(docs, model)):
            got = scored.toPandas()
            assert len(got) == len(rows) and got.score.between(0, 1).all() and got[got.doc_id == 2].score.nunique() == 1
        wide = byte_cnn.with_quality(docs, net, "q")
        assert wide.columns == [*docs.columns, "q"] and wide.where("text is null").count() == 1
        assert byte_cnn.quality_scores(docs.limit(0), net).count() == 0 and toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_isotonic_pools_ties_and_equals_brute_force():
    for labels in ([0, 0, 0, 1], [1, 0, 0, 0], [0, 1, 0, 0]):
        knots, values = toxicity.isotonic(np.ones(4), np.array(labels))
        assert len(knots) == 1 and np.isclose(values[0], 1.05 / 4.5)
    rng = np.random.default_rng(11)
    for _ in range(50):
        raw, y = rng.integers(0, 12, 40).astype(float), rng.integers(0, 2, 40)
        knots, values = toxicity.isotonic(raw, y)
        mean = lambda a, b: y[(raw >= a) & (raw <= b)].mean() if ((raw >= a) & (raw <= b)).any() else None  # noqa: B023, E731
        seen = np.unique(raw)
        fit = {x: max(min(m for b in seen if b >= x and (m := mean(a, b)) is not None) for a in seen if a <= x) for x in seen}  # max-min formula
        rows = {v: sum(raw == x for x in seen if fit[x] == v).sum() for v in set(fit.values())}
        assert np.allclose(values, np.maximum.accumulate([(v * rows[v] + 0.05) / (rows[v] + 0.5) for v in sorted(rows)]))
        assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()


def test_trees_equal_row_by_row_descent_and_lower_the_loss():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)
    model = toxicity.fit_trees(x, y, rounds=30)
    for i in range(0, 400, 37):
        want = model.base
        for feature, cut, leaf in model.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[i, feature[node]] > cut[node] else 1)
            want += leaf[node - len(feature)]
        assert np.isclose(model.raw(x)[i], want)
    loss = lambda m: np.mean(np.log1p(np.exp(-(2 * y - 1) * m.raw(x))))
    assert loss(model) < 0.25 < loss(toxicity.fit_trees(x, y, rounds=1)) + 0.25
    stump = toxicity.fit_trees(x[:, :1], (x[:, 0] > 0.2).astype(int), rounds=1, depth=1, ridge=0.0, bins=400)
    assert abs(stump.trees[0][1][0] - 0.2) < 0.05, "the first cut is the one that brute force finds"


def held_out_accuracy(spark, name, label, fold, share):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % fold[0] == fold[1] for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m[label]).mean() >= share


def test_quality_held_out(spark):
    held_out_accuracy(spark, "op8_byte_cnn", "quality", byte_cnn.FOLD, 0.93)


def test_toxicity_held_out(spark):
    held_out_accuracy(spark, "op10_toxicity", "toxic", toxicity.FOLD, 0.9)


def test_toxicity_sees_obfuscation_and_empty_texts():
    rng = random.Random(7)
    clean = [" ".join(rng.choice(["the", "sun", "rose", "you", "hills"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    toxic = [c + " you idiot" for c in clean[:80]]
    model = toxicity.fit(clean + toxic, np.array([0] * 200 + [1] * 80))
    tokens = toxicity.Tokens(model.lexicon)
    s = model.score(["the sun", "you idiot", "you 1d1ot", "", "i.d.i.o.t you"], tokens)
    assert s[0] < 0.3 <= s[1] and s[3] < 0.3 and ((0 <= s) & (s <= 1)).all()
    assert toxicity.features("you 1d1ot", tokens)[18] > 0 and toxicity.features("i.d.i.o.t", tokens)[18] > 0
    assert (toxicity.fit(["a"], np.array([0])).score(["b"], toxicity.Tokens({})) == 0).all()


def brute_links(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [[bool(a and b and 100 * len(a & b) >= percent * len(a | b)) for b in sets] for a in sets]
    return sets, links


@pytest.mark.parametrize("k,percent,block", [(4, 85, 2048), (5, 80, 2048), (4, 85, 3)])
def test_jaccard_join_equals_brute_force(spark, k, percent, block):
    docs = small_docs(spark).where("doc_id is not null")
    got = jaccard_join.ngram_jaccard_join(docs, k, percent, block_sets=block).toPandas().sort_values(["doc_id"]).reset_index(drop=True)
    frame = docs.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    sets, links = brute_links(frame.text, k, percent)
    ids = frame.doc_id.tolist()
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(len(ids)):
                if links[a][b] and label[b] > label[a]:
                    label[b], changed = label[a], True
    lowest = {x: min(ids[i] for i in range(len(ids)) if label[i] == x) for x in set(label)}
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == [lowest[x] for x in label]
    assert got.n_links.tolist() == [max(sum(row) - bool(row[i]), 0) for i, row in enumerate(links)]
    assert jaccard_join.ngram_jaccard_join(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_join_of_rows_without_ids(spark, block):
    base = [f"b{i}" for i in range(60)]
    chain = [" ".join([f"c{j}" for j in range(i * 4)] + base[i * 4 :]) for i in range(6)]  # neighbours link, others do not
    docs = without_ids(small_docs(spark)).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900, chain[0]), (None, chain[1]), (None, chain[1]), (901, chain[2]), (None, chain[4]), (None, chain[5])], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, jaccard_join.ngram_jaccard_join(docs, 4, 85, block_sets=block).collect())))
    sets, links = brute_links([t for _, t in rows], 4, 85)
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if links[a][b] and label[b] > label[a]:
                    label[b] = label[a]
    lowest = {x: min((i for (i, _), y in zip(rows, label, strict=True) if y == x and i is not None), default=None) for x in set(label)}
    want = [(i, len(s), lowest[x], max(sum(own) - bool(own[at]), 0)) for at, ((i, _), s, x, own) in enumerate(zip(rows, sets, label, links, strict=True))]
    assert links[len(rows) - 6][len(rows) - 5] and not links[len(rows) - 6][len(rows) - 3]
    assert got == sorted(map(str, want))


def test_parity_bits_never_part_linked_sets():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.97], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 15)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            x, y = jaccard_join.parity_bits(a), jaccard_join.parity_bits(b)
            assert jaccard_join.may_link(int.from_bytes(x, "little"), 8 * len(x), len(a), int.from_bytes(y, "little"), 8 * len(y), len(b), 85)


def test_components_of_a_path_a_hub_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (7, 7), (None, 3), (1, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1 and got[500] == 500 and len(got) == 102
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digests_use_the_shared_folder(spark):
    assert common.shared_dir(spark)
    t = common.staged(spark.range(3), "t")
    assert t.count() == 3
    common.unstage(t)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def words_of(a, n):
    return " ".join(f"{a}{i}" for i in range(n))


def paragraphs_of(a, n):
    return "".join(f"<p>{words_of(f'{a}{i}x', 10)}</p>" for i in range(n // 10))


@pytest.mark.parametrize("page,wanted,unwanted", [
    ('<div class="content">%c50</div><div class="sidebar">%s60</div>', "c", "s"),
    ('<div class="content">%c50</div><div class="sidebar">%s500</div>', "c", "s"),
    ('<article>%c50<div class="promo">%s60</div></article>', "c", "s"),
    ('<article>%c50</article><section class="discussion">%s80</section>', "c", "s"),
    ('<div class="post">%c50</div><div id="usercomments">%s80</div>', "c", "s"),
    ('<article><div class="banner">%c50</div><div class="notice">%d60</div></article>', "cd", ""),
    ('<form id="aspnetForm"><nav>%s20</nav><div>%c50</div><div class="ad">%t20</div></form>', "c", "st"),
    ('<form id="aspnetForm">%c50</form>', "c", ""),
    ('<article class="commentary">%c50</article>', "c", ""),
    ('<div class="side">%c50<div class="share">%s20</div></div><footer>%t10</footer>', "c", "st"),
])
def test_marked_elements_are_left_out_unless_they_wrap_the_content(page, wanted, unwanted):
    made = re.sub(r"%([a-z])(\d+)", lambda m: paragraphs_of(m[1], int(m[2])), page)
    got = html_extract.main_text(f"<html><body>{made}</body></html>")
    for m in re.finditer(r"%([a-z])(\d+)", page):
        assert (f"{m[1]}0x0" in got, f"{m[1]}{int(m[2]) // 10 - 1}x9" in got) == ((m[1] in wanted,) * 2)
    assert not set(unwanted) & {w[0] for w in got.split()}


def test_a_main_of_links_keeps_them():
    links = "".join(f"<li><a href=x>{words_of(f'l{i}x', 3)}</a></li>" for i in range(12))
    got = html_extract.main_text(f"<body><nav><a href=y>menu</a></nav><main><h1>All of them</h1><ul>{links}</ul></main></body>")
    assert got.split("\n") == ["All of them", *(words_of(f"l{i}x", 3) for i in range(12))]


def test_long_unclosed_and_deeply_nested_pages(spark):
    deep = "<div>" * 3000 + "deep words stand here" + "</div>" * 3000
    unclosed = "<body><nav>menu<article><p>" + words_of("u", 60)
    long_ = "<article>" + paragraphs_of("v", 30_000) + "</article>"
    rows = [(1, "a", deep), (2, "b", unclosed), (3, "c", long_), (3, "c", long_), (None, None, "<p>no id</p>")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_main_text(pages).collect()
    assert Counter(r.page_id for r in got) == Counter([1, 2, 3, 3, None])
    by = {r.page_id: r for r in got}
    assert by[1].text == "deep words stand here" and by[2].text == words_of("u", 60) and len(by[3].text.split()) == 30_000 and by[None].text == "no id"
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("record,wanted", [
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "image", "url": "u"}, {"type": "text", "text": " there"}]}, {"role": "assistant", "content": "plain"}]}, [("user", "hi there"), ("assistant", "plain")]),
    ({"messages": [{"role": "user", "content": {"text": "hi"}}, {"role": "assistant", "content": {"text": "ho"}}]}, [("user", "hi"), ("assistant", "ho")]),
    ({"messages": [{"role": "user", "content": {"text": "hi"}}, {"role": "assistant", "content": ["a", {"text": "b"}, 3]}, {"role": "user", "content": None}]}, [("user", "hi"), ("assistant", "ab3"), ("user", "")]),
    ({"prompt": 12, "completion": True}, [("user", "12"), ("assistant", "true")]),
])
def test_mixed_contents_become_text_item_by_item(record, wanted):
    assert chat_format.canonical_turns(record, chat_format.select_mapping(chat_format.field_paths(record))) == wanted

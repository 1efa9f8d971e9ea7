"""Suffix-array dedup: removes every byte that a repeated string of WIDTH bytes covers.

Each string of WIDTH bytes is named by its minimizer, the 32 bytes of least hash inside it, so equal strings share a name
at the same place. Runs of neighbouring strings of one minimizer form a context. Contexts that stand more than once repeat
as a whole. Where different contexts share a minimizer, their texts meet in one task, each cut down to the longest part
that another one has around the minimizer; where these parts differ, a suffix array, built by grouping (suffix_grouping),
brings equal strings side by side. A group that is too large for that is split: strings with like many bytes before the
minimizer, in four ranges, and by the bytes that all strings of such a range share; split groups go on like others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .gear_chunks import beside, cut_spans, tagged
from .suffix_grouping import suffix_arrays

WIDTH, GRAM = 200, 32
#: Bytes of texts whose suffixes are ordered at once; a task takes about a hundred times as much memory. Larger groups are split in the task.
BATCH_BYTES = 500_000
#: Bytes of contexts of one group that a task holds, at most. Larger groups are split row by row, and their parts meet in another round.
GROUP_BYTES = 6_000_000
_PART = 1 << 22
_TOP = np.uint64(0xFFFFFF)


def _table() -> np.ndarray:
    return common.mixed(np.arange(1, 257, dtype=np.uint64))


def contexts(raw: np.ndarray, table: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, its place, first start and last start of the contexts of at least `width` and at most 2 ** 24 bytes."""
    h = table[raw]
    for span in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint64(span)
        h = longer
    v = common.mixed(h[GRAM - 1 :])
    n, w = len(v), width - GRAM + 1
    key = (v & ~_TOP) | np.arange(n, dtype=np.uint64)  # least hash, then leftmost
    rows = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    rows[:n] = key
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & _TOP).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return v[place[first]], place[first], first, np.append(first[1:], len(place)) - 1


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans in order of their starts."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


_ANCHOR = "name long, digest long, doc_id long, tag long, start long, end long, mark int"


def _anchors(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each different context of a document; mark: twice the minimizer's place in it, and 1 more if it stands there
    more than once. Rows without a name are spans to remove."""
    table = _table()
    for part in common.slices(batches):
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for d, x in enumerate(part.column("text").cast(pa.binary())):
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            name, place, first, last = [], [], [], []
            for a in range(0, max(len(text) - width + 1, 0), _PART):
                raw = np.frombuffer(text, np.uint8, min(_PART + width - 1, len(text) - a), a)
                m, p, f, z = contexts(raw, table, width)
                name.append(m)
                place.append(p - f)
                first.append(f + a)
                last.append(z + a)
            if not name:
                continue
            name, place, first, end = np.concatenate(name), np.concatenate(place), np.concatenate(first), np.concatenate(last) + width
            digest = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.uint64, len(first))
            _, index, inverse, counts = np.unique(name ^ common.mixed(digest), return_index=True, return_inverse=True, return_counts=True)
            again = counts[inverse] > 1
            if again.any():
                s, e = _merged(first[again], end[again])
                for column, value in zip(out, (np.full(len(s), d), np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64), s, e, np.full(len(s), -1)), strict=True):
                    column.append(value)
            for column, value in zip(out, (np.full(len(index), d), name[index], digest[index], first[index], end[index], 2 * place[index] + (counts > 1)), strict=True):
                column.append(value)
        if out[0]:
            row, name, digest, start, end, mark = (np.concatenate(x) for x in out)
            row, span = pa.array(row), mark == -1
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64), mask=span), pa.array(digest.view(np.int64), mask=span), part.column("doc_id").take(row), part.column("tag").take(row),
                 pa.array(start), pa.array(end), pa.array(mark.astype(np.int32), mask=span)],
                ["name", "digest", "doc_id", "tag", "start", "end", "mark"],
            )


def _runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _same(batches: Iterable[pa.RecordBatch], least: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Anchors in order of (name, digest) -> contexts that repeat as a whole, as spans without a name, and one row for each
    different context of names that have several. A name with a single context that stands once gives nothing."""
    names = ["name", "digest", "doc_id", "tag", "start", "end", "mark"]
    held: list[pa.RecordBatch] = []
    several = None  # a name that is known to have several contexts

    def settle(table: pa.Table, final: bool) -> tuple[Iterator[pa.RecordBatch], list[pa.RecordBatch]]:
        nonlocal several
        name, digest = (table.column(c).to_numpy() for c in ("name", "digest"))
        n = len(name)
        if not final:
            whole = int(np.searchsorted(np.cumsum(_runs(name)), np.cumsum(_runs(name))[-1], "left"))  # where the last name begins
            if whole == 0 and n > least:  # one name fills the rows: all its contexts but the last are complete
                starts = np.flatnonzero(_runs(digest))
                whole = int(starts[-1])
                if whole == 0:  # one context: it repeats; one row is enough to go on with
                    out = table.slice(1).select(names[2:6])
                    rest = table.slice(0, 1)
                    rest = rest.set_column(6, "mark", pa.array([rest.column("mark")[0].as_py() | 1], pa.int32()))
                    return _spans(out), rest.to_batches()
                several, last = name[0], table.slice(whole)
                return _split(table.slice(0, whole), {several}), last.to_batches()
            if whole == 0:
                return iter(()), table.to_batches()
            return _split(table.slice(0, whole), {several}), table.slice(whole).to_batches()
        return _split(table, {several}), []

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            out, held = settle(pa.Table.from_batches(held).combine_chunks(), False)
            yield from out
    if held:
        yield from settle(pa.Table.from_batches(held).combine_chunks(), True)[0]


def _spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    full = pa.table({"name": pa.nulls(n, pa.int64()), **{c: table.column(c) for c in ("doc_id", "tag", "start", "end")}, "mark": pa.nulls(n, pa.int32())})
    yield from full.to_batches(max_chunksize=50_000)


def _split(table: pa.Table, several: set) -> Iterator[pa.RecordBatch]:
    name, digest, mark = (table.column(c).to_numpy() for c in ("name", "digest", "mark"))
    new_name, new = _runs(name), _runs(name, digest)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(name)))
    repeated = (counts > 1) | (mark[starts] & 1 == 1)
    of_name = np.cumsum(new_name[starts]) - 1
    per_name = np.bincount(of_name)
    mixed = (per_name[of_name] > 1) | np.isin(name[starts], [x for x in several if x is not None])
    yield from _spans(table.filter(pa.array(np.repeat(repeated, counts))))
    chosen = table.take(pa.array(starts[mixed]))
    yield from pa.table({
        "name": chosen.column("name"), **{c: chosen.column(c) for c in ("doc_id", "tag", "start", "end")}, "mark": pa.array(mark[starts[mixed]] | repeated[mixed], pa.int32()),
    }).to_batches(max_chunksize=50_000)


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text, wanted) -> the contexts with their bytes. Of equal rows without doc_id one a task is enough: their marks tell of the others."""
    told: set[int] = set()
    for part in common.slices(batches):
        rows = []
        for d, (x, wanted, own, tag) in enumerate(zip(part.column("text").cast(pa.binary()), *(part.column(c).to_pylist() for c in ("wanted", "doc_id", "tag")), strict=True)):
            if own is None:
                if tag in told:
                    continue
                told.add(tag)
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            rows += [(d, w["name"], w["start"], w["mark"], text[w["start"] : w["end"]]) for w in wanted]
        if rows:
            d, name, start, mark, raw = zip(*rows, strict=True)
            d = pa.array(d, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.int64()), part.column("doc_id").take(d), part.column("tag").take(d), pa.array(start, pa.int64()), pa.array(mark, pa.int32()), pa.array(raw, pa.binary())],
                ["name", "doc_id", "tag", "start", "mark", "raw"],
            )


def repeated_starts(groups: list[list[tuple[bytes, bool]]], width: int) -> list[list[np.ndarray]]:
    """For each context of each group: starts of its strings of `width` bytes that stand elsewhere in the group, or that it says stand elsewhere."""
    symbols, starts, lengths = [], [], []  # a group's text: its contexts, 1 after each, 0 at the end
    where, who, base = [], [], 0
    n_contexts = 0
    for group in groups:
        begin = base
        for raw, _ in group:
            symbols.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 2)
            symbols.append(np.array([1]))
            where.append(np.arange(base, base + len(raw) - width + 1))
            who.append(np.full(len(raw) - width + 1, n_contexts))
            base += len(raw) + 1
            n_contexts += 1
        symbols[-1] = np.array([0])
        starts.append(begin)
        lengths.append(base - begin)
    text = np.concatenate(symbols)
    where, who = np.concatenate(where), np.concatenate(who)
    order = suffix_arrays(text, np.array(starts), np.array(lengths))
    of = np.full(len(text), -1)
    of[where] = who
    order = order[of[order] >= 0]  # the starts of whole strings, in order: equal strings lie side by side
    shift = (text.astype(np.uint8)).astype(np.uint64)  # only to compare: 0 and 1 do not stand inside strings
    eight = np.zeros(len(text) + 8, np.uint64)
    for k in range(8):
        eight[: len(text) - k] |= shift[k:] << np.uint64(8 * k)
    a, b = order[:-1], order[1:]
    text_of = np.repeat(np.arange(len(starts)), lengths)
    alike = np.flatnonzero(text_of[a] == text_of[b])
    for k in [*range(0, width - 7, 8), width - 8]:
        alike = alike[eight[a[alike] + k] == eight[b[alike] + k]]
    hit = np.zeros(len(text), bool)
    hit[a[alike]] = hit[b[alike]] = True
    many = np.array([m for group in groups for _, m in group])
    hit[where] |= many[who]
    cut = np.searchsorted(who, np.arange(n_contexts + 1))
    every = [np.flatnonzero(hit[where[x:y]]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    sizes = np.cumsum([0] + [len(g) for g in groups])
    return [every[x:y] for x, y in zip(sizes[:-1], sizes[1:], strict=True)]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _reach(parts: list[bytes]) -> list[int]:
    """For each text the longest prefix that it shares with another one: with a neighbour in their order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out, last = [0] * len(parts), 0
    for i, j in zip(order, order[1:] + [-1], strict=True):
        ahead = _common(parts[i], parts[j]) if j >= 0 else 0
        out[i], last = max(last, ahead), ahead
    return out


def shared_parts(group: list[tuple], width: int) -> tuple[list[tuple[bytes, bool, int]], list[list[tuple]]]:
    """Contexts of one minimizer, (places, mark, raw), cut down to what they can share around it. A place: (doc, tag, start).

    -> different parts of at least `width` bytes, with whether they stand more than once and their bytes before the minimizer,
    and by part its places. Equal strings lie alike around their minimizer, so no shared string reaches beyond a part.
    """
    at = [mark >> 1 for _, mark, _ in group]
    right = _reach([c[2][a:] for c, a in zip(group, at, strict=True)])
    left = _reach([c[2][:a][::-1] for c, a in zip(group, at, strict=True)])
    parts: dict[tuple[bytes, int], list[tuple]] = {}
    again: dict[tuple[bytes, int], int] = {}
    for (places, mark, raw), a, r, n in zip(group, at, right, left, strict=True):
        if len(places) > 1 or len(group) == 1:  # all of it stands more than once, whatever others share with it
            r, n = len(raw) - a, a
        if n + r >= width:
            key = (raw[a - n : a + r], n)
            parts.setdefault(key, []).extend((doc, tag, start + a - n) for doc, tag, start in places)
            again[key] = again.get(key, 0) + len(places) + (mark & 1)
    return [(key[0], again[key] > 1, key[1]) for key in parts], list(parts.values())


def ranges(low: int, high: int) -> list[tuple[int, int]]:
    """Four ranges, as even as can be, or fewer where there are fewer numbers."""
    cuts = sorted({low + (high - low + 1) * i // 4 for i in range(5)})
    return [(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def split(raw: bytes, at: int, low: int, high: int, width: int) -> Iterator[tuple[int, int, bytes, int, bytes, int]]:
    """A context around the minimizer at `at`, whose strings have low to high bytes before it -> by range of these: the range,
    the bytes that all its strings share, and the part that its strings cover: its start, bytes, and bytes before the minimizer."""
    for a, b in ranges(low, high):
        least, most = max(a, at + width - len(raw)), min(b, at)
        if least <= most:
            yield a, b, raw[at - a : at - b + width], at - most, raw[at - most : at - least + width], most


_PART_ROW = "name long, low int, high int, doc_id long, tag long, start long, end long, mark int, raw binary"


def _resolve(batches: Iterable[pa.RecordBatch], width: int, group_bytes: int, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Contexts (_PART_ROW) in order of their names -> spans to remove, without a name, and the parts of groups beyond group_bytes."""
    ready: list[tuple[list, list]] = []
    size = 0
    spans: list[tuple] = []
    parts: list[tuple] = []

    def rows(full: bool) -> Iterator[pa.RecordBatch]:
        """What has been found so far, if that is enough for a batch or at the end."""
        nonlocal spans, parts
        if len(spans) >= 50_000 or spans and full:
            doc, tag, start, end = zip(*spans, strict=True)
            none = pa.nulls(len(doc))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), *(pa.array(x, pa.int64()) for x in (doc, tag, start, end)), none.cast(pa.int32()), none.cast(pa.binary())], _NAMES
            )
            spans = []
        if len(parts) >= 10_000 or parts and full:
            name, low, high, doc, tag, start, mark, raw = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), *(pa.array(x, pa.int64()) for x in (doc, tag, start)), pa.nulls(len(doc), pa.int64()),
                 pa.array(mark, pa.int32()), pa.array(raw, pa.binary())], _NAMES
            )
            parts = []

    def ordered() -> Iterator[pa.RecordBatch]:
        nonlocal ready, size
        if ready:
            for (_, members), hits in zip(ready, repeated_starts([[(t, many) for t, many, _ in texts] for texts, _ in ready], width), strict=True):
                for places, own in zip(members, hits, strict=True):
                    if len(own):
                        found = list(zip(*(x.tolist() for x in _merged(own, own + width)), strict=True))
                        spans.extend((doc, tag, start + a, start + b) for doc, tag, start in places for a, b in found)
                        yield from rows(False)
        ready, size = [], 0

    def take(group: list[tuple], low: int, high: int) -> Iterator[pa.RecordBatch]:
        nonlocal size
        texts, members = shared_parts(group, width)
        total = sum(len(t) for t, _, _ in texts)
        if total > batch_bytes and low < high:
            smaller: dict[tuple[int, int, bytes], list[tuple]] = {}
            for (text, many, at), places in zip(texts, members, strict=True):
                for a, b, core, start, raw, before in split(text, at, low, high, width):
                    own = ([(doc, tag, s + start) for doc, tag, s in places], 2 * before + (many and len(places) == 1), raw)
                    smaller.setdefault((a, b, core), []).append(own)
            for (a, b, _), own in smaller.items():
                if len(own) > 1 or len(own[0][0]) > 1 or own[0][1] & 1:
                    yield from take(own, a, b)
            return
        if len(texts) == 1 and texts[0][1]:  # all cut down to one part: two copies of it are ordered
            texts, members, total = [(texts[0][0], False, texts[0][2])] * 2, [members[0], []], 2 * total
        if len(texts) > 1:
            ready.append((texts, members))
            size += total
            if size >= batch_bytes:
                yield from ordered()

    name, group, held, hot = None, [], 0, False
    low = high = 0
    alike: dict[bytes, list[tuple]] = {}  # of a hot group of single strings: the first place of each string, until a second one comes

    def out(context: tuple) -> None:
        """A context of a hot group, in parts."""
        ((doc, tag, start),), mark, raw = context
        if low == high:  # the group's strings are equal, but for names that clash
            first = alike.get(raw)
            found = [] if first is None and not mark & 1 else [(doc, tag, start)]
            alike[raw] = [] if found or first is not None else [(doc, tag, start)]
            spans.extend((d, t, s, s + width) for d, t, s in [*(first or ()), *found])
            return
        for a, b, core, at, part, before in split(raw, mark >> 1, low, high, width):
            parts.append((xxhash.xxh3_64_intdigest(core, seed=(name * 1024 + a) & (1 << 64) - 1) - (1 << 63), a, b, doc, tag, start + at, 2 * before + (mark & 1), part))

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("name", "low", "high", "doc_id", "tag", "start", "mark", "raw"))
        for n, a, b, doc, tag, start, mark, raw in zip(*columns, strict=True):
            if n != name:
                if group:
                    yield from take(group, low, high)
                name, low, high, group, held, hot, alike = n, a, b, [], 0, False, {}
            context = ([(doc, tag, start)], mark, raw)
            if hot:
                out(context)
                yield from rows(False)
                continue
            group.append(context)
            held += len(raw)
            if held > group_bytes:
                hot = True
                for c in group:
                    out(c)
                group = []
                yield from rows(False)
    if group:
        yield from take(group, low, high)
    yield from ordered()
    yield from rows(True)


_NAMES = ["name", "low", "high", "doc_id", "tag", "start", "end", "mark", "raw"]


def repeated_spans(rows: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """rows(doc_id, tag, text) -> doc_id, tag and the spans of bytes that repeated strings cover, in a list for each document."""
    anchors = rows.mapInArrow(lambda b: _anchors(b, width), _ANCHOR)
    ordered = anchors.repartition("name", F.when(F.col("name").isNull(), F.xxhash64("doc_id", "tag"))).sortWithinPartitions("name", "digest")
    settled = common.staged(ordered.mapInArrow(_named, "name long, doc_id long, tag long, start long, end long, mark int"), "contexts")
    some = settled.where("name is not null")
    wanted = common.staged(some.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("name", "start", "end", "mark")).alias("wanted")), "wanted")
    left = beside(rows, common.small(wanted, "wanted")).select("doc_id", "tag", "text", "wanted").mapInArrow(_fetch, "name long, doc_id long, tag long, start long, mark int, raw binary")
    left = left.select("name", F.lit(0).alias("low"), F.lit(width - GRAM).alias("high"), "doc_id", "tag", "start", "mark", "raw")
    place = ["doc_id", "tag", "start", "end"]
    spans = settled.where("name is null").select(*place)
    while left is not None:  # a round more for each time that a group has to be split, at most five in all
        in_order = left.repartition("name").sortWithinPartitions("name")
        found = common.staged(in_order.mapInArrow(lambda b: _resolve(b, width, group_bytes, batch_bytes), _PART_ROW), "spans")
        spans = spans.unionByName(found.where("name is null").select(*place))
        left = found.where("name is not null").select("name", "low", "high", "doc_id", "tag", "start", "mark", "raw")
        if left.isEmpty():
            left = None
    common.unstage(wanted)
    listed = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return listed.mapInArrow(_united, "doc_id long, tag long, spans array<struct<start:long,end:long>>")


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's list of spans as few spans that neither overlap nor touch."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            own = sorted((s["start"], s["end"]) for s in spans)
            start, end = _merged(np.array([a for a, _ in own]), np.array([b for _, b in own]))
            out.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(out, kind)], ["doc_id", "tag", "spans"])


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_same() on rows with a name; the spans pass."""

    def named() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.filter(batch.column("name").is_null())
            if plain.num_rows:
                spans.extend(_spans(pa.Table.from_batches([plain])))
            rest = batch.filter(batch.column("name").is_valid())
            if rest.num_rows:
                yield rest
            else:
                yield rest.slice(0, 0)

    spans: list[pa.RecordBatch] = []
    for out in _same(b for b in named() if b.num_rows):
        yield out
        while spans:
            yield spans.pop()
    yield from spans


def suffix_dedup(docs: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (bytes): a row for each row.

    Bytes are removed that are covered by a string of `width` bytes which starts anywhere else too, in the same or another
    row; all such strings go, the first included. Strings do not cross rows. Null text is empty; repeated rows are copies of
    each other; rows without doc_id take part like others. Only doc_id and text are read. An empty table gives no rows.

    Scale: a context travels as two hashes and its place, and copies settle without their bytes; bytes travel only for
    names with different contexts. `group_bytes` and `batch_bytes` only bound what a task holds and orders at once: a larger
    group is split by what its strings share, again and again, so that every part is ordered. Lists of spans, of one
    document each, are broadcast when few, else joined by a shuffle.
    """
    rows = tagged(docs)
    spans = common.staged_alone(lambda: repeated_spans(rows, width, group_bytes, batch_bytes), "removed")
    return beside(rows, common.small(spans, "spans"), "left").select("doc_id", "text", "spans").mapInArrow(
        cut_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def _cut_texts(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Like cut_spans(), with all columns; a character of which bytes go goes whole, texts without spans stay as they are."""
    for part in common.slices(batches, text):
        at = part.schema.get_field_index(text)
        out = part.column(text).to_pylist()
        for i, spans in enumerate(part.column("spans").to_pylist()):
            if spans:
                raw, kept, end = out[i].encode(), [], 0
                for a, b in sorted((x["start"], x["end"]) for x in spans):
                    kept.append(raw[end:a])
                    end = max(end, b)
                out[i] = b"".join([*kept, raw[end:]]).decode(errors="ignore")
        part = part.set_column(at, text, pa.array(out, pa.string()))
        yield part.select([c for c in part.schema.names if c != "spans"])


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated strings cut out of their text; all rows and columns stay, n_chars (if there) is counted anew."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    spans = common.small(common.staged_alone(lambda: repeated_spans(tagged(docs), width), "removed"), "spans")
    inner = docs.toDF(*names).withColumn("tag", F.xxhash64(text))
    joined = inner.join(spans.withColumnRenamed("doc_id", "id"), F.col(doc_id).cast("long").eqNullSafe(F.col("id")) & (inner["tag"] == spans["tag"]), "left")
    schema = ", ".join(f"{n} {docs.schema[i].dataType.simpleString()}" for i, n in enumerate(names))
    out = joined.select(*names, "spans").mapInArrow(lambda b: _cut_texts(b, text), schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

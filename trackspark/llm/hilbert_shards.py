"""Sharding along a Hilbert curve.

Several columns of metadata are quantised to cells of equal counts; the cell's place on the Hilbert curve orders the rows; runs of
that order are the shards. Each shard then covers a compact part of every dimension, so that readers prune files on any of them.
All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of each dimension; the dimensions of the registered query, and its shards.
BITS, DIMENSIONS, SHARDS = 6, ("source", "lang", "size"), 8


def quantised(rows: DataFrame, dims: tuple[str, ...], bits: int) -> DataFrame:
    """rows with q0, q1, ...: the part of all rows with a smaller value in the dimension, in steps of 2 ** -bits; null is the smallest value.

    Values are counted first, so a value with most rows is one row in what is ordered; the counts go to all tasks where they are few,
    else they are joined by a shuffle that splits large values.
    """
    total = rows.count()
    for k, dim in enumerate(dims):
        counts = common.staged(rows.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n")), "values")
        placed = _running(counts, ["value"], F.col("n")).select("value", F.floor(F.col("before") * (1 << bits) / F.lit(max(total, 1))).cast("long").alias(f"q{k}"))
        places = common.staged(placed, "places")
        common.unstage(counts)
        rows = rows.join(common.small(places), F.col(dim).eqNullSafe(F.col("value"))).drop("value")
    return rows


def hilbert_index(axes: list[Column], bits: int) -> list[tuple[str, Column]]:
    """Steps (name, value) that turn cell numbers into the place on the curve, the last named `curve`; each reads columns that earlier ones made.

    From the highest bit down, an axis whose bit is set inverts the lower bits of the first axis, else swaps them with it; then a Gray
    code of the axes' bits, read across the axes from the highest bit, is the place.
    """
    n, steps = len(axes), [(f"x{i}_0", a) for i, a in enumerate(axes)]
    at = [f"x{i}_0" for i in range(n)]

    def put(i: int, value: Column) -> None:
        at[i] = f"x{i}_{len(steps)}"
        steps.append((at[i], value))

    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            own, first = F.col(at[i]), F.col(at[0])
            is_set = own.bitwiseAND(F.lit(1 << bit)) != 0
            swap = F.when(is_set, F.lit(0)).otherwise(first.bitwiseXOR(own).bitwiseAND(F.lit(low))).cast("long")
            steps.append((t := f"t_{len(steps)}", swap))
            turned = F.when(is_set, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(F.col(t)))
            if i:
                put(i, own.bitwiseXOR(F.col(t)))
            put(0, turned)
    for i in range(1, n):
        put(i, F.col(at[i]).bitwiseXOR(F.col(at[i - 1])))
    last = F.col(at[n - 1])
    flips = [F.when(last.bitwiseAND(F.lit(1 << bit)) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)).cast("long") for bit in range(bits - 1, 0, -1)]
    steps.append(("flip", reduce(Column.bitwiseXOR, flips, F.lit(0).cast("long"))))
    digits = [
        F.shiftleft(F.shiftright(F.col(at[i]).bitwiseXOR(F.col("flip")), bit).bitwiseAND(F.lit(1)), bit * n + n - 1 - i)
        for bit in range(bits) for i in range(n)
    ]
    return [*steps, ("curve", reduce(Column.bitwiseOR, digits))]


def with_curve(rows: DataFrame, dims: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """rows and `curve`, the place of their cell on the Hilbert curve; len(dims) * bits must be below 63."""
    names = rows.columns
    out = quantised(rows, dims, bits)
    for name, value in hilbert_index([F.col(f"q{k}") for k in range(len(dims))], bits):
        out = out.withColumn(name, value)
    return out.select(*names, "curve")


def _running(rows: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """rows with `nth` (0, 1, ... in the order) and `before` (weight of the rows before), both over all rows.

    A range sort deals the rows to many tasks by all the order's columns and, last, the row's place in the input, so equal keys part
    too; each task numbers its own rows, and the tasks' totals, one row each, are summed by one.
    """
    placed = rows.withColumns({"input_": F.monotonically_increasing_id(), "weight_": weight})
    ordered = placed.orderBy(*order, "input_").withColumn("id_", F.monotonically_increasing_id()).drop("input_")
    kept = common.staged(ordered.withColumn("task_", F.shiftright("id_", 33)), "ordered")
    tasks = kept.groupBy("task_").agg(F.count("*").alias("rows_"), F.sum("weight_").alias("sum_"))
    earlier = Window.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("task_", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}before") for c in ("rows_", "sum_")))
    own = Window.partitionBy("task_").orderBy("id_").rowsBetween(Window.unboundedPreceding, -1)
    return kept.join(F.broadcast(offsets), "task_").select(
        *rows.columns, (F.col("rows_before") + F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))).alias("nth"),
        (F.col("sum_before") + F.coalesce(F.sum("weight_").over(own), F.lit(0))).alias("before"),
    )


def hilbert_shards(
    rows: DataFrame, dims: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS, law: str = "rows", size: str = "size", ties: tuple[str, ...] = (),
) -> DataFrame:
    """All columns of rows, and curve, law, shard (0 to shards - 1) and slot (gapless from 0 within the shard, along the curve).

    law "rows": the shards' counts differ by one at most. law "bytes": the sums of `size` are near equal; a shard ends at the first
    row whose middle lies beyond its part of all bytes. Rows of one cell come in order of `ties`, then of the input, so repeated
    rows are rows like others. Nulls in a dimension are the least value. An empty table gives no rows. Names that the result adds
    must not stand in rows.

    Scale: two sorts by range of what rows holds, so pass keys and metadata, not texts (write_shards joins nothing: it takes whole
    rows); no window runs over more than one task's rows, apart from one row a task.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    curved = with_curve(rows, dims, bits)
    ranked = _running(curved, ["curve", *ties], F.col(size))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if law == "rows":
        cut = ranked.withColumn("shard", F.expr(f"cast(nth * {shards} div {max(n, 1)} as int)"))
        start = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}) div {shards}")
        out = cut.withColumn("slot", F.col("nth") - start)
    else:
        cut = ranked.withColumn("shard", F.least(F.expr(f"cast((2 * before + {size}) * {shards} div {max(2 * total, 1)}L as int)"), F.lit(shards - 1)))
        out = cut.join(F.broadcast(cut.groupBy("shard").agg(F.min("nth").alias("start"))), "shard").withColumn("slot", F.col("nth") - F.col("start"))
    return out.select(*rows.columns, "curve", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, dims: tuple[str, ...], shards: int = SHARDS, bits: int = BITS, law: str = "bytes", size: str = "size") -> DataFrame:
    """Write rows under path, one directory `shard=k` for each shard, files in order of the curve; return what shard_ranges() says of them."""
    placed = hilbert_shards(rows, dims, shards, bits, law, size)
    per = max(1, placed.sparkSession.sparkContext.defaultParallelism // shards)
    dealt = placed.repartitionByRange(shards * per, "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.drop("law").write.partitionBy("shard").parquet(path)
    return shard_ranges(placed, dims, size)


def shard_ranges(placed: DataFrame, dims: tuple[str, ...], size: str = "size") -> DataFrame:
    """shard, n_rows, n_bytes and the least and greatest value of each dimension: what a reader prunes by."""
    ends = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("least", F.min), ("greatest", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"), *ends)


def document_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size (UTF-8 bytes of the text and 1) and text_crc32 of docs; null texts are empty. Texts end here."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.staged(document_metadata(common.read(spark, sf_dir, "documents")), "metadata")
    placed = hilbert_shards(rows, ties=("text_crc32", "doc_id"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang")


def curve_sql(source: str, n: int, bits: int) -> tuple[str, str]:
    """Common table expressions (text, and the last one's name) that add `curve` to source(q0, q1, ...), axis by axis and bit by bit."""
    parts, now = [], source

    def step(items: str) -> None:
        nonlocal now
        parts.append(f"s{len(parts)} as (select * replace ({items}) from {now})")
        now = f"s{len(parts) - 1}"

    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            turn = f"case when q{i} & {1 << bit} <> 0 then xor(q0, {low}) else xor(q0, xor(q0, q{i}) & {low}) end as q0"
            step(turn if i == 0 else f"{turn}, case when q{i} & {1 << bit} <> 0 then q{i} else xor(q{i}, xor(q0, q{i}) & {low}) end as q{i}")
    for i in range(1, n):
        step(f"xor(q{i}, q{i - 1}) as q{i}")
    flip = "0"
    for bit in range(bits - 1, 0, -1):
        flip = f"xor({flip}, case when q{n - 1} & {1 << bit} <> 0 then {(1 << bit) - 1} else 0 end)"
    step(", ".join(f"xor(q{i}, {flip}) as q{i}" for i in range(n)))
    digits = " + ".join(f"(((q{i} >> {bit}) & 1) << {bit * n + n - 1 - i})" for bit in range(bits) for i in range(n))
    parts.append(f"curved as (select *, {digits} as curve from {now})")
    return ",\n".join(parts), "curved"


#: CRC-32 of the UTF-8 bytes of a text, byte by byte.
CRC_TABLE_SQL = """crc_table as (
  select list(c order by b) as tab from (
    select b, list_reduce(range(0, 8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) as c from range(0, 256) t(b))
)"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast(('0x' || x) as bigint))"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295)"


ORACLE_SQL = f"""
with {CRC_TABLE_SQL}, m as (
  select doc_id, source, lang, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, {crc_sql("coalesce(text, '')")} as text_crc32 from documents, crc_table
), q as (
  select *, {", ".join(f"cast(floor((rank() over (order by {d} nulls first) - 1) * {1 << BITS} / count(*) over ()) as bigint) as q{k}" for k, d in enumerate(DIMENSIONS))} from m
), {curve_sql("q", len(DIMENSIONS), BITS)[0]}, r as (
  select *, row_number() over (order by curve, text_crc32, doc_id nulls first) - 1 as nth, count(*) over () as total from curved
)
select doc_id, size, text_crc32, 'rows' as law, cast(nth * {SHARDS} // total as int) as shard,
       cast(nth - (nth * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} as bigint) as slot, cast(null as int) as grown_shard, curve, source, lang
from r
"""

"""Time-series and aggregate queries on the driver's own tables: events by user, orders by customer, lineitem by supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators import compare
from trackspark.operators import timeseries as T
from trackspark.plans.track_queries import rnd, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def ticks(spark, d) -> DataFrame:
    """One row a user and instant: the mean value; hours since the epoch of the data."""
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.round((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9, 6)
    return e.select("user_id", t.alias("t"), "value", "event_type", "event_id").groupBy("user_id", "t").agg(
        F.round(F.max("value"), 4).alias("v"), F.min("event_type").alias("kind"), F.min("event_id").alias("id"),
    )


TICKS = """with tk as (
  select user_id, t, round(max(value), 4) as v, min(event_type) as kind, min(event_id) as id from (
    select user_id, round((epoch_us(ts) - 1704067200000000) / 3.6e9, 6) as t, value, event_type, event_id from events) group by user_id, t
)"""
K = ["user_id"]


@query("j2_asof_backward", TICKS + """, p as (select user_id, t, v from tk where kind = 'purchase'), q as (select * from tk where kind = 'error')
select q.user_id, q.t, case when q.t - p.t <= 48 then p.v end as asof_v, """ + rnd("case when q.t - p.t <= 48 then q.t - p.t end") + """ as age from q asof left join p on q.user_id = p.user_id and q.t >= p.t""")
def j2(spark, d):
    k = ticks(spark, d)
    return T.asof_backward(k.where("kind = 'error'").select("user_id", "t"), k.where("kind = 'purchase'"), K, "t", "v", 48.0).select("user_id", "t", "asof_v", rounded("age").alias("age"))


@query("j4_interpolate_at", TICKS + """, p as (select user_id, t, v from tk where kind <> 'click' and v is not null), q as (select user_id, t from tk where kind = 'click'),
u as (select q.user_id, q.t, (select max_by(struct_pack(t := p.t, v := p.v), p.t) from p where p.user_id = q.user_id and p.t <= q.t) as a,
             (select min_by(struct_pack(t := p.t, v := p.v), p.t) from p where p.user_id = q.user_id and p.t >= q.t) as b from q)
select user_id, t, """ + rnd("case when a is null or b is null then null when b.t = a.t then a.v else a.v + (b.v - a.v) * (t - a.t) / (b.t - a.t) end", 4) + " as interp_v from u")
def j4(spark, d):
    k = ticks(spark, d)
    return T.interpolate_at(k.where("kind <> 'click'").select("user_id", "t", "v"), k.where("kind = 'click'").select("user_id", "t"), K, "t", "v").select("user_id", "t", rounded("interp_v", 4).alias("interp_v"))


_SEG = """, sg as (select user_id, row_number() over (partition by user_id order by t) as seg, t as a, lead(t) over (partition by user_id order by t) as b from tk where kind = 'purchase')"""


def _segments(k: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t")
    return k.where("kind = 'purchase'").select("user_id", F.row_number().over(w).alias("seg"), F.col("t").alias("a"), F.lead("t").over(w).alias("b")).where("b is not null")


@query("j3_interval_join", TICKS + _SEG + """ select tk.user_id, tk.t, cast(max(seg) as bigint) as seg from tk join sg on tk.user_id = sg.user_id and tk.t between a and b group by 1, 2""")
def j3(spark, d):
    """Inclusive ends; at a shared end the later segment wins. Points meet only the intervals of their own 200 hours."""
    k = ticks(spark, d)
    s = _segments(k).withColumnRenamed("seg", "nth")
    return T.in_intervals(k.select("user_id", "t"), s, K, "t", 200.0, 0.0).where("nth is not null").select("user_id", "t", F.col("nth").cast("long").alias("seg"))


@query("j5_inside_gaps", TICKS + _SEG + """ select count(*) as n from (select 1 from tk where kind = 'view' and exists (select 1 from sg where sg.user_id = tk.user_id and tk.t > a and tk.t < b and b - a > 100))""")
def j5(spark, d):
    k = ticks(spark, d)
    gaps = _segments(k).where("b - a > 100").select("user_id", "a", "b")
    return compare.in_gap(k.where("kind = 'view'").select("user_id", "t"), gaps, K, "t").where("t > gap_a").agg(F.count("*").alias("n"))


@query("j6_interval_overlap", TICKS + _SEG + """ select x.user_id, cast(x.seg as bigint) as seg from sg x where b is not null and not exists (
  select 1 from tk e where e.kind = 'error' and e.user_id = x.user_id and x.b > e.t - 5 and x.a < e.t + 5)""")
def j6(spark, d):
    k = ticks(spark, d)
    e = k.where("kind = 'error'").select("user_id", (F.col("t") - 5).alias("a"), (F.col("t") + 5).alias("b"))
    return T.overlapping_intervals(_segments(k), e, K, 200.0, "left_anti").select("user_id", F.col("seg").cast("long").alias("seg"))


@query("j7_anti_join", "select o_custkey, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) group by 1")
def j7(spark, d):
    """Orders of all customers but the deleted ones, those whose balance is below zero; counted by customer before the join."""
    o, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    g = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return g.join(c.where("c_acctbal < 0"), g.o_custkey == c.c_custkey, "left_anti")


_DAYS = "(select distinct user_id, cast(cast(ts as date) as varchar) as day from events where event_type = '{}')"


@query("u2_except_intersect", f"select 'kept' as part, * from ({_DAYS.format('click')} except {_DAYS.format('error')}) union all select 'both', * from ({_DAYS.format('click')} intersect {_DAYS.format('error')})")
def u2(spark, d):
    """A user's days with clicks: those without an error are kept; those with one are what must not be in the kept part."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    clicks, errors = (e.where(F.col("event_type") == k).select("user_id", "day") for k in ("click", "error"))
    part = lambda name, df: df.select(F.lit(name).alias("part"), "user_id", "day")
    return part("kept", clicks.subtract(errors)).unionByName(part("both", clicks.intersect(errors)))


_W = " window w as (partition by user_id order by t)"


@query("w5_gradient", TICKS + """, g as (select *, t - lag(t) over w as hs, lead(t) over w - t as hd, lag(v) over w as a, lead(v) over w as c from tk""" + _W + """)
select user_id, t, """ + rnd("coalesce((hs * hs * c + (hd * hd - hs * hs) * v - hd * hd * a) / (hs * hd * (hs + hd)), (c - v) / hd, (v - a) / hs)", 3) + " as g from g")
def w5(spark, d):
    return T.gradient(ticks(spark, d), K, "t", "v", "g").select("user_id", "t", rounded("g", 3).alias("g"))


@query("w6_sample_gradient", TICKS + """ select user_id, t, """ + rnd("coalesce((lead(v) over w - lag(v) over w) / greatest(lead(t) over w - lag(t) over w, 1e-6), (lead(v) over w - v) / greatest(lead(t) over w - t, 1e-6), (v - lag(v) over w) / greatest(t - lag(t) over w, 1e-6))", 3) + " as g from tk" + _W)
def w6(spark, d):
    return T.sample_gradient(ticks(spark, d), K, "t", "v", "g").select("user_id", "t", rounded("g", 3).alias("g"))


@query("w8_rolling_median", TICKS + " select user_id, t, " + rnd("quantile_cont(v, 0.5) over (partition by user_id order by t rows between 2 preceding and 2 following)", 7) + " as med from tk")
def w8(spark, d):
    return T.rolling_median(ticks(spark, d), K, ["t"], "v", 5, "med").select("user_id", "t", rounded("med", 7).alias("med"))


@query("w9_chord_residual", TICKS + """, c as (select user_id, t, v, first_value(t) over f as ta, last_value(t) over f as tb, first_value(v) over f as va, last_value(v) over f as vb from tk
  window f as (partition by user_id order by t rows between 2 preceding and 2 following)
), e as (select *, (tb - ta) * (tb - ta) + (vb - va) * (vb - va) as dd, (tb - ta) * (t - ta) + (vb - va) * (v - va) as de, (t - ta) * (t - ta) + (v - va) * (v - va) as ee from c)
select user_id, t, """ + rnd("sqrt(greatest(ee - case when dd > 1e-12 then de * de / dd else 0 end, 0))", 3) + " as residual from e")
def w9(spark, d):
    return T.chord_residual(ticks(spark, d), K, ["t"], ["t", "v"], 2, "residual").select("user_id", "t", rounded("residual", 3).alias("residual"))


@query("w11_split_gaps", TICKS + """, s as (select *, t - lag(t) over (partition by user_id order by t) as dt from tk
), m as (select user_id, quantile_cont(dt, 0.5) as med from s where dt > 0 group by user_id
), f as (select s.*, case when dt > greatest(30e0, coalesce(5 * med, 0)) then 1 else 0 end as gap from s left join m using (user_id))
select user_id, t, cast(sum(gap) over (partition by user_id order by t rows unbounded preceding) as bigint) as component from f""")
def w11(spark, d):
    return T.split_gaps(ticks(spark, d), K, "t").select("user_id", "t", F.col("component").cast("long").alias("component"))


@query("w15_longest_run", TICKS + """, f as (select *, v > 50 as above from tk), n as (select *, case when above is not distinct from lag(above) over (partition by user_id order by t) then 0 else 1 end as new from f
), r as (select *, sum(new) over (partition by user_id order by t rows unbounded preceding) as run from n
), g as (select user_id, run, min(t) as t0, max(t) as t1, count(*) as n from r where above group by 1, 2)
select user_id, t0, t1, n from (select *, row_number() over (partition by user_id order by n desc, t0) as k from g) where k = 1""")
def w15(spark, d):
    return T.longest_run_above(ticks(spark, d), K, "t", "v", 50.0)


@query("w16_neighbour_step", TICKS + " select user_id, t, " + rnd("least(t - lag(t) over w, lead(t) over w - t)") + " as step from tk" + _W)
def w16(spark, d):
    w = Window.partitionBy("user_id").orderBy("t")
    return ticks(spark, d).select("user_id", "t", rounded(F.least(F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t"))).alias("step"))


@query("w19_downsample", TICKS + """, i as (select *, row_number() over (partition by user_id order by t) - 1 as i, count(*) over (partition by user_id) as n from tk)
select user_id, t from i where n <= 12 or i in (select cast(round_even(j * (i.n - 1) / 11e0, 0) as bigint) from range(12) x(j))""")
def w19(spark, d):
    return T.downsample(ticks(spark, d), K, ["t"], 12).select("user_id", "t")


@query("w20_rank_methods", "select o_orderpriority, o_orderstatus, n, cast(row_number() over (partition by o_orderstatus order by n desc, o_orderpriority) as bigint) as place from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2)")
def w20(spark, d):
    g = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("n"), "o_orderpriority")).cast("long"))


@query("w24_linear_fill", TICKS + """, i as (select user_id, t, case when kind <> 'click' then v end as v, row_number() over (partition by user_id order by t) as i from tk
), f as (select *, last_value(case when v is not null then i end ignore nulls) over b as ia, last_value(v ignore nulls) over b as va, first_value(case when v is not null then i end ignore nulls) over a as ib, first_value(v ignore nulls) over a as vb from i
  window b as (partition by user_id order by t rows between unbounded preceding and current row), a as (partition by user_id order by t rows between current row and unbounded following))
select user_id, t, """ + rnd("case when ia is null then vb when ib is null or ia = ib then va else va + (vb - va) * (i - ia) / (ib - ia) end", 4) + " as filled from f")
def w24(spark, d):
    k = ticks(spark, d).withColumn("v", F.when(F.col("kind") != "click", F.col("v")))
    return T.linear_fill(k, K, ["t"], "v", "filled").select("user_id", "t", rounded("filled", 4).alias("filled"))


@query("w25_resample", TICKS + """, e as (select user_id, min(t) as a, max(t) as b from tk group by 1), n as (select *, cast(floor((b - a) / 24e0 + 1e-9) as bigint) as n from e)
select user_id, round(t, 6) as t from (select user_id, unnest(list_concat(list_transform(range(0, n + 1), lambda i: a + i * 24e0), case when a + n * 24e0 < b - 1e-9 then [b] else [] end)) as t from n)""")
def w25(spark, d):
    return T.resample(ticks(spark, d), K, "t", 24.0).select("user_id", F.round("t", 6).alias("t"))


@query("a7_statistics", TICKS + " select user_id, " + ", ".join((rnd("sqrt(avg(v * v))", 7) + " as rms", rnd("quantile_cont(v, 0.95)", 7) + " as p95", rnd("max(v)", 7) + " as most", rnd("min(v)", 7) + " as least", "count(*) filter (v > 60) as n_over")) + " from tk group by user_id")
def a7(spark, d):
    return ticks(spark, d).groupBy("user_id").agg(rounded(T.rms(F.col("v")), 7).alias("rms"), rounded(F.percentile("v", 0.95), 7).alias("p95"), rounded(F.max("v"), 7).alias("most"), rounded(F.min("v"), 7).alias("least"), F.count_if(F.col("v") > 60).alias("n_over"))


@query("a8_weighted_mean", "select l_suppkey, " + rnd("sum(l_quantity * l_extendedprice) / sum(l_quantity)", 3) + " as mean, " + rnd("sqrt(sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity))", 3) + " as rms from lineitem where l_quantity > 0 group by 1")
def a8(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 0")
    w, x = F.col("l_quantity"), F.col("l_extendedprice")
    return li.groupBy("l_suppkey").agg(rounded(F.sum(w * x) / F.sum(w), 3).alias("mean"), rounded(F.sqrt(F.sum(w * x * x) / F.sum(w)), 3).alias("rms"))


@query("a9_weighted_quantile", """with p as (select l_suppkey, l_extendedprice as x, sum(l_quantity) as w from lineitem where l_quantity > 0 group by 1, 2
), c as (select *, sum(w) over (partition by l_suppkey order by x) as c, sum(w) over (partition by l_suppkey) as t from p)
select l_suppkey, min(x) as wq_l_extendedprice from c where c >= 0.9e0 * t group by 1""")
def a9(spark, d):
    return T.weighted_quantile(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_suppkey"], "l_extendedprice", "l_quantity", 0.9)


@query("a10_mad_scale", TICKS + """, m as (select user_id, quantile_cont(v, 0.5) as med from tk group by 1), x as (select user_id, any_value(med) as med, quantile_cont(abs(v - med), 0.5) as mad, stddev_pop(v) as sd from tk join m using (user_id) group by 1)
select user_id, """ + rnd("med", 7) + " as median, " + rnd("case when 1.4826e0 * mad > 1e-9 then 1.4826e0 * mad when sd > 1e-9 then sd else 0e0 end", 7) + " as scale from x")
def a10(spark, d):
    return T.mad_scale(ticks(spark, d), K, "v").select("user_id", rounded("median", 7).alias("median"), rounded("scale", 7).alias("scale"))


@query("a13_dominant_label", """with c as (select user_id, event_type, count(*) as n from events group by 1, 2)
select user_id, event_type as label, round(n / t, 6) as share from (select *, sum(n) over (partition by user_id) as t, row_number() over (partition by user_id order by n desc, event_type) as r from c) where r = 1""")
def a13(spark, d):
    return T.dominant_label(spark.read.parquet(f"{d}/events.parquet"), K, "event_type").withColumn("share", F.round("share", 6))


@query("a15_aggregate_dataset", """with l as (select user_id % 7 as method, user_id, count(*) as event_count, sqrt(avg(value * value)) as value_rmse, avg(value) as level from events group by 1, 2)
select method, cast(sum(event_count) as bigint) as event_count, """ + rnd("sqrt(sum(event_count * value_rmse * value_rmse) / sum(event_count))", 4) + " as value_rmse, " + rnd("sum(event_count * level) / sum(event_count)", 4) + " as level from l group by method")
def a15(spark, d):
    """Names ending in _count are summed, _rmse is a weighted RMS, the rest a weighted mean."""
    e = spark.read.parquet(f"{d}/events.parquet")
    g = e.groupBy((F.col("user_id") % 7).alias("method"), "user_id").agg(F.count("*").alias("event_count"), T.rms(F.col("value")).alias("value_rmse"), F.avg("value").alias("level"))
    w = F.col("event_count")
    how = lambda n: F.sum(n) if n.endswith("_count") else rounded(F.sqrt(F.sum(w * F.col(n) * F.col(n)) / F.sum(w)), 4) if n.endswith("_rmse") else rounded(F.sum(w * F.col(n)) / F.sum(w), 4)
    return g.groupBy("method").agg(*(how(n).alias(n) for n in ("event_count", "value_rmse", "level")))


@query("t2_previews", TICKS + " select user_id, t from (select user_id, t, row_number() over (partition by user_id order by v desc, t) as r from tk) where r <= 3")
def t2(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("v"), "t")
    return ticks(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "t")

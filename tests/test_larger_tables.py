"""Results on tables whose keys run beyond those of the given ones, and steps that must not repeat work."""

import duckdb
import pytest
from duck import assert_same

from trackspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """The events three times, with users up to 25,000: track numbers of three and of four digits, and of one that is shared."""
    d = tmp_path_factory.mktemp("wide")
    duckdb.connect().execute(f"copy (select event_id + c::bigint * 1000000 as event_id, ts, user_id + c as user_id, event_type, value, props from '{SF}/events.parquet', (values (0), (1005), (12345)) k(c)) to '{d}/events.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["a1_keyframes", "a5_best_callsign", "a4_normalize_report"])
def test_track_names_of_more_than_ten_thousand_users_equal_sql(spark, many_users, name):
    assert_same(registry.QUERIES[name](spark, many_users), registry.ORACLE_SQL[name], many_users)


def test_headings_of_velocities_that_cancel_equal_sql(spark, tmp_path):
    """Two opposite flights that share a track, each message with its counterpart at the same time."""
    one = f"select * from '{SF}/events.parquet' where epoch(ts)::bigint // 3600 % 3 = 0 qualify row_number() over (partition by epoch(ts)::bigint // 3600 order by ts) = 1"
    duckdb.connect().execute(f"copy (select event_id + c::bigint * 1000000 as event_id, ts, c as user_id, 'error' as event_type, value, props from ({one}), (values (1000), (10060)) k(c)) to '{tmp_path}/events.parquet' (format parquet)")
    assert_same(registry.QUERIES["a3_flat_keyframes"](spark, str(tmp_path)), registry.ORACLE_SQL["a3_flat_keyframes"], str(tmp_path))


def test_checksum_of_any_size_is_the_remainder(spark):
    from pyspark.sql import functions as F

    from trackspark.operators import decode

    frames = ["8D4840D6202CC371C32CE0576098", "8d4840d6202cc371c32ce0576099", "02E197B00179C3", "FFFFFFFF", "8D4840D6202CC371C32CE0576098FF01", "00112233445566778899AABB", "FFFFFF", None]

    def remainder(x: str | None) -> int | None:
        if x is None or len(x) <= 6:
            return None
        rest = int(x, 16)
        for k in range(rest.bit_length() - 1, 23, -1):
            rest ^= decode.GENERATOR << k - 24 if rest >> k & 1 else 0
        return rest

    got = spark.createDataFrame([(x,) for x in frames], "h string").repartition(1).select("h", decode.crc_remainder(F.col("h")).alias("r")).collect()
    assert {r.h: r.r for r in got} == {x: remainder(x) for x in frames}


def test_the_checksum_of_a_frame_takes_no_step_by_step_fold(spark):
    """At most one fold, for odd sizes, over bytes; it was one over the bits of each byte, made again for each field."""
    from pyspark.sql import functions as F

    from trackspark.operators import decode

    made = spark.range(1).select(F.lpad(F.hex("id"), 28, "0").alias("h")).select(decode.crc_remainder(F.col("h")).alias("r"))
    assert made._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 1


def test_batches_are_cut_by_id_and_no_rows_are_ordered(spark):
    from trackspark.operators import decode

    frames = spark.range(0, 5000).selectExpr("id * id + id % 7 as id", "'8D4840D6202CC371C32CE0576098' as payload_hex")
    known = frames.where("id < 0").select("id")
    new = decode.decode_incremental(frames, known, 1234)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Limit" not in plan
    ids = sorted(r.id for r in frames.collect())
    assert sorted(r.id for r in new.select("id").collect()) == ids[:1234]
    assert decode.decode_incremental(frames, known, 9999).count() == 5000


def test_first_summaries_of_many_keys_need_memory_by_rows():
    """A key's rows lie far apart; small arrays for every key and batch took several hundred bytes a row."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from trackspark.operators import sketch

    n, rng = 10_000, np.random.default_rng(3)
    names = np.array([f'{{"l_suppkey":{k}}}' for k in range(20_000)])

    def batches():
        for _ in range(40):
            yield pa.RecordBatch.from_arrays([pa.array(names[rng.integers(0, 20_000, n)]), pa.array(rng.random(n)), pa.array(np.ones(n))], ["key", "v", "w"])

    tracemalloc.start()
    weight = sum(float(np.sum(b.column("w").flatten().to_numpy())) for b in sketch._first(batches(), 200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weight == 40 * n
    assert peak < 40e6


def test_a_banded_factor_needs_few_calls_and_is_the_same():
    """Calls of numpy for every step made it several times slower; the factor is that of the dense matrix."""
    import cProfile

    import numpy as np

    from trackspark.operators import banded

    k, m = 6, 60
    bands = np.random.default_rng(1).random((k, m))
    bands[0] += 8
    for q in range(1, k):
        bands[q, m - q :] = 0
    profile = cProfile.Profile()
    low = profile.runcall(banded.factor, bands)
    full = sum(np.diag(bands[q, : m - q], -q) + (np.diag(bands[q, : m - q], q) if q else 0) for q in range(k))
    assert np.allclose(sum(np.diag(low[q, : m - q], -q) for q in range(k)), np.linalg.cholesky(full), rtol=1e-12, atol=1e-14)
    with pytest.raises(np.linalg.LinAlgError):
        banded.factor(-bands)
    # steps in Python: no numpy function is called for a column
    assert sum(e.callcount for e in profile.getstats()) < 4 * m

def _tracks(spark, n: int):
    """Tracks of twelve rows in one component and segment."""
    rows = [(f"T{k:03d}", 0, 0, i, float(i), 80.0 * i + k, 3.0 * i, 5.0 * (i % 3), 80.0, 3.0, 0.0) for k in range(n) for i in range(12)]
    return spark.createDataFrame(rows, "track_id string, component int, segment long, i long, t double, x double, y double, z double, vx double, vy double, vz double")


@pytest.mark.parametrize("name", ["fits", "states", "residuals", "evidence", "filter", "splines", "shapes", "scan", "labels"])
def test_groups_that_python_works_on_are_dealt_over_the_cores(spark, name):
    """Their bytes are few, so adaptive execution put all of them into one task."""
    from pyspark.sql import functions as F

    from trackspark.operators import evaluation, fits, regimes, scan, segment_scores, smoothing, splines
    from trackspark.staging import staged

    s = _tracks(spark, 40)
    fitted = lambda: staged(fits.fit_segments(s), "fits")
    made = {
        "fits": lambda: fits.fit_segments(s), "states": lambda: fits.boundary_states(s, s.where("i = 5")), "residuals": lambda: fits.fit_residuals(s, fitted()), "evidence": lambda: segment_scores.evidence(s, fitted()),
        "filter": lambda: smoothing.smooth_ca(s), "splines": lambda: splines.fit_bsplines(s, ("balanced",)), "shapes": lambda: evaluation.hausdorff(s.withColumn("which", (F.col("i") % 2).cast("int"))),
        "scan": lambda: scan.smooth_ca_scan(s, ("balanced",), 4, stage=staged), "labels": lambda: regimes.regime_labels(regimes.raw_labels(regimes.motion_features(s))),
    }[name]()
    assert made.select("track_id", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() > 4


def test_the_way_back_from_the_plane_computes_its_points_once(spark):
    """The projection stands once in the plan; it was evaluated again in each step and for each field."""
    from trackspark.plans import track_queries

    plan = track_queries.QUERIES["p10_round_trip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.split("aggregate(")[1].split("lambdafunction(")[1].count("lat#") == 0


def test_intervals_are_found_again_whatever_the_partitions(spark):
    """Intervals with a wide column, whose shuffle is merged in another way on each side of a join."""
    from pyspark.sql import functions as F

    from trackspark.operators import timeseries as T

    rows = spark.range(40000).groupBy((F.col("id") % 2000).alias("k")).agg(F.concat_ws(",", F.collect_list(F.sha2(F.col("id").cast("string"), 512))).alias("wide"))
    left = rows.select("k", "wide", F.col("k").cast("double").alias("a"), (F.col("k") + 1).cast("double").alias("b"))
    right = spark.range(0, 2000, 2).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"), (F.col("id") + 0.5).alias("b"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        found = {how: sorted(r.k for r in T.overlapping_intervals(left, right, ["k"], 6.0, how).collect()) for how in ("left_semi", "left_anti")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {"left_semi": list(range(0, 2000, 2)), "left_anti": list(range(1, 2000, 2))}


def test_boundary_samples_of_costs_that_are_equal_to_six_digits_are_the_nearer(spark):
    from trackspark.operators import segmentation

    miss = {i: 10.0 for i in range(11)} | {3: (1.0 - 0.10 - 1e-8) / 0.45, 4: (1.0 - 0.05) / 0.45}
    features = spark.createDataFrame([("A", i, float(i), m) for i, m in miss.items()], "track_id string, i long, t double, mismatch double")
    found = segmentation.choose_boundary_sample(spark.createDataFrame([("A", 5)], "track_id string, sample_index long"), features)
    assert [tuple(r) for r in found.collect()] == [("A", 5, 4, 4.0)]


@pytest.fixture(scope="module")
def shared_tracks(tmp_path_factory):
    """Two tracks of eleven flights each, of sixty copies of the events: velocities cancel out, means of several rows end in half a digit."""
    d = tmp_path_factory.mktemp("shared")
    copies = "select event_id + c * 100000 as event_id, ts, user_id + c * 1500 as user_id, event_type, value, props from '/root/testdata/sf0.1/events.parquet', range(60) k(c)"
    kept = "substr('T' || lpad(cast(user_id // 10 as varchar), 3, '0'), 1, 4) in ('T108', 'T116')"
    duckdb.connect().execute(f"copy (select * from ({copies}) where {kept} order by event_id) to '{d}/events.parquet' (format parquet)")
    return str(d)


SHARED = ("io15_metadata", "a3_flat_keyframes", "e10_unwrapped_heading", "w17_cumulative_turn", "m5_turn_labels", "e3_velocity_metrics", "e8_e13_motion_metrics", "e17_dynamic_metrics", "m1_all_features", "m7_m8_energy_changes", "p31_policies")


@pytest.mark.parametrize("name", SHARED)
def test_tracks_that_flights_share_equal_sql(spark, shared_tracks, name):
    assert_same(registry.QUERIES[name](spark, shared_tracks), registry.ORACLE_SQL[name], shared_tracks)


def test_means_do_not_depend_on_the_order_of_rows(spark):
    from pyspark.sql import functions as F

    from trackspark.operators import prepare

    rows = [("A", i, v) for i, v in enumerate((1e16, 1.0, -1e16, 3.0, None))]
    for part in (rows, rows[::-1], rows[2:] + rows[:2]):
        g = spark.createDataFrame(part, "k string, raw_id long, v double").groupBy("k").agg(prepare.mean_by(F.col("v"), "raw_id").alias("v"))
        assert g.first().v == 0.75


def test_curve_distances_see_every_point_of_long_curves(spark):
    """One point off the line, which neither 2,000 nor 700 evenly spread points hold."""
    import numpy as np
    from pyspark.sql import functions as F

    from trackspark.operators import evaluation, quality

    n = 2500
    held = {int(i) for k in (700, 2000) for i in np.linspace(0, n - 1, k).round()}
    odd = next(i for i in range(1000, n) if i not in held)
    t = F.col("id").cast("double")
    line = lambda which: spark.range(n).select(F.lit("a").alias("track_id"), F.lit(which).alias("which"), t.alias("t"), t.alias("x"), F.when((F.col("id") == odd) & (F.lit(which) == 1), 300.0).otherwise(0.0).alias("y"))
    pairs = line(0).unionByName(line(1))
    assert evaluation.hausdorff(pairs).first().symmetric == 300 and quality.frechet(pairs).first().frechet == 300
    assert np.isclose(evaluation.dtw_mean(pairs).first().dtw, 300 / (2 * n))

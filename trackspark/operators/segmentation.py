"""Boundaries between motion regimes and the segments they cut."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import scalars as S
from trackspark.operators import timeseries as T

#: Values that a boundary's reason adds to its score in the selection.
BONUS = {"turn": 160.0, "climb": 50.0, "descent": 50.0, "level": 12.0}


def transition_candidates(labelled: DataFrame, base: float = 80.0) -> DataFrame:
    """M7: a candidate at the first row of each run but a track's first; longer neighbours make it stronger."""
    runs = T.label_runs(labelled, ["track_id"], "t", "label")
    w = Window.partitionBy("track_id").orderBy("run")
    c = runs.withColumns({"from_label": F.lag("label").over(w), "from_n": F.lag("n").over(w), "from_t0": F.lag("t0").over(w)}).where("from_label is not null")
    support = F.least("n", "from_n")
    return c.select(
        "track_id", F.col("first_index").cast("long").alias("sample_index"), F.col("t0").alias("t"), "from_label", F.col("label").alias("to_label"),
        (base + 2.0 * F.least(support, F.lit(10)).cast("double")).alias("score"), F.concat_ws("_to_", "from_label", "label").alias("reason"),
    )


def union_candidates(*candidates: DataFrame) -> DataFrame:
    """Candidates of several detectors; at one sample the best score and all reasons in order."""
    out = candidates[0]
    for c in candidates[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.groupBy("track_id", "sample_index", "t").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.max("to_label").alias("to_label"))


def choose_boundary_sample(candidates: DataFrame, features: DataFrame, max_shift: int = 6) -> DataFrame:
    """M8: the quietest sample within max_shift rows of a candidate, by its cost to six digits; ties: nearer, then lower index."""
    f = features.select(F.col("track_id").alias("f_track"), F.col("i").alias("f_i"), F.col("t").alias("f_t"), "mismatch")
    near = candidates.join(f, (F.col("track_id") == F.col("f_track")) & F.col("f_i").between(F.col("sample_index") - max_shift, F.col("sample_index") + max_shift))
    away = F.abs(F.col("f_i") - F.col("sample_index"))
    cost = F.struct(S.round_half(0.45 * F.col("mismatch") + 0.05 * away, 6).alias("c"), away.alias("d"), F.col("f_i").alias("i"), F.col("f_t").alias("t"))
    return near.groupBy("track_id", "sample_index").agg(F.min(cost).alias("b")).select("track_id", "sample_index", F.col("b.i").alias("chosen_index"), F.col("b.t").alias("chosen_t"))


def select_boundaries(candidates: DataFrame, min_points: int = 8, min_seconds: float = 12.0, most: int = 48) -> DataFrame:
    """The subset of candidates with the highest total value whose neighbours keep their distance; one group a track.

    Only candidates travel, never samples. Dynamic programming over candidates in order of time and the number taken.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample_index").reset_index(drop=True)
        value = (g.score + g.to_label.map(lambda x: next((v for k, v in BONUS.items() if x and k in x), 0.0)) - 0.01).to_numpy()
        index, t = g.sample_index.to_numpy(), g.t.to_numpy()
        best = [[(0.0, ())] * (most + 1) for _ in range(len(g) + 1)]
        for j in range(1, len(g) + 1):
            k = j - 1
            while k > 0 and (index[j - 1] - index[k - 1] < min_points or t[j - 1] - t[k - 1] < min_seconds):
                k -= 1
            for m in range(1, most + 1):
                with_ = (best[k][m - 1][0] + value[j - 1], best[k][m - 1][1] + (j - 1,))
                best[j][m] = max(best[j - 1][m], with_, key=lambda x: (x[0], [-i for i in x[1]]))
                if m > j:
                    break
        taken = max(best[-1][: min(most, len(g)) + 1], key=lambda x: x[0])[1]
        return g.iloc[list(taken)][["track_id", "sample_index", "t", "score"]]

    return candidates.groupBy("track_id").applyInPandas(choose, "track_id string, sample_index long, t double, score double")


def build_segments(samples: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Segments between boundaries; both ends belong to a segment, so neighbours share the boundary row."""
    ends = samples.groupBy("track_id").agg(F.array(F.min("i"), F.max("i")).alias("e"))
    cuts = ends.select("track_id", F.explode("e").alias("i")).unionByName(boundaries.select("track_id", F.col("sample_index").alias("i"))).distinct()
    w = Window.partitionBy("track_id").orderBy("i")
    seg = cuts.select("track_id", (F.row_number().over(w) - 1).cast("long").alias("segment"), F.col("i").alias("first_index"), F.lead("i").over(w).alias("last_index"))
    return seg.where("last_index is not null")


def segment_features(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Summaries of each segment by an inclusive range join on the track."""
    s = segments.withColumnRenamed("track_id", "s_track")
    j = samples.join(s, (F.col("track_id") == F.col("s_track")) & F.col("i").between(F.col("first_index"), F.col("last_index")))
    return j.groupBy("track_id", "segment").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration"), F.percentile("vz", 0.5).alias("median_vz"), F.max("z").alias("top"))

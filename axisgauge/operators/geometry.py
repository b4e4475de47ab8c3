"""Endpoint-anchored geometry: projections, ranks, trajectory summaries and diagnostics, fixed and pooled anchors."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.numeric import EPS, no_nan, spearman
from axisgauge.functions.vectors import dot, principal, project

TRAJECTORY = ["scenario_id", "style_axis", "model_id", "seed", "encoder_id"]


def self_anchors(points: DataFrame, by: list[str] = TRAJECTORY) -> DataFrame:
    """by, a, b: the vectors at ratios 0 and 1; groups that lack one are left out."""
    ends = points.where("target_ratio in (0.0, 1.0)")
    return ends.groupBy(*by).agg(F.max(F.when(F.col("target_ratio") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("target_ratio") == 1, F.col("v"))).alias("b")).where("a is not null and b is not null")


def with_geometry(points: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Points joined to their anchors; the vectors are dropped as soon as they are projected."""
    joined = points.join(anchors, by).withColumn("g", project("v", "a", "b", "target_ratio")).drop("v", "a", "b")
    g = joined.select("*", "g.*").drop("g")
    wide = F.col("separation") + EPS
    return (
        g.withColumn("projection_raw", F.col("coordinate"))
        .withColumn("projection_clipped", F.when(F.col("coordinate").isNotNull(), F.least(F.greatest("coordinate", F.lit(0.0)), F.lit(1.0))))
        .withColumn("projection_error_raw", F.abs(F.col("coordinate") - F.col("target_ratio")))
        .withColumn("projection_error_clipped", F.abs(F.col("projection_clipped") - F.col("target_ratio")))
        .withColumn("off_axis_drift_normalized", F.col("off_axis") / wide)
        .withColumn("interpolation_distance_normalized", F.col("from_ideal") / wide)
        .withColumn("out_of_range", (F.col("coordinate") < 0) | (F.col("coordinate") > 1))
        .withColumn("endpoint_unstable", F.col("separation") <= EPS)
        .withColumn("is_interior", (F.col("target_ratio") > 0) & (F.col("target_ratio") < 1))
        .withColumn("distance_ratio_estimate", F.when(F.col("from_a") + F.col("from_b") > EPS, F.col("from_a") / (F.col("from_a") + F.col("from_b"))).otherwise(0.5))
    )


def with_neighbour_rank(samples: DataFrame, by: list[str], complete: int | None = None) -> DataFrame:
    """Midrank of each output among the distances of its trajectory's outputs to its own ideal point. The distances
    follow from three numbers a row, so no vectors are joined. Incomplete trajectories get no rank where `complete` is given."""
    other = samples.select(*by, F.col("from_a").alias("_d"), F.col("along").alias("_s"), F.col("run_id").alias("_id"))
    far = F.greatest(F.col("_d") ** 2 - 2 * F.col("target_ratio") * F.col("_s") + (F.col("target_ratio") * F.col("separation")) ** 2, F.lit(0.0))
    own = F.col("from_ideal") ** 2
    same = (F.col("_id") == F.col("run_id")) | (F.abs(far - own) <= 1e-13)
    ranks = samples.select(*by, "run_id", "target_ratio", "separation", "from_ideal", "endpoint_unstable").join(other, by).groupBy(*by, "run_id").agg(
        F.count_if(~same & (far < own)).alias("_closer"), F.count_if(same).alias("_ties"), F.count(F.lit(1)).alias("_points"), F.first("endpoint_unstable").alias("_bad")
    )
    ok = ~F.col("_bad") & (F.lit(True) if complete is None else F.col("_points") == complete)
    rank = F.when(ok, 1 + F.col("_closer") + (F.col("_ties") - 1) / 2.0)
    ranks = ranks.select(*by, "run_id", rank.alias("nearest_neighbor_rank"), (F.when(ok, (rank - 1) / F.greatest(F.col("_points") - 1, F.lit(1)))).alias("nearest_neighbor_rank_normalized"))
    return samples.join(ranks, [*by, "run_id"])


def sample_rows(points: DataFrame, by: list[str] = TRAJECTORY) -> DataFrame:
    """Self-anchored sample metrics of every point."""
    return with_neighbour_rank(with_geometry(points, self_anchors(points, by), by), by)


def interior_summary(samples: DataFrame, by: list[str] = TRAJECTORY) -> DataFrame:
    inner = samples.where("is_interior")
    rows = inner.groupBy(*by).agg(
        F.count(F.lit(1)).alias("interior_point_count"), F.avg("projection_error_raw").alias("interior_calibration_error"),
        F.avg("projection_error_clipped").alias("interior_calibration_error_clipped"), F.avg("off_axis_drift_normalized").alias("drift_mean"),
        F.avg("interpolation_distance_normalized").alias("distance_mean"), F.sqrt(F.avg(F.col("interpolation_distance_normalized") ** 2)).alias("distance_rms"),
        F.avg(F.col("out_of_range").cast("double")).alias("out_of_range_rate"), F.avg("nearest_neighbor_rank").alias("mean_rank"), F.max("separation").alias("endpoint_separation"),
    )
    return rows.join(spearman(inner, "target_ratio", "projection_raw", by, "spearman_monotonicity"), by, "left")


def path_shape(points: DataFrame, samples: DataFrame, by: list[str] = TRAJECTORY) -> DataFrame:
    """Path length ratio, turns, local slopes and principal axis of each trajectory."""
    w = Window.partitionBy(*by).orderBy("target_ratio")
    # inner products of neighbours and next neighbours give segment lengths and turning angles
    near = points.select(*by, "target_ratio", "v", F.lag("v").over(w).alias("v1"), F.lag("v", 2).over(w).alias("v2"))
    g = near.where("v1 is not null").select(
        *by, "target_ratio", dot("v", "v").alias("vv"), dot("v", "v1").alias("v_1"), dot("v1", "v1").alias("v11"),
        dot("v", F.coalesce("v2", "v1")).alias("v_2"), dot("v1", F.coalesce("v2", "v1")).alias("v12"), dot(F.coalesce("v2", "v1"), F.coalesce("v2", "v1")).alias("v22"), F.col("v2").isNotNull().alias("turn"),
    )
    length, before = F.sqrt(F.greatest(F.expr("vv + v11 - 2 * v_1"), F.lit(0.0))), F.sqrt(F.greatest(F.expr("v11 + v22 - 2 * v12"), F.lit(0.0)))
    cosine = F.expr("v_1 - v11 - v_2 + v12") / (length * before)
    angle = F.when(F.col("turn") & (length * before > EPS), F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))))
    shape = g.groupBy(*by).agg(F.sum(length).alias("path"), F.avg(angle).alias("turn_mean"), F.max(angle).alias("turn_max"))
    slope = (F.col("projection_raw") - F.lag("projection_raw").over(w)) / (F.col("target_ratio") - F.lag("target_ratio").over(w))
    signs = samples.select(*by, "target_ratio", "separation", slope.alias("slope")).withColumn("sign", F.when(F.abs("slope") > EPS, F.signum("slope")))
    signs = signs.withColumn("last", F.last("sign", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    slopes = signs.groupBy(*by).agg(F.count_if(F.col("slope") < 0).alias("negative_slopes"), F.count_if(F.col("sign") != F.col("last")).alias("turning_points"), F.max("separation").alias("separation"))
    main = points.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("target_ratio", "v"))), lambda s: s["v"]).alias("p")).select(*by, principal("p").alias("pc")).select(*by, "pc.*")
    rho = spearman(samples, "target_ratio", "projection_raw", by, "spearman_all")
    return (
        shape.join(slopes, by).join(main, by).join(rho, by, "left").where(F.col("separation") > EPS)
        .withColumn("path_length_ratio", F.col("path") / F.col("separation")).drop("path")
    )


def seed_centres(points: DataFrame, by: list[str], seeds: int = 3) -> tuple[DataFrame, DataFrame]:
    """The points of groups with so many seeds, and for each held-out seed the other seeds' mean point at each ratio."""
    have = points.groupBy(*by).agg(F.countDistinct("seed").alias("k")).where(F.col("k") >= seeds).select(*by)
    p = points.join(have, by)
    held = p.select(*by, F.col("seed").alias("held_seed")).distinct()
    train = p.join(held, by).where("seed != held_seed").groupBy(*by, "held_seed", "target_ratio").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("centre"))
    return p, train


def leave_one_seed_out(points: DataFrame, by: list[str], seeds: int = 3) -> DataFrame:
    """Each seed's interior points against the line between the other seeds' mean endpoints and against their mean points: error
    of the ratio along it, share of points to which the reference of their own ratio is nearest, distance from that reference,
    and distance from the line, or from the nearest mean point (`drift`), both in units of the mean endpoints' separation."""
    p, train = seed_centres(points, by, seeds)
    keys = [*by, "held_seed"]
    ends = train.groupBy(*keys).agg(F.max(F.when(F.col("target_ratio") == 0, F.col("centre"))).alias("a"), F.max(F.when(F.col("target_ratio") == 1, F.col("centre"))).alias("b"), F.collect_set("target_ratio").alias("ratios"))
    test = p.withColumnRenamed("seed", "held_seed").select(*keys, "run_id", "target_ratio", "v")
    on_line = with_geometry(test, ends, keys).where("is_interior")
    choice = F.array_min(F.transform("ratios", lambda r: F.struct(F.abs(r - F.col("coordinate")), r.alias("r"))))["r"]
    line = on_line.groupBy(*keys).agg(
        F.avg("projection_error_raw").alias("line_error"), F.avg((choice == F.col("target_ratio")).cast("double")).alias("line_accuracy"), F.avg("interpolation_distance_normalized").alias("line_distance"),
        F.avg("off_axis_drift_normalized").alias("line_drift"), F.max("separation").alias("separation"),
    )
    near = test.where("target_ratio > 0 and target_ratio < 1").join(train.select(*keys, F.col("target_ratio").alias("r"), "centre"), keys)
    near = near.select(*keys, "run_id", "target_ratio", "r", F.greatest(dot("v", "v") + dot("centre", "centre") - 2 * dot("v", "centre"), F.lit(0.0)).alias("d2"))
    best = near.groupBy(*keys, "run_id", "target_ratio").agg(F.min_by("r", F.struct(F.round("d2", 12), "r")).alias("nearest"), F.min("d2").alias("least"), F.max(F.when(F.col("r") == F.col("target_ratio"), F.col("d2"))).alias("own"))
    wide = F.when(F.col("separation") > EPS, F.col("separation") + EPS)
    centroid = best.join(line.select(*keys, "separation"), keys).groupBy(*keys).agg(
        F.avg(F.abs(F.col("nearest") - F.col("target_ratio"))).alias("centroid_error"), F.avg((F.col("nearest") == F.col("target_ratio")).cast("double")).alias("nearest_accuracy"),
        F.avg(F.sqrt("own") / wide).alias("centroid_distance"), F.avg(F.sqrt("least") / wide).alias("centroid_drift"),
    )
    return line.drop("separation").join(centroid, keys)


def piecewise_line(points: DataFrame, by: list[str], seeds: int = 3) -> DataFrame:
    """Each seed's interior points against the line through the other seeds' mean points, piece by piece: error of the
    closest place's ratio, share of points to whose place no other ratio is nearer, and distance in units of the mean
    endpoints' separation. Collapsed endpoints give nulls."""
    p, train = seed_centres(points, by, seeds)
    keys = [*by, "held_seed"]
    w = Window.partitionBy(*keys).orderBy("target_ratio")  # as many rows as there are ratios
    pieces = train.withColumn("next", F.lead("centre").over(w)).withColumn("r1", F.lead("target_ratio").over(w)).where("next is not null").select(*keys, F.col("target_ratio").alias("r0"), "r1", F.col("centre").alias("s"), F.col("next").alias("e"))
    ends = train.groupBy(*keys).agg(F.max(F.when(F.col("target_ratio") == 0, F.col("centre"))).alias("a"), F.max(F.when(F.col("target_ratio") == 1, F.col("centre"))).alias("b"), F.collect_set("target_ratio").alias("ratios"))
    ends = ends.where("a is not null and b is not null").select(*keys, "ratios", F.sqrt(F.greatest(dot("a", "a") + dot("b", "b") - 2 * dot("a", "b"), F.lit(0.0))).alias("separation"))
    test = p.where("target_ratio > 0 and target_ratio < 1").select(*by, F.col("seed").alias("held_seed"), "run_id", "target_ratio", "v")
    met = test.join(pieces, keys).select(*keys, "run_id", "target_ratio", "r0", "r1", (dot("e", "e") + dot("s", "s") - 2 * dot("s", "e")).alias("long"), (dot("v", "e") - dot("v", "s") - dot("s", "e") + dot("s", "s")).alias("along"), (dot("v", "v") + dot("s", "s") - 2 * dot("v", "s")).alias("d2"))
    part = F.when(F.col("long") <= EPS, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("along") / F.col("long"))))
    met = met.withColumn("part", part).withColumn("d2", F.greatest(F.col("d2") - 2 * F.col("part") * F.col("along") + F.col("part") ** 2 * F.col("long"), F.lit(0.0))).withColumn("place", F.col("r0") + F.col("part") * (F.col("r1") - F.col("r0")))
    best = met.groupBy(*keys, "run_id", "target_ratio").agg(F.min(F.struct(F.round("d2", 12), "r0", "place", "d2")).alias("m")).select(*keys, "target_ratio", "m.place", "m.d2").join(ends, keys)
    nearest = F.array_min(F.transform("ratios", lambda r: F.struct(F.abs(r - F.col("place")), r.alias("r"))))["r"]
    kept = lambda x: F.avg(F.when(F.col("separation") > EPS, x))
    return best.groupBy(*keys).agg(kept(F.abs(F.col("place") - F.col("target_ratio"))).alias("piecewise_error"), kept((nearest == F.col("target_ratio")).cast("double")).alias("piecewise_accuracy"), kept(F.sqrt("d2") / (F.col("separation") + EPS)).alias("piecewise_drift"))


def pooled_anchors(points: DataFrame, by: list[str], contributors: int | None = None) -> DataFrame:
    """by, a, b: the mean endpoint vectors over all contributing models and seeds, not normalised again."""
    mean = points.where("target_ratio in (0.0, 1.0)").groupBy(*by, "target_ratio").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = mean.groupBy(*by).agg(F.max(F.when(F.col("target_ratio") == 0, F.col("m"))).alias("a"), F.max(F.when(F.col("target_ratio") == 1, F.col("m"))).alias("b"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    if contributors is not None:
        wrong = F.raise_error(F.lit("an anchor has another number of contributors"))
        rows = rows.withColumn("a", F.when((F.col("lo") == contributors) & (F.col("hi") == contributors), F.col("a")).otherwise(wrong.cast("array<double>")))
    return rows.where("a is not null and b is not null").select(*by, "a", "b")


def external_anchors(references: DataFrame, by: list[str]) -> DataFrame:
    """References with endpoint 'A' or 'B' and a vector, one pair for each scenario; half a pair is an error."""
    pair = references.groupBy(*by).agg(F.max(F.when(F.col("endpoint") == "A", F.col("v"))).alias("a"), F.max(F.when(F.col("endpoint") == "B", F.col("v"))).alias("b"))
    missing = F.raise_error(F.lit("a scenario lacks one of its reference endpoints")).cast("array<double>")
    return pair.withColumn("a", F.coalesce("a", missing)).withColumn("b", F.coalesce("b", missing))


def cosine_similarity(a: str, b: str) -> F.Column:
    """Null for vectors of length zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return no_nan(F.when(size > 0, dot(a, b) / size))


def legacy_projection(points: DataFrame, by: list[str] = TRAJECTORY) -> DataFrame:
    """The first generation's sample rows: groups without both ends are left out, the first output (by run_id) at each end is
    the anchor, a collapsed pair gives 0.5, distances are not normalised, and a rank counts strictly closer outputs only."""
    end = lambda r, c: F.min_by(c, F.when(F.col("target_ratio") == r, F.col("run_id")))
    ends = points.where("target_ratio in (0.0, 1.0)").groupBy(*by).agg(end(0.0, "v").alias("a"), end(1.0, "v").alias("b"), F.min(F.when(F.col("target_ratio") == 0, F.col("run_id"))).alias("a_run_id"), F.min(F.when(F.col("target_ratio") == 1, F.col("run_id"))).alias("b_run_id"))
    s = with_geometry(points, ends.where("a_run_id is not null and b_run_id is not null"), by)
    other = s.select(*by, F.col("from_a").alias("_d"), F.col("along").alias("_s"), F.col("run_id").alias("_id"))
    far = F.greatest(F.col("_d") ** 2 - 2 * F.col("target_ratio") * F.col("_s") + (F.col("target_ratio") * F.col("separation")) ** 2, F.lit(0.0))
    own = F.greatest(F.col("from_a") ** 2 - 2 * F.col("target_ratio") * F.col("along") + (F.col("target_ratio") * F.col("separation")) ** 2, F.lit(0.0))
    closer = s.select(*by, "run_id", "target_ratio", "separation", "from_a", "along").join(other, by).groupBy(*by, "run_id").agg((1 + F.count_if((F.col("_id") != F.col("run_id")) & (far < own - 1e-13))).alias("rank"))
    raw = F.coalesce("coordinate", F.lit(0.5))
    return s.join(closer, [*by, "run_id"]).select(
        *by, "run_id", "target_ratio", "a_run_id", "b_run_id", raw.alias("raw"), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).alias("clipped"), F.sqrt(own).alias("interpolation_distance"),
        F.coalesce("off_axis", F.col("from_a")).alias("off_axis_drift"), "rank",
    )


def gated_samples(samples: DataFrame, by: list[str] = TRAJECTORY, complete: int = 7, most: float = 1e-6) -> DataFrame:
    """Sample rows; a trajectory with another number of points, or a projection whose parts do not add up, fails the job."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    bad = F.when(n != complete, F.raise_error(F.concat(F.lit("points in a trajectory: "), n.cast("string")))).when(F.col("residual") >= most, F.raise_error(F.lit("the parts of a projection do not add up")))
    return samples.withColumn("residual", F.coalesce(bad.cast("double"), F.col("residual")))

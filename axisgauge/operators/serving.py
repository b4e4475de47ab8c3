"""Serving telemetry: peaks inside run windows, latency summaries, Pareto frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisgauge.functions.lineage import cut
from axisgauge.functions.quantiles import aggregated


def window_peaks(telemetry: DataFrame, windows: DataFrame, width: float = 3600.0) -> DataFrame:
    """telemetry (ts, device, value) in windows (model_id, start, stop, devices): devices seen and the sum of their
    peaks, null unless all were seen. Time is cut into buckets of `width` seconds; a window stands in each bucket that it
    touches, and a sample meets only the windows of its own device and bucket. Windows that end before they start are empty."""
    clock = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if dict(telemetry.dtypes)["ts"].startswith("timestamp") else F.col(c).cast("double")
    bucket = lambda c: F.floor(clock(c) / width)
    w = windows.where("start <= stop").select("model_id", "start", "stop", F.size("devices").alias("k"), F.explode("devices").alias("device"))
    w = w.withColumn("_b", F.explode(F.sequence(bucket("start"), bucket("stop"))))
    peaks = telemetry.withColumn("_b", bucket("ts")).join(w, ["device", "_b"]).where("ts between start and stop").groupBy("model_id", "k", "device").agg(F.max("value").alias("peak"))
    return peaks.groupBy("model_id", "k").agg(F.count(F.lit(1)).alias("devices"), F.sum("peak").alias("s")).select("model_id", "devices", F.when(F.col("devices") == F.col("k"), F.col("s")).alias("peak_sum"))


def latency(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    return aggregated(rows, by, [F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("total")], {"p50": (seconds, 0.5), "p95": (seconds, 0.95)})


def pareto(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rows that no other row of the group beats in both columns (less is better; equal rows stay). The least y of each x
    is dealt by ranges of x; a range needs only the least y of the ranges before it, one number for each group and range."""
    by = by or []
    least = cut(rows.groupBy(*by, x).agg(F.min(y).alias("_y")).repartitionByRange(*by, x).withColumn("_p", F.spark_partition_id()))  # written, so that both reads see the same ranges
    ranges = least.groupBy(*by, "_p").agg(F.min("_y").alias("_least"))  # a row for each group and range
    earlier = ranges.withColumn("_earlier", F.min("_least").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    w = Window.partitionBy(*by, "_p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    before = F.least(F.min("_y").over(w), F.col("_earlier"))
    front = least.join(earlier, [*by, "_p"]).withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_y") < F.col("_before")))
    return rows.join(front.select(*by, x, F.col("_y").alias(y)), [*by, x, y], "left_semi")


def throughput(requests: DataFrame, groups: DataFrame, latency_column: str) -> DataFrame:
    """By model: requests, tokens over the wall-clock span, mean rate of single requests, tokens, retries, latencies, and the
    comparison group (null where a model has none). requests: model_id, ts, seconds, output_tokens, retries."""
    span = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    rate = F.col("output_tokens") / F.when(F.col("seconds") > 0, F.col("seconds"))
    t = aggregated(requests, ["model_id"], [
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("output_tokens").cast("double"), span).alias("tokens_per_second"), F.avg(rate).alias("mean_request_rate"), F.sum("output_tokens").alias("tokens"), F.sum("retries").alias("retries"),
    ], {"p50": (latency_column, 0.5), "p95": (latency_column, 0.95)})
    return t.join(F.broadcast(groups), "model_id", "left")  # a row for each model


def exact_group(rows: DataFrame, group: str, name: str, expected: int) -> DataFrame:
    """The rows of one comparison group, which must have the expected number; any other number, none too, is an error."""
    own = rows.where(F.col(group) == name)
    wrong = F.raise_error(F.concat(F.lit(f"{name} has another number of rows than {expected}: "), F.col("n").cast("string"))).cast("string")
    right = own.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == expected, F.lit(name)).otherwise(wrong).alias("_name"))
    return own.crossJoin(F.broadcast(right)).withColumn(group, F.col("_name")).drop("_name")  # one row

"""Advice from metric records, one row a request; records of failed requests don't count.

Each rule is one aggregation over the records, so only a row comes out of any number of them. Columns used: ts (order),
operation, has_predicate, had_error, spilled, temp_bytes_written, temp_bytes_read, rows_scanned, rows_matched,
queue_depth, workers_busy, queue_timeout_total, total_ns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rules' thresholds.
LEAST_SAMPLES, SATURATED_PERCENT, LEAST_EDGES = 20, 30, 3
SPILLED_PERCENT = 25
LEAST_LATENCIES, SPIKE_FACTOR, SPIKE_NS, LEAST_SPIKES = 30, 4, 5_000_000, 3
#: Records of so many microseconds are ordered in one task.
BUCKET = 3_600_000_000
#: Latencies are counted by ranges of 2 to this power nanoseconds, about a millisecond.
RANGE_BITS = 20

SCHEMA = (
    "ts long, operation string, has_predicate boolean, had_error boolean, spilled boolean, temp_bytes_written long, temp_bytes_read long, rows_scanned long, rows_matched long, "
    "queue_depth long, workers_busy long, queue_timeout_total long, total_ns long"
)


def confidence(count: Column) -> Column:
    return F.when(count >= 30, "high").when(count >= 10, "medium").otherwise("low")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def timeout_edges(records: DataFrame) -> DataFrame:
    """(edges): how often the timeout counter rose from one record to the next. Windows over ranges of time, then over
    the ranges' first and last counters."""
    order = Window.partitionBy("bucket").orderBy("ts", "queue_timeout_total")
    own = records.select("ts", "queue_timeout_total", F.floor(F.col("ts") / BUCKET).alias("bucket"))
    own = own.withColumn("before", F.lag("queue_timeout_total").over(order))
    ranges = own.groupBy("bucket").agg(
        _count(F.col("queue_timeout_total") > F.col("before")).alias("inside"), F.min_by("queue_timeout_total", F.struct("ts", "queue_timeout_total")).alias("first"), F.max_by("queue_timeout_total", F.struct("ts", "queue_timeout_total")).alias("last")
    )
    ranges = ranges.withColumn("previous", F.lag("last").over(Window.orderBy("bucket")))  # a row a range of time
    return ranges.agg(F.coalesce(F.sum("inside") + _count(F.col("first") > F.col("previous")), F.lit(0)).alias("edges"))


def queue_pressure(records: DataFrame) -> DataFrame:
    """(samples, saturated, edges, triggered, severity, confidence)."""
    good = records.where("not had_error")
    counts = good.agg(F.count("*").alias("samples"), _count((F.col("workers_busy") > 0) & (F.col("queue_depth") >= F.col("workers_busy"))).alias("saturated"))
    out = counts.join(timeout_edges(good), F.lit(True))  # a row each
    enough, edges = F.col("samples") >= LEAST_SAMPLES, F.col("edges") >= LEAST_EDGES
    triggered = enough & ((F.col("saturated") * 100 >= F.col("samples") * SATURATED_PERCENT) | edges)
    critical = edges & (F.col("saturated") * 100 >= F.col("samples") * 50) & (F.col("samples") > 0)
    return out.select("samples", "saturated", "edges", triggered.alias("triggered"), F.when(critical, "critical").otherwise("warning").alias("severity"), confidence(F.col("samples")).alias("confidence"))


def spill_ratio(records: DataFrame) -> DataFrame:
    """(samples, spills, triggered, severity, confidence)."""
    spilled = F.col("spilled") | (F.col("temp_bytes_written") > 0) | (F.col("temp_bytes_read") > 0)
    out = records.where("not had_error").agg(F.count("*").alias("samples"), _count(spilled).alias("spills"))
    part = F.col("spills") * 100
    return out.select("samples", "spills", ((F.col("samples") >= LEAST_SAMPLES) & (part >= F.col("samples") * SPILLED_PERCENT)).alias("triggered"), F.when((F.col("samples") > 0) & (part >= F.col("samples") * 50), "critical").otherwise("warning").alias("severity"), confidence(F.col("samples")).alias("confidence"))


def low_selectivity(records: DataFrame) -> DataFrame:
    """(predicates, low, lowest_ppm, confidence): predicates that match less than half of what they scan."""
    own = records.where("not had_error and has_predicate and rows_scanned > 0 and operation in ('select', 'update', 'delete')")
    ppm = F.call_function("div", F.col("rows_matched") * 1_000_000, F.col("rows_scanned"))
    out = own.agg(F.count("*").alias("predicates"), _count(F.col("rows_matched") * 2 < F.col("rows_scanned")).alias("low"), F.least(F.coalesce(F.min(ppm), F.lit(1_000_000)), F.lit(1_000_000)).cast("long").alias("lowest_ppm"))
    return out.select("predicates", "low", "lowest_ppm", confidence(F.col("low")).alias("confidence"))


def middle(own: DataFrame) -> DataFrame:
    """(a, b): the two values of total_ns in the middle, equal for an odd number of rows; one row, of nulls for no rows.

    Rows are counted by ranges of values; only the ranges that hold the middle, one or two, are put in order, as the
    counts of their distinct values. So no task holds more than the ranges or the values of a range.
    """
    own = own.withColumn("range", F.shiftright("total_ns", RANGE_BITS))
    sizes = own.groupBy("range").agg(F.count("*").alias("n"))
    sizes = sizes.select("range", "n", F.sum("n").over(Window.orderBy("range")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))  # a row a range
    sizes = sizes.withColumns({"before": F.col("upto") - F.col("n"), "low": F.expr("(total + 1) div 2"), "high": F.expr("total div 2 + 1")})
    holds = lambda rank: (F.col("upto") >= F.col(rank)) & (F.col("before") < F.col(rank))
    chosen = sizes.where(holds("low") | holds("high")).select("range", "before", "low", "high")
    values = own.join(F.broadcast(chosen), "range").groupBy("range", "before", "low", "high", "total_ns").agg(F.count("*").alias("n"))  # the broadcast is of two rows at most
    values = values.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("total_ns"))).withColumn("before", F.col("upto") - F.col("n"))
    return values.agg(*[F.max(F.when(holds(rank), F.col("total_ns"))).alias(name) for rank, name in (("low", "a"), ("high", "b"))])


def latency_spikes(records: DataFrame) -> DataFrame:
    """(samples, spikes, median_ns, threshold_ns, max_ns, triggered, severity, confidence). The median of an even number
    is the sum of the halves, rounded down, of the two in the middle."""
    own = records.where("not had_error and total_ns > 0").select("total_ns")
    stats = own.agg(F.count("*").alias("samples"), F.max("total_ns").alias("max_ns")).join(middle(own), F.lit(True))  # a row each
    halves = F.when(F.col("samples") % 2 == 1, F.col("a")).otherwise(F.expr("a div 2") + F.expr("b div 2"))
    enough = F.col("samples") >= LEAST_LATENCIES
    stats = stats.withColumn("median_ns", F.when(enough, halves).otherwise(0))
    stats = stats.withColumn("threshold_ns", F.when(enough, F.greatest(F.col("median_ns") * SPIKE_FACTOR, F.col("median_ns") + SPIKE_NS)).otherwise(0))
    spikes = own.join(F.broadcast(stats.select("threshold_ns")), F.lit(True)).agg(_count(F.col("total_ns") >= F.col("threshold_ns")).alias("n"))  # the broadcast is one row
    out = stats.join(spikes, F.lit(True)).withColumn("spikes", F.when(enough, F.col("n")).otherwise(0))
    severity = F.when((F.col("samples") > 0) & (F.col("spikes") * 100 >= F.col("samples") * 20), "critical").otherwise("warning")
    return out.select("samples", "spikes", "median_ns", "threshold_ns", F.coalesce("max_ns", F.lit(0)).alias("max_ns"), (F.col("spikes") >= LEAST_SPIKES).alias("triggered"), severity.alias("severity"), confidence(F.col("samples")).alias("confidence"))


RULES = {"queue_pressure": queue_pressure, "spill_ratio": spill_ratio, "low_selectivity": low_selectivity, "latency_spikes": latency_spikes}

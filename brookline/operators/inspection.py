"""Plan inspection: what Catalyst made of a pipeline, with reason codes, and the state of the runtime."""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

#: Physical operators and what their choice says.
REASONS = {
    "BroadcastHashJoin": "join_broadcast_small_side", "SortMergeJoin": "join_sort_merge_large_sides", "ShuffledHashJoin": "join_hash_of_shuffled_sides", "HashAggregate": "aggregate_hash", "SortAggregate": "aggregate_sort",
    "TakeOrderedAndProject": "sort_top_k", "Sort": "sort_external", "WindowGroupLimit": "window_limit_pushed_down", "Window": "window_per_parent",
}


def operators(df: DataFrame) -> Counter:
    """Physical operators by name, of the plan before execution."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"^[\s:+\-*]*(?:\(\d+\) )?(\w+)", plan, re.MULTILINE))


def pushed(df: DataFrame) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for found in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if found for x in found.split(", ")]


def inspected(df: DataFrame) -> str:
    """The block that follows the rows of an inspected pipeline."""
    found = operators(df)
    lines = ["INSPECT plan " + " ".join(f"{k}={n}" for k, n in sorted(found.items()) if k != "AdaptiveSparkPlan")]
    lines += [f"INSPECT reason {r}" for k, r in REASONS.items() if found[k]]
    lines += [f"INSPECT pushed {x}" for x in pushed(df)]
    return "\n".join(lines) + "\n"


def runtime(spark: SparkSession) -> str:
    """The runtime's state as JSON."""
    tracker = spark.sparkContext.statusTracker()
    return json.dumps({"parallelism": spark.sparkContext.defaultParallelism, "active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds()), "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "adaptive": spark.conf.get("spark.sql.adaptive.enabled") == "true"})

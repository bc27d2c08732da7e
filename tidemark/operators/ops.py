"""Collection logs, metrics and users' alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Adapter error codes, their category and whether a retry may help.
ERROR_CODES = {
    "timeout": ("timeout", True), "rate_limited": ("rate_limited", True), "adapter_unavailable": ("temporary_failure", True), "temporary_retailer_failure": ("temporary_failure", True),
    "invalid_retailer_response": ("validation", False), "product_not_found": ("permanent", False), "unsupported_operation": ("permanent", False), "adapter_disabled": ("permanent", False),
    "adapter_misconfigured": ("configuration", False), "unexpected_adapter_failure": ("unexpected", False),
}


def job_status(ok: Column, failed: Column) -> Column:
    return F.when((failed > 0) & (ok > 0), "partial").when(failed > 0, "failed").otherwise("success")


def run_rollup(jobs: DataFrame, *keys: str) -> DataFrame:
    """Status of a run from its jobs: all success, all failed, or partial."""
    n = F.count("*")
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    return jobs.groupBy(*keys).agg(F.when(good == n, "success").when(bad == n, "failed").otherwise("partial").alias("status"), n.alias("jobs"))


def classify_errors(rows: DataFrame, code: str) -> DataFrame:
    """Category and retryability of error codes; unknown codes are unexpected and not retried."""
    words = F.create_map(*(x for k, (c, r) in ERROR_CODES.items() for x in (F.lit(k), F.struct(F.lit(c).alias("category"), F.lit(r).alias("retryable")))))
    hit = words[F.lower(code)]
    return rows.withColumns({"category": F.coalesce(hit["category"], F.lit("unexpected")), "retryable": F.coalesce(hit["retryable"], F.lit(False))})


def pending(jobs: DataFrame, finished: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Jobs whose key hasn't come to an end before."""
    return jobs.join(finished.where(F.col("status").isin("success", "partial")).select(key).distinct(), key, "left_anti")


def bucketed(log: DataFrame, minutes: int, *keys: str) -> DataFrame:
    """Counts, error rate and exact percentiles per tumbling window."""
    window = F.window("ts", f"{minutes} minutes")
    bad = F.count_if(F.col("failed"))
    return log.groupBy(window, *keys).agg(
        F.count("*").alias("events"), bad.alias("errors"), F.round(bad * 100.0 / F.count("*"), 4).alias("error_rate"),
        F.round(F.percentile("value", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"), F.max("value").alias("max_value"),
    ).select(F.col("window.start").alias("window_start"), *keys, "events", "errors", "error_rate", "p50", "p95", "max_value")


def threshold_alerts(log: DataFrame, minutes: int = 15, step: int = 5, max_rate: float = 5.0, max_failures: int = 5, max_p95: float = 5000.0) -> DataFrame:
    """Sliding windows in which a limit is broken, evaluated every `step` minutes."""
    window = F.window("ts", f"{minutes} minutes", f"{step} minutes")
    bad = F.count_if(F.col("failed"))
    rows = log.groupBy(window).agg(F.count("*").alias("events"), bad.alias("errors"), F.round(bad * 100.0 / F.count("*"), 4).alias("error_rate"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"))
    fired = F.array_compact(F.array(F.when(F.col("error_rate") > max_rate, F.lit("error_rate")), F.when(F.col("errors") > max_failures, F.lit("failures")), F.when(F.col("p95") > max_p95, F.lit("p95"))))
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events", "errors", "error_rate", "p95", F.array_join(fired, ",").alias("alerts")).where("alerts <> ''")


#: The rules with their own windows in minutes, what they measure and the limit that it must exceed.
RULES = (("error_rate", 15, "error_rate", 5.0), ("failures", 30, "errors", 5.0), ("p95", 15, "p95", 5000.0))


def rule_alerts(log: DataFrame, rules: tuple = RULES, step: int = 5) -> DataFrame:
    """(rule, window_start, window_end, events, value) of every window, `step` minutes apart, in which a rule's measure exceeds its limit.

    Rules look back as far as each says; those of the same length share their windows.
    """
    found = []
    for minutes in sorted({r[1] for r in rules}):
        own = [r for r in rules if r[1] == minutes]
        bad, n = F.count_if(F.col("failed")), F.count("*")
        measures = {"errors": bad.cast("double"), "error_rate": F.round(bad * 100.0 / n, 4), "p95": F.round(F.percentile("value", F.lit(0.95)), 4)}
        used = dict.fromkeys(r[2] for r in own)
        rows = log.groupBy(F.window("ts", f"{minutes} minutes", f"{step} minutes").alias("w")).agg(n.alias("events"), *(measures[m].alias(m) for m in used))
        told = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(m).alias("value"), F.lit(float(limit)).alias("limit")) for name, _, m, limit in own))).alias("r")
        found.append(rows.select("w", "events", told).where("r.value > r.limit").select("r.rule", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "r.value"))
    return reduce(DataFrame.unionAll, found)


def stale_sources(ages: DataFrame, seconds: int = 86_400) -> DataFrame:
    return ages.where(F.col("age_seconds") > seconds)


def price_alerts(rules: DataFrame, lowest: DataFrame) -> DataFrame:
    """Enabled rules whose product's lowest verified price is at or below the threshold, in the same currency."""
    joined = rules.where("is_enabled").join(lowest, ["product_id", "currency"])
    return joined.where(F.col("verified_paise") <= F.col("threshold_paise")).withColumn("margin_paise", F.col("threshold_paise") - F.col("verified_paise"))


def user_counts(lists: DataFrame) -> DataFrame:
    """Watched and saved products per user, each counted once."""
    distinct = lists.select("user_id", "list", "product_id").distinct()
    return distinct.groupBy("user_id").agg(F.count_if(F.col("list") == "watch").alias("watched"), F.count_if(F.col("list") == "saved").alias("saved"))

"""Hand-computed histories."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import history as H

NOW = dt.datetime(2024, 6, 1, 12)
SCHEMA = "snapshot_id string, product_id long, listing_id long, seller_id long, retailer_id int, observed_at timestamp, created_at timestamp, displayed_paise long, effective_paise long, confidence string"


def points(spark, rows):
    """rows: (days before now, displayed, effective, confidence, listing, seller)"""
    made = []
    for i, (days, shown, effective, confidence, listing, seller) in enumerate(rows):
        at = NOW - dt.timedelta(days=days)
        made.append((f"s{i}", 1, listing, seller, 0, at, at, shown, effective, confidence))
    return spark.createDataFrame(made, SCHEMA)


def now():
    return F.lit(NOW.isoformat(sep=" ")).cast("timestamp")


SERIES = [(200, 60000, None, "high", 1, None), (100, 50000, None, "medium", 1, None), (40, 40000, None, "high", 1, None), (10, 30000, None, "high", 1, None), (3, 20000, None, "high", 1, None), (0, 10000, None, "high", 1, None), (1, 100, None, "low", 1, None)]


def test_full_record(spark):
    r = H.variant_history(points(spark, SERIES), now()).first()
    assert (r.avg_7d, r.n_7d, r.avg_30d, r.n_30d, r.avg_90d, r.n_90d, r.avg_180d, r.n_180d) == (15000, 2, 20000, 3, 25000, 4, 30000, 5)
    assert (r.low_paise, r.high_paise, r.percentile, r.change_percent, r.is_drop, r.baseline_paise) == (10000, 60000, 16.6667, -50.0, True, 20000)
    assert (r.qualifying, r.trend) == (6, "falling")
    q = H.quality_counts(points(spark, SERIES), "product_id").first()
    assert (q.qualifying, q.excluded) == (6, 1)


def test_effective_price_counts(spark):
    assert H.window_averages(points(spark, [(3, 20000, 15000, "high", 1, None), (1, 18000, 12000, "high", 1, None)]), now()).first().avg_7d == 13500


def test_changes_stay_in_their_series(spark):
    rows = points(spark, [(9, 30000, None, "high", 1, 7), (8, 10000, None, "high", 1, 8), (7, 28000, None, "high", 1, 7), (6, 5000, None, "high", 2, None)])
    got = {r.snapshot_id: (r.baseline_paise, r.is_drop, r.change_reason) for r in H.changes(rows, "product_id", "listing_id", "seller_id").collect()}
    assert got == {"s0": (None, None, "no_comparison_baseline"), "s1": (None, None, "no_comparison_baseline"), "s2": (30000, True, None), "s3": (None, None, "no_comparison_baseline")}


def test_short_histories_have_reasons(spark):
    one = H.variant_history(points(spark, [(1, 100, None, "high", 1, None)]), now()).first()
    assert (one.percentile, one.volatility, one.trend, one.trend_reason) == (None, None, "insufficient_history", "below_minimum_observation_count")
    same_time = H.variant_history(points(spark, [(1, 100, None, "high", 1, None), (1, 200, None, "high", 1, None)]), now()).first()
    assert (same_time.trend, same_time.trend_reason) == ("insufficient_history", "zero_time_span")
    assert H.variant_history(points(spark, []), now()).count() == 0


def test_stable_trend_and_ties(spark):
    r = H.variant_history(points(spark, [(10, 10000, None, "high", 1, None), (5, 10100, None, "high", 1, None), (0, 10100, None, "high", 1, None)]), now()).first()
    assert r.trend == "stable" and r.high_snapshot_id == "s1"


def test_partitioning_does_not_matter(spark):
    a = H.variant_history(points(spark, SERIES), now()).collect()
    b = H.variant_history(points(spark, SERIES[::-1]).repartition(3), now())
    drop = [c for c in b.columns if "snapshot" in c]
    assert b.drop(*drop).collect() == spark.createDataFrame(a, b.schema).drop(*drop).collect()

"""Plans: how often the fact is read, and that no join goes without equal keys."""

import pytest

from tidemark.operators import history
from tidemark.plans import registry
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "scans"),
    [("his2_window_averages", 1), ("his13_variant_history", 1), ("cmp1_latest_per_seller", 1), ("cmp5_priced_offers", 0), ("cmp15_lowest_verified", 0), ("sal5_in_events", 1), ("sal6_event_stats", 0), ("sal8_overall", 0), ("sal10_discounted", 1), ("sal13_windows", 0), ("fea5_features", 0), ("fea9_labels", 2), ("mod5_predictions", 0), ("rec9_decisions", 0)],
)
def test_the_fact_is_read_seldom(spark, name, scans):
    assert plan(registry.queries()[name](spark, SF)).count("lineitem.parquet") <= scans


@pytest.mark.parametrize("name", ["sal4_applicable", "sal5_in_events", "sal6_event_stats", "fea1_visible", "fea5_features", "rec7_events_ahead", "rec9_decisions"])
def test_events_meet_rows_on_equal_keys(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_variants_are_combined_before_they_meet(spark):
    """One window, along the series; variants meet in aggregates whose first half runs where the rows are."""
    text = plan(registry.queries()["his13_variant_history"](spark, SF))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "listing_id" in windows[0]


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.queries()["ops5_pages"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type)" in text and "ts:timestamp" in text
    assert "l_comment" not in plan(registry.queries()["his2_window_averages"](spark, SF))


def test_a_bucketed_fact_is_not_shuffled(spark, tmp_path):
    fact = tables.bucketed(tables.snapshots(spark, SF), "bucketed_fact", str(tmp_path / "fact"), 4)
    drops = history.drop_feed(fact)
    assert "Exchange" not in plan(drops), plan(drops)
    assert drops.count() == history.drop_feed(tables.snapshots(spark, SF)).count()
    assert history.history_of(fact, listing_id=87).count() == history.history_of(tables.snapshots(spark, SF), listing_id=87).count() > 0
    spark.sql("DROP TABLE bucketed_fact")

"""What keeps large tables whole: rows that stay where they are, and work dealt over all tasks."""

import pytest

from pyspark.sql import functions as F

from tests.test_plans import SF, plan
from tidemark.functions.similarity import gram_place, gram_vector
from tidemark.operators import features, history, offers, recommend
from tidemark.plans import match_queries, offer_queries, ops_queries, registry
from tidemark.sources import scratch, tables


@pytest.fixture
def shuffled(spark):
    """Tables too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("made", [lambda s: history.variant_history(tables.snapshots(s, SF), F.current_timestamp()), lambda s: offers.latest(tables.snapshots(s, SF), "product_id", "listing_id", "seller_id")])
def test_rows_of_a_product_are_dealt_once(shuffled, made):
    """The projection deals lines by order, supplier and part; what follows by product deals nothing more."""
    def exchanges(df):
        return plan(df).count("Exchange hashpartitioning")

    assert exchanges(made(shuffled)) == exchanges(tables.snapshots(shuffled, SF))


def test_offers_are_priced_without_a_join(spark):
    text = plan(offer_queries.priced_offers(spark, SF))
    assert "Join" not in text and "Exchange" not in text


def test_adjustments_as_columns_are_their_sums(spark):
    rows = tables.snapshots(spark, SF)
    names = ["verified_off", "possible_off", "has_verified", "unsafe"]
    made = rows.select("snapshot_id", *offers.adjustment_columns(*tables.adjustment())).where("verified_off is not null")
    want = offers.adjustment_sums(tables.adjustments_of(rows)).select("snapshot_id", *names)
    assert made.count() == want.count() > 0 and made.exceptAll(want).count() == 0


def test_small_files_of_parts_are_computed_by_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ops_queries.candidates(spark, SF).rdd.getNumPartitions() == 2 * n
    assert match_queries.mat6_title_attributes(spark, SF).rdd.getNumPartitions() == n


def test_a_gram_is_hashed_once():
    gram_place.cache_clear()
    gram_vector.cache_clear()
    gram_vector("nova", 256)
    hashed = gram_place.cache_info().misses
    gram_vector("nova n", 256)
    assert 0 < gram_place.cache_info().misses - hashed < 6


def test_offers_are_ranked_where_their_product_is(spark):
    """F16, F17: lines are moved by part once; ranks and winners move, join and read nothing more."""
    text = plan(registry.queries()["cmp14_ranked_offers"](spark, SF))
    assert "Exchange hashpartitioning(product_id" not in text and text.count("Exchange hashpartitioning(l_partkey") == 1 and text.count("part.parquet") == 1
    offers_ = offer_queries.priced_offers(spark, SF)
    won = plan(offers.lowest_verified(offers.ranked(offers_)))
    assert "Join" not in won and won.count("Exchange") == 1


def test_feeds_are_parsed_by_all_tasks(spark):
    """no expression of a feed's parser stands below the exchange that deals the parts."""
    lines = plan(registry.queries()["nrm10_quarantine"](spark, SF)).splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning(product_id" in line or "Exchange hashpartitioning(n#" in line]
    assert len(below) == 5 and not any("CASE WHEN" in line or "json" in line or "Filter" in line for line in below)


def test_scores_move_no_row_of_the_dealt_fact(shuffled):
    """F7 to F9: every series is summed up where its product lies, and meets its history there."""
    at, events = F.lit("1998-01-01 00:00:00").cast("timestamp"), tables.sale_events(shuffled)
    points = scratch.dealt(tables.snapshots(shuffled, SF), "product_id")
    shuffled.conf.unset("spark.sql.autoBroadcastJoinThreshold")  # events are few
    sums = features.totals(points, events, at)
    assert "Exchange hashpartitioning" not in plan(sums) and "Exchange hashpartitioning" not in plan(features.exampled(points, events))
    history = scratch.dealt(points.select("product_id", "retailer_id", "seller_id").groupBy("product_id").agg(F.min("retailer_id").alias("retailer_id"), F.min("seller_id").alias("seller_id")), "product_id")
    scores = points.select("product_id", "retailer_id", "seller_id", "listing_id", F.lit("PREDICTED").alias("status"), F.lit(1).cast("long").alias("predicted_paise"), F.lit(1.0).alias("confidence"))
    shuffled.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Exchange" not in plan(recommend.with_prediction(history, scores))

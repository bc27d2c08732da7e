"""The sweep of features against a plain version: late rows, equal times, many events of one series."""

import datetime as dt
import random

from tidemark.operators.features import feature_table

ROW = "product_id long, listing_id long, seller_id long, retailer_id int, brand string, category string, snapshot_id string, observed_at timestamp, created_at timestamp, confidence string, displayed_paise long, effective_paise long, mrp_paise long"
EVENT = "event_id string, retailer_id int, brand string, category string, start_at timestamp, end_at timestamp, event_type string, source string, confidence string"


def day(n):
    return dt.datetime(2000, 1, 1) + dt.timedelta(hours=12 * n)


def half_up(a, b):
    return (2 * a + b) // (2 * b)


def test_many_events_of_one_series(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        seen = rng.randrange(400)
        made = seen + rng.choice([0, 0, 0, 1, 14, 15, 70, 200])
        rows.append((1, 1, rng.choice([None, 9]), 0, "b", "c", f"s{i:03}", day(seen), day(made), rng.choice(["high", "medium", "low"]), rng.randrange(100, 900), None, 1000))
    rows.append((1, 1, None, 0, "b", "c", "none", None, day(3), "high", 5, None, 1000))
    events = [(f"e{i:02}", None, None, None, day(10 * i), day(10 * i + 3), "kind", "official_api", "high") for i in range(1, 40)]
    got = {(r.seller_id, r.event_id): r for r in feature_table(spark.createDataFrame(rows, ROW), spark.createDataFrame(events, EVENT)).collect()}
    wanted = 0
    for seller in (None, 9):
        mine = [r for r in rows if r[2] == seller and r[9] != "low" and r[7]]
        for e in events:
            T = e[4]
            known = [r for r in mine if r[7] < T and r[8] < T]
            if not known or not any(e[4] <= r[7] <= e[5] for r in mine):
                continue
            wanted += 1
            out = got[(None if seller is None else str(seller), e[0])]
            assert out.current_price == max(known, key=lambda r: (r[7], r[8], r[6]))[10] / 100
            assert (out.historical_low, out.historical_high) == (min(r[10] for r in known) / 100, max(r[10] for r in known) / 100)
            for d, value in ((7, out.avg_7d), (30, out.avg_30d), (90, out.avg_90d)):
                inside = [r[10] for r in known if r[7] >= T - dt.timedelta(days=d)]
                assert value == (half_up(sum(inside), len(inside)) / 100 if inside else None)
            past = [[r[10] for r in known if p[4] <= r[7] <= p[5]] for p in events if p[5] < T]
            past = [p for p in past if p]
            assert out.previous_sale_count == len(past)
            if past:
                assert (out.previous_sale_price, out.previous_sale_low) == (half_up(sum(past[-1]), len(past[-1])) / 100, min(past[-1]) / 100)
    assert wanted == len(got) > 50


def test_labelled_examples_come_from_their_own_rows(spark):
    """F7 to F9, F22: rows of series without an example are left out first; the features are those of all rows. Totals at one time are what the sweep gives."""
    from pyspark.sql import functions as F

    from tidemark.operators import features
    from tidemark.sources.tables import sale_events, snapshots

    points, events = snapshots(spark, "/root/testdata/sf0.001"), sale_events(spark)
    few, every = features.feature_table(points, events), features.feature_table(points, events, features.labels(points, events))
    assert few.count() > 20 and few.exceptAll(every).count() == every.exceptAll(few).count() == 0
    assert features.exampled(points, events).count() * 3 < points.count()
    at = F.lit("1997-11-20 00:00:00").cast("timestamp")
    summed = features.features_at(points, events, at).where("seen_n > 0").select(*every.columns)
    swept = features.feature_table(points, events, features.asked(points, at))
    assert summed.where("previous_sale_count > 0").count() > 20 and summed.exceptAll(swept).count() == swept.exceptAll(summed).count() == 0

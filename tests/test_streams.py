"""Streams with keyed state: what a batch writes, restarts, timers and late rows."""

import datetime as dt
import os
from pathlib import Path

from tidemark.streaming import streams

ROW = "product_id long, listing_id long, seller_id long, snapshot_id string, observed_at timestamp, created_at timestamp, confidence string, displayed_paise long, effective_paise long"


def day(n):
    return dt.datetime(2000, 1, 1) + dt.timedelta(days=n)


def row(listing, at, paise, seller=None, confidence="high"):
    return (listing, listing, seller, f"{listing}-{seller}-{at}-{paise}", day(at), day(at), confidence, paise, None)


def feed(session, folder, rows, stream, schema=ROW):
    """One more file, taken up by the stream restarted from its checkpoint."""
    session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    made = stream(streams.read(session, f"{folder}/in", session.createDataFrame([], schema).schema))
    streams.to_table(made, f"{folder}/out", f"{folder}/cp").awaitTermination()
    return session.read.schema(made.schema).parquet(f"{folder}/out").collect()


def state_bytes(folder):
    return sum(os.path.getsize(p) for p in Path(f"{folder}/cp/state").rglob("*.changelog"))


def test_a_batch_writes_the_state_of_its_own_series(spark, tmp_path):
    session = streams.state_session(spark)
    first = feed(session, tmp_path, [row(i, 1, 100) for i in range(3000)], streams.keyed_drops)
    whole = state_bytes(tmp_path)
    assert first == [] and whole > 0
    second = feed(session, tmp_path, [row(5, 2, 90), row(7, 2, 120), row(8, 2, 10, confidence="low"), row(9, 2, 10, seller=1)], streams.keyed_drops)
    assert [(r.listing_id, r.seller_id, r.price, r.baseline_paise) for r in second] == [(5, None, 90, 100)]
    assert (state_bytes(tmp_path) - whole) * 20 < whole


def test_a_row_behind_its_series_has_no_baseline_and_is_none(spark, tmp_path):
    session = streams.state_session(spark)
    feed(session, tmp_path, [row(1, 10, 100)], streams.keyed_drops)
    feed(session, tmp_path, [row(1, 8, 50)], streams.keyed_drops)
    got = feed(session, tmp_path, [row(1, 11, 60), row(1, 12, 55)], streams.keyed_drops)
    assert sorted((r.price, r.baseline_paise) for r in got) == [(55, 60), (60, 100)]


def test_idle_series_are_cleared_and_late_rows_cut_off(spark, tmp_path):
    session = streams.state_session(spark)
    stream = lambda rows: streams.keyed_drops(rows, "1 day", 10)
    feed(session, tmp_path, [row(1, 1, 100)], stream)
    feed(session, tmp_path, [row(2, 30, 100)], stream)
    feed(session, tmp_path, [row(1, 31, 50), row(2, 31, 90)], stream)
    got = feed(session, tmp_path, [row(2, 5, 200), row(1, 32, 40)], stream)
    assert sorted((r.listing_id, r.price, r.baseline_paise) for r in got) == [(1, 40, 50), (2, 90, 100)]


def test_medians_go_on_over_restarts(spark, tmp_path):
    session = streams.state_session(spark)
    wide = "listing_id long, seller_id long, retailer_id int, category string, brand string, snapshot_id string, observed_at timestamp, created_at timestamp, confidence string, displayed_paise long, effective_paise long"
    made = lambda listing, at, paise, seller: (listing, seller, 1, "c", None, f"{listing}-{at}", day(at), day(at), "high", paise, None)
    stream = lambda rows: streams.keyed_discounts(rows, 25)
    feed(session, tmp_path, [made(1, 1, 100, None), made(1, 2, 200, None), made(2, 1, 0, 3)], stream, wide)
    got = feed(session, tmp_path, [made(1, 3, 110, None), made(1, 4, 80, None), made(2, 2, 0, 3), made(3, 2, 5, 3)], stream, wide)
    assert sorted((r.listing_id, r.seller_id, r.price, r.prior2) for r in got) == [(1, None, 80, 220), (1, None, 110, 300)]


def test_sessions_know_their_listings(spark, tmp_path):
    schema = "observed_at timestamp, series string, `drop` long, scope string, scope_id string"
    made = lambda at, series, drop, scope="r": (day(at), series, drop, "retailer", scope)
    stream = lambda rows: streams.sale_sessions(rows)
    feed(spark, tmp_path, [made(1, "a", 100_000), made(2, "b", 200_000), made(3, "b", 300_000), made(1, "a", 100_000, "alone"), made(2, "a", 100_000, "alone")], stream, schema)
    feed(spark, tmp_path, [made(40, "end", 0, "end")], stream, schema)
    got = feed(spark, tmp_path, [made(2, "c", 900_000), made(80, "end", 0, "end")], stream, schema)  # the first is late
    assert [(r.scope_id, r.start_at, r.end_at, r.observations, r.listings, r.median_drop_percent, r.confidence) for r in got] == [("r", day(1), day(3), 3, 2, 20.0, "medium")]

"""Series in groups: as many calls as groups, with the drops of every series."""

import random
import statistics

import numpy as np

from tests.test_streams import day, feed, row
from tidemark.operators.sales import running_median
from tidemark.streaming import streams


def test_series_of_one_group_are_answered_together(spark, tmp_path):
    session = streams.state_session(spark)
    big = 2**60 + 1  # beyond what a fraction holds
    stream = lambda rows: streams.keyed_drops(rows, groups=1)
    feed(session, tmp_path, [row(1, 1, 100), row(1, 1, 90, big), row(2, 1, 80, 0), row(2, 1, 70)], stream)
    got = feed(session, tmp_path, [row(1, 2, 95), row(1, 2, 91, big), row(1, 3, 60, big), row(2, 2, 75, 0), row(2, 2, 71), row(3, 1, 5)], stream)
    assert sorted((r.listing_id, r.seller_id or -1, r.price, r.baseline_paise) for r in got) == [(1, -1, 95, 100), (1, big, 60, 91), (2, -1, 75, 80)]


def test_medians_of_one_group_are_answered_together(spark, tmp_path):
    """one call for all series of a group, with state over restarts, equal to a plain version."""
    session = streams.state_session(spark)
    wide = "listing_id long, seller_id long, retailer_id int, category string, brand string, snapshot_id string, observed_at timestamp, created_at timestamp, confidence string, displayed_paise long, effective_paise long"
    rng = random.Random(4)
    made = lambda i, at: (rng.randrange(6), rng.choice([None, 0, 2**60 + 1]), 1, "c", None, f"s{i:04}", day(at), day(at), "high", None if i % 50 == 7 else rng.randrange(1, 9) * 100, None)
    parts = [[made(100 * at + i, at + i / 1000) for i in range(100)] for at in range(3)]
    stream = lambda rows: streams.keyed_discounts(rows, 25, groups=1)
    for part in parts:
        got = feed(session, tmp_path, part, stream, wide)
    want, seen = [], {}
    for r in sorted((r for part in parts for r in part if r[9] is not None), key=lambda r: r[6]):
        prices = seen.setdefault(r[:2], [])
        middle = statistics.median(prices) if prices else 0
        if middle and 100 * (middle - r[9]) >= 25 * middle:
            want.append((r[5], *r[:2], r[9], int(2 * middle)))
        prices.append(r[9])
    assert sorted((r.snapshot_id, r.listing_id, r.seller_id, r.price, r.prior2) for r in got) == sorted(want) and len(want) > 50


def test_medians_go_on_from_sorted_prices():
    rng = np.random.default_rng(4)
    for size, known in ((9, 3), (5000, 0), (5000, 4000), (5000, 5000)):
        prices = rng.integers(1, 700, size)
        prices[:known].sort()
        assert running_median(prices, known) == running_median(prices)[known:]


def test_days_come_from_one_projection_in_ranges_of_rows(spark, monkeypatch):
    """no range of time projects the fact anew; many rows come in more ranges, with the same days."""
    from tests.oracle import connect, same
    from tests.test_plans import SF, plan
    from tidemark.plans import ops_queries, registry

    met, arrive = [], ops_queries._arrive
    monkeypatch.setattr(ops_queries, "_arrive", lambda s, folder, parts, start: met.extend(parts) or arrive(s, folder, parts, start))
    monkeypatch.setattr(ops_queries, "OPEN_ROWS", 1500)
    same(registry.queries()["str2_variants"](spark, SF), registry.oracle_sql()["str2_variants"], connect(SF))
    assert len(met) > 5 and not any("lineitem" in plan(x) for x in met)

"""Rules on single rows: offers, sales, matching, text, model, streams."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.config import MatchingConfig, SalesConfig
from tidemark.functions import text as T
from tidemark.operators import catalog, matching, sales
from tidemark.operators import offers as O

DAY = dt.datetime(2024, 1, 1)
SALE_SCHEMA = "snapshot_id string, product_id long, listing_id long, seller_id long, retailer_id int, brand string, category string, observed_at timestamp, created_at timestamp, displayed_paise long, effective_paise long, confidence string"


def sale_points(spark, rows):
    return spark.createDataFrame([(f"s{i}", 1, listing, None, 1, "b", "c", DAY + dt.timedelta(hours=h), DAY + dt.timedelta(hours=h), p, None, "high") for i, (listing, h, p) in enumerate(rows)], SALE_SCHEMA)


def windows(spark, rows, **kw):
    return sales.detect_windows(sale_points(spark, rows), SalesConfig(), ("listing_id",), **kw).collect()


def test_two_listings_make_a_window(spark):
    found = windows(spark, [(1, 0, 100000), (2, 0, 100000), (1, 48, 70000), (2, 54, 65000)])
    assert sorted((w.scope, w.listings, w.confidence) for w in found) == [("brand", 2, "medium"), ("category", 2, "medium"), ("retailer", 2, "medium")]
    assert {w.median_drop_percent for w in found} == {32.5}


def test_one_listing_or_small_changes_make_none(spark):
    assert windows(spark, [(1, 0, 100000), (1, 48, 50000)]) == []
    assert windows(spark, [(1, 0, 100000), (2, 0, 100000), (1, 48, 98000), (2, 54, 99000)]) == []


def test_gap_of_exactly_two_days_stays_together(spark):
    rows = [(1, 0, 100000), (2, 0, 100000), (1, 100, 50000), (2, 148, 50000)]
    assert len(windows(spark, rows)) == 3
    assert windows(spark, [*rows[:3], (2, 149, 50000)]) == []


def test_running_medians_are_those_of_all_earlier_rows(spark):
    import random
    import statistics

    import numpy as np
    from pyspark.sql.window import Window

    rng = random.Random(4)
    for n in (0, 1, 2, 3, 50, 257):
        prices = [rng.randrange(1, 40) * 100 for _ in range(n)]
        want = [None if not i else round(2 * statistics.median(prices[:i])) for i in range(n)]
        assert sales.running_median(np.array(prices, np.int64)) == want
    rows = sale_points(spark, [(k % 3, k * 5, 100000 - (k * 7919) % 60000) for k in range(200)])
    got = sales.discounted(rows, ["listing_id", "seller_id"]).select("snapshot_id", "prior2").collect()
    before = Window.partitionBy("listing_id").orderBy("observed_at", "created_at", "snapshot_id").rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.withColumn("prior2", (F.percentile("displayed_paise", F.lit(0.5)).over(before) * 2).cast("long")).where("prior2 > 0 and 100 * (prior2 - 2 * displayed_paise) >= 10 * prior2")
    assert sorted(got) == sorted(plain.select("snapshot_id", "prior2").collect()) and len(got) > 10


def test_sellers_of_a_listing_are_series_of_their_own(spark):
    rows = [("s0", 1, 1, 7, 1, "b", "c", DAY, DAY, 100000, None, "high"), ("s1", 1, 1, None, 1, "b", "c", DAY + dt.timedelta(hours=1), DAY, 50000, None, "high"), ("s2", 1, 1, 7, 1, "b", "c", DAY + dt.timedelta(hours=2), DAY, 60000, None, "high")]
    found = sales.discounted(spark.createDataFrame(rows, SALE_SCHEMA), ["listing_id", "seller_id"]).collect()
    assert [(r.snapshot_id, r.prior2) for r in found] == [("s2", 200000)]


def test_labels_need_a_row_known_before_the_event(spark):
    from tidemark.operators import features

    at = lambda d: DAY + dt.timedelta(days=d)
    row = lambda i, seller, seen, recorded, p: (f"s{i}", 1, 1, seller, 1, "b", "c", at(seen), at(recorded), p, None, "high")
    rows = [row(0, 7, 1, 1, 900), row(1, 7, 11, 11, 800), row(2, None, 11, 11, 700), row(3, 9, 2, 12, 600), row(4, 9, 11, 11, 500)]
    events = spark.createDataFrame([("e", None, None, "c", at(10), at(13), "kind", "manual_curation")], "event_id string, retailer_id int, brand string, category string, start_at timestamp, end_at timestamp, event_type string, source string")
    points = spark.createDataFrame(rows, SALE_SCHEMA).withColumn("mrp_paise", F.lit(None).cast("long"))
    assert [(r.seller_id, r.target_paise2, r.target_n) for r in features.labels(points, events).collect()] == [(7, 1600, 1)]
    table = features.feature_table(points, events).collect()
    assert [(r.listing_id, r.seller_id, r.current_price, r.sale_event_id) for r in table] == [(1, "7", 9.0, "e")]


def test_scores_tell_why_there_is_no_price(spark):
    from tidemark.operators import features, model

    at = lambda d: DAY + dt.timedelta(days=d)
    rows = [("s0", 1, 5, 7, 1, "b", "c", at(1), at(1), 900, None, "high"), ("s1", 1, 5, None, 1, "b", "c", at(30), at(30), 800, None, "high"), ("s2", 1, 6, 7, 1, "b", "c", at(1), at(1), 800, None, "low"), ("s3", 1, 4, 7, 0, "b", "c", at(1), at(1), 700, None, "medium")]
    points = spark.createDataFrame(rows, SALE_SCHEMA).withColumn("mrp_paise", F.lit(None).cast("long"))
    events = spark.createDataFrame([("e", None, "b", None, at(20), at(22), "kind", "manual_curation")], "event_id string, retailer_id int, brand string, category string, start_at timestamp, end_at timestamp, event_type string, source string")
    moment = F.lit(at(10)).cast("timestamp")
    none, some = (spark.createDataFrame([(x, y, 0.9, 1.0, 1.0, 10.0)], "p_low double, p_high double, coverage double, rmse double, mae double, mean_target double") for x, y in ((None, None), (-20.0, 3.0)))
    got = [(r.listing_id, r.seller_id, r.status, r.reason, r.predicted_paise, r.lower_paise, r.upper_paise) for r in model.batch_scores(points, events, moment, model.baseline, some).collect()]
    assert got == [(4, 7, "PREDICTED", None, 700, 0, 1000), (5, None, "INSUFFICIENT_DATA", "no_current_price", None, None, None), (5, 7, "PREDICTED", None, 900, 0, 1200), (6, 7, "INSUFFICIENT_DATA", "no_current_price", None, None, None)]
    assert {r.reason for r in model.batch_scores(points, events, moment, model.baseline, none).collect()} == {"no_trained_model"}
    below = lambda t: t.withColumn("predicted", F.lit(-3.0))
    assert {r.predicted_paise for r in model.batch_scores(points, events, moment, below, some).collect()} == {0, None}
    near = features.feature_table(points, events, features.asked(points, moment)).collect()
    assert {(r.sale_event_id, r.days_until_sale) for r in near} == {("e", 10.0)}


def test_predictions_of_another_seller_are_never_taken(spark):
    from tidemark.operators import recommend

    history = spark.createDataFrame([(1, 2, 7), (2, 2, None), (3, 2, 9)], "product_id long, retailer_id int, seller_id long")
    made = spark.createDataFrame([(1, 2, 7, 11, "PREDICTED", 5, 0.5), (2, 2, 8, 12, "PREDICTED", 6, 0.5), (2, 2, None, 14, "PREDICTED", 8, 0.5), (2, 2, None, 13, "PREDICTED", 7, 0.5), (3, 2, 9, 1, "INSUFFICIENT_DATA", None, None)], "product_id long, retailer_id int, seller_id long, listing_id long, status string, predicted_paise long, confidence double")
    assert {r.product_id: r.predicted_paise for r in recommend.with_prediction(history, made).collect()} == {1: 5, 2: 7, 3: None}


def test_event_stats_and_baseline(spark):
    p = sale_points(spark, [(1, 0, 100000), (1, 24 * 7, 80000), (1, 24 * 8, 60000), (1, 24 * 10, 90000)])
    e = spark.createDataFrame([("e", None, None, "c", DAY + dt.timedelta(days=6), DAY + dt.timedelta(days=9))], "event_id string, retailer_id int, brand string, category string, start_at timestamp, end_at timestamp")
    r = sales.event_stats(p, e).first()
    assert (r.average_paise, r.low_paise, r.high_paise, r.baseline_paise, r.n) == (70000, 60000, 80000, 95000, 2)
    assert r.below_percent == 26.3158


def test_missing_fee_is_not_free(spark):
    rows = spark.createDataFrame([("x", "o1", 1, "r", 10000, 12000, None, None, "in_stock", "high", 1, DAY), ("y", "o2", 1, "r", 10000, 12000, 0, None, "in_stock", "high", 1, DAY)], "snapshot_id string, offer_id string, product_id long, retailer_slug string, displayed_paise long, mrp_paise long, delivery_paise long, platform_paise long, availability string, confidence string, seller_score int, observed_at timestamp")
    adj = spark.createDataFrame([("x", "coupon", 500, "verified_eligible"), ("x", "cashback", 900, "conditional"), ("y", "coupon", 20000, "verified_eligible")], "snapshot_id string, kind string, amount_paise long, eligibility string")
    got = {r.offer_id: r for r in O.ranked(O.priced(rows, adj, F.lit("2024-01-01 01:00:00").cast("timestamp"))).collect()}
    assert (got["o1"].verified_paise, got["o1"].estimated_paise, got["o1"].offer_confidence, got["o1"].discount_percent) == (9500, 8600, "low", 16.67)
    assert (got["o2"].verified_paise, got["o2"].estimated_paise, got["o2"].offer_confidence, got["o2"].rank) == (0, None, "high", 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_rules(spark):
    assert one(spark, T.slug(F.lit("  Ab&c -- D!"))) == "ab-c-d"
    assert one(spark, T.slug(F.lit("!!"))) is None
    assert one(spark, T.variant_key(T.normal_attributes(F.create_map(F.lit("Storage"), F.lit(" 1 TB"), F.lit("Colour"), F.lit("RED"))))) == "color=red;storage=1 tb"
    assert one(spark, T.normal_attributes(F.create_map(F.lit("a"), F.lit(" ")))) is None
    assert one(spark, T.redacted(F.lit(" postgres://u:p@h/x password=1 "))) == "postgres://[REDACTED]@h/x password=[REDACTED]"
    assert len(one(spark, T.redacted(F.lit("x" * 2000)))) == 1000


def candidate(cid, side, title, brand, ids=(), attributes=None, category="mobiles"):
    return (cid, side, title, brand, category, [tuple(i) for i in ids], attributes or {})


#: title, brand, identifiers, attributes of both sides, and what must come out
PAIRS = [
    (("Acme Nova 5 128 GB Black", "Acme", [("upc", "012345678905")], {"Storage": "128 GB"}), ("Nova five by Acme", "Acme", [("ean", "0012345678905")], {"Storage": "128GB"}), "SAME_PRODUCT"),
    (("Acme Nova 5 128 GB", "Acme", [("upc", "012345678905")], {}), ("Acme Nova 5 256 GB", "Acme", [("upc", "012345678905")], {}), "NEEDS_REVIEW"),
    (("Acme Nova 5", "Acme", [("upc", "012345678905")], {}), ("Acme Nova 5", "Acme", [("upc", "999999999999")], {}), "DIFFERENT_PRODUCT"),
    (("Acme Nova 5 phone", "Acme", [], {}), ("Case for Acme Nova 5", "Acme", [], {}), "DIFFERENT_PRODUCT"),
    (("Acme Nova 5 128 GB Black", "Acme", [], {}), ("Acme Nova 5 128GB black smartphone", "Acme", [], {}), "SAME_PRODUCT"),
    (("Acme Nova 5 128 GB", "Acme", [], {}), ("Acme Nova 5 64 GB", "Acme", [], {}), "DIFFERENT_PRODUCT"),
    (("Acme Nova 5", "Acme", [], {}), ("Zeta Nova 5", "Zeta", [], {}), "DIFFERENT_PRODUCT"),
    (("Acme Nova 5", "Acme", [], {}), ("Acme Quasar 9", "Acme", [], {}), "DIFFERENT_PRODUCT"),
]


def test_matching_rules(spark):
    rows = [candidate(f"{side[0]}{i}", side, *p[k]) for i, p in enumerate(PAIRS) for k, side in enumerate(("left", "right"))]
    df = spark.createDataFrame([(*r[:4], r[4], r[5], r[6]) for r in rows], "cid string, side string, title string, brand string, category_slug string, identifiers array<struct<kind:string,value:string>>, attributes map<string,string>")
    wanted = spark.createDataFrame([(f"l{i}", f"r{i}", p[2]) for i, p in enumerate(PAIRS)], "left_id string, right_id string, expected string")
    prepared = matching.prepare(df)
    got = {r.left_id: r.classification for r in matching.decide(matching.scored_pairs(prepared, wanted.select("left_id", "right_id"))).collect()}
    assert got == {f"l{i}": p[2] for i, p in enumerate(PAIRS)}
    blocked = {(r.left_id, r.right_id) for r in matching.blocked_pairs(prepared).collect()}
    assert {(f"l{i}", f"r{i}") for i in range(len(PAIRS))} <= blocked
    e = matching.evaluate(matching.decide(matching.scored_pairs(prepared, wanted.select("left_id", "right_id"))), wanted).first()
    assert (e.precision, e.recall, e.accuracy) == (1.0, 1.0, 1.0)


def test_common_words_and_contained_hints_still_pair(spark):
    schema = "cid string, side string, title string, brand string, category_slug string, identifiers array<struct<kind:string,value:string>>, attributes map<string,string>"
    many = [candidate(f"{side[0]}{i}", side, f"{'New ' * (side == 'right')}ring {i} mobile", "Acme") for i in range(110) for side in ("left", "right")]
    made = matching.blocked_pairs(matching.prepare(spark.createDataFrame([*many, many[0]], schema))).collect()
    assert len(made) == 110 * 110 == len(set(made))
    few = matching.blocked_pairs(matching.prepare(spark.createDataFrame(many, schema)), MatchingConfig(max_block=7))
    assert set(few.collect()) == set(made) and few.count() == len(made)
    odd = matching.prepare(spark.createDataFrame([candidate("a", "left", "New", "Acme"), candidate("b", "right", "New", "Acme Ltd"), candidate("c", "right", "Old", "Zeta")], schema))
    assert [tuple(r) for r in matching.blocked_pairs(odd).collect()] == [("a", "b")]
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "left_id string, right_id string")
    assert [tuple(r) for r in matching.blocked_among(odd, asked).collect()] == [("a", "b")]


def test_identifier_forms(spark):
    assert one(spark, matching.barcode(F.lit("0-12345-67890-5"))) == "00012345678905"
    assert one(spark, matching.isbn(F.lit("0-306-40615-2"))) == "9780306406157"
    assert one(spark, matching.isbn(F.lit("080442957X"))) == "9780804429573"
    assert one(spark, matching.identifier_values(F.array(F.struct(F.lit("isbn").alias("kind"), F.lit("0306406152").alias("value"))))) == ["barcode:09780306406157", "isbn:9780306406157"]


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None, DAY, DAY, 5), ("b", 1, None, DAY, DAY + dt.timedelta(hours=1), 6), ("c", 1, 7, DAY, DAY, 7)], "snapshot_id string, listing_id long, seller_id long, observed_at timestamp, created_at timestamp, displayed_paise long")
    path = str(tmp_path / "fact")
    for _ in range(2):
        catalog.append_snapshots(rows, path)
    assert sorted(r.snapshot_id for r in spark.read.parquet(path).collect()) == ["a", "c"]


def test_session_windows_agree_with_islands(spark, tmp_path):
    from tidemark.streaming import streams

    rows = spark.createDataFrame([("retailer", "1", DAY + dt.timedelta(hours=h), "a", 1) for h in (0, 48, 97, 400)], "scope string, scope_id string, observed_at timestamp, series string, `drop` long")
    rows.write.parquet(str(tmp_path / "in"))
    out = streams.sale_sessions(streams.read(spark, str(tmp_path / "in"), rows.schema), c=SalesConfig(min_listings=1))
    out.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.start_at, r.end_at, r.observations) for r in spark.table("sessions").collect())
    assert got == [(DAY, DAY + dt.timedelta(hours=48), 2), (DAY + dt.timedelta(hours=97), DAY + dt.timedelta(hours=97), 1), (DAY + dt.timedelta(hours=400), DAY + dt.timedelta(hours=400), 1)]


def test_stream_finds_every_drop_over_several_batches(spark, tmp_path, monkeypatch):
    from tests.oracle import connect, same
    from tidemark.plans import ops_queries

    monkeypatch.setattr(ops_queries, "_folder", lambda _: str(tmp_path))
    sf = "/root/testdata/sf0.001"
    query, sql = ops_queries.QUERIES["str5_drops"]
    same(query(spark, sf), sql, connect(sf))
    assert len([x for x in (tmp_path / "out" / "_spark_metadata").iterdir() if x.name.isdigit()]) > 2
    assert not any((tmp_path / x).exists() for x in ("in", "cp", "state"))


def test_ingest_cuts_off_late_rows(spark, tmp_path):
    from tidemark.plans import ops_queries
    from tidemark.streaming import streams

    rows = lambda *hours: spark.createDataFrame([(1, DAY + dt.timedelta(hours=h), None) for h in hours], "listing_id long, observed_at timestamp, seller_id long")
    folder = str(tmp_path)
    ops_queries._arrive(spark, folder, [rows(0, 0, 100), rows(100, 10, 60)], lambda r: streams.to_table(streams.ingest(r, "2 days"), f"{folder}/out", f"{folder}/cp"))
    assert sorted(r.observed_at for r in spark.read.parquet(f"{folder}/out").collect()) == [DAY + dt.timedelta(hours=h) for h in (0, 60, 100)]


def test_lines_are_redacted_to_their_full_length(spark):
    from tidemark.plans import feed_queries

    assert feed_queries.nrm12_redacted(spark, "/root/testdata/sf0.001").agg(F.max(F.length("line"))).first()[0] > 200


def test_trees_train_with_all_rounds(spark, monkeypatch):
    import inspect

    from tidemark.config import ModelConfig
    from tidemark.plans import decision_queries

    asked, whole = [], inspect.signature(decision_queries.M.train)

    def train(*a, **k):
        bound = whole.bind(*a, **k)
        bound.apply_defaults()
        asked.append(bound.arguments["c"])

    monkeypatch.setattr(decision_queries.M, "train", train)
    assert decision_queries.mod1_trees(spark, "/root/testdata/sf0.001").count() == 0
    assert asked == [ModelConfig()] and asked[0].rounds == 80


def test_feed_files_with_broken_records(spark, tmp_path):
    from tidemark.sources import feeds

    (tmp_path / "api").mkdir()
    good = '{"sku": "A", "productName": "One", "brand": "B", "categoryPath": ["x", "Y z"], "attributes": {"Colour": "Red"}, "gtin": "1", "listPriceInPaise": 100, "sellingPriceInPaise": 90, "stock": "IN_STOCK", "fulfilledBy": {"id": "s", "name": "S", "firstParty": true}}'
    (tmp_path / "api" / "a.json").write_text(good + '\n{"sku": "B", "listPrice\n\n[]\n{"sku": "C", "productName": 7, "listPriceInPaise": "many"}\n')
    kept, out = feeds.split(feeds.parse_api(feeds.read_json_feed(spark, str(tmp_path / "api"), feeds.API_SCHEMA)))
    assert [(r.sku, r.category_slug, r.displayed_paise) for r in kept.collect()] == [("A", "y-z", 90)]
    assert {r.error for r in out.collect()} <= {"missing_id", "missing_title", "bad_amount", "bad_stock"} and out.count() >= 2
    (tmp_path / "flat").mkdir()
    names = [x.split()[0] for x in feeds.FLAT_SCHEMA.split(", ")]
    row = dict.fromkeys(names, "") | {"item_id": "F", "name": '"Ring, ""big"""', "mfr": "B", "cat": "Root>Ring", "specs": "Size=4|Colour=a=b", "mrp": "10.50", "price": "9", "stock": "y", "seller_code": "c"}
    (tmp_path / "flat" / "a.csv").write_text("\n".join([",".join(names), ",".join(row.values()), "G,only two", ",".join((row | {"item_id": "H", "mrp": "ten"}).values())]) + "\n")
    kept, out = feeds.split(feeds.parse_flat(feeds.read_flat_feed(spark, str(tmp_path / "flat"))))
    assert [(r.sku, r.title, r.mrp_paise, r.variant_key) for r in kept.collect()] == [("F", 'Ring, "big"', 1050, "color=a=b;size=4")]
    assert sorted((r.sku, r.error) for r in out.collect()) == [("G", "bad_amount"), ("H", "bad_amount")]


def test_appends_read_the_days_of_the_batch_only(spark, tmp_path):
    schema = "snapshot_id string, listing_id long, seller_id long, observed_at timestamp, created_at timestamp, displayed_paise long"
    rows = lambda *days: spark.createDataFrame([(f"s{d}", 1, None, DAY + dt.timedelta(days=d), DAY, 5) for d in days], schema)
    path = str(tmp_path / "fact")
    catalog.append_snapshots(rows(0, 1, 2, 3), path)
    fact = spark.read.parquet(path)
    plan = catalog.new_snapshots(rows(2, 9), fact)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [observed_date" in plan and "2024-01-03" in plan.replace("19725", "2024-01-03")
    assert [r.snapshot_id for r in catalog.new_snapshots(rows(2, 9), fact).collect()] == ["s9"]


def labelled(spark, n=60):
    """Examples whose target is a plain function of the current price, over n days."""
    from tidemark.operators import features

    numeric = {c: F.col("id") % 7 * 1.0 for c in features.NUMERIC} | {"current_price": 100.0 + F.col("id") % 11, "mrp": F.lit(None).cast("double")}
    rows = spark.range(n * 6).select("id", F.concat(F.lit("e"), F.col("id") % 4).alias("event_id"), F.col("id").alias("listing_id"), F.timestamp_add("DAY", (F.col("id") % n).cast("int"), F.lit(DAY)).alias("as_of"), ((100 + F.col("id") % 11) * 160).cast("long").alias("target_paise2"))
    return rows.select("*", *(v.alias(k) for k, v in numeric.items()), *(F.concat(F.lit(c), F.col("id") % 3).alias(c) for c in features.CATEGORICAL)).drop("id")


def test_trees_learn_are_repeatable_and_survive_saving(spark, tmp_path):
    from tidemark.config import ModelConfig
    from tidemark.operators import features, model

    split = features.chronological_split(labelled(spark))
    errors = {}
    for rounds in (1, 12):
        made = model.train(split, ModelConfig(rounds=rounds))
        scored = model.score(*made, split).withColumn("actual", F.col("target_paise2") / 200.0)
        errors[rounds] = {r.split: r.mae for r in model.evaluate(scored).collect()}
    assert errors[12]["test"] < errors[1]["test"] and errors[12]["test"] < 2
    again = model.score(*model.train(split, ModelConfig(rounds=12)), split)
    key = lambda df: sorted((r.listing_id, r.predicted) for r in df.collect())
    assert key(again) == key(scored) and min(p for _, p in key(again)) >= 0
    for version in ("v1", "v2"):
        model.save(*made, str(tmp_path / "models"), version, {"examples": 360})
    name, loaded, codes = model.load_latest(spark, str(tmp_path / "models"))
    assert name == "v2" and key(model.score(loaded, codes, split)) == key(scored)
    notes = spark.read.text(str(tmp_path / "models" / "v1" / "metadata")).first()[0]
    assert '"examples": 360' in notes and '"version": "v1"' in notes
    assert model.train(split.where("split <> 'test'"), ModelConfig(rounds=1)) is None
    assert model.train(split.limit(10), ModelConfig(rounds=1)) is None

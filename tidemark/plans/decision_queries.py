"""Feature, model and recommendation queries, each with its SQL where the rules allow one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import features as X
from tidemark.operators import history as H
from tidemark.operators import model as M
from tidemark.operators import recommend as R
from tidemark.operators import sales as S
from tidemark.plans.base_sql import EVENTS, SNAP, half_up, long, percent4
from tidemark.plans.history_queries import FRESH, VARIANT_HISTORY
from tidemark.sources.scratch import dealt, stored
from tidemark.sources.tables import products, sale_events, snapshots

NOW = "2001-05-01 00:00:00"
now = lambda: F.lit(NOW).cast("timestamp")


def examples(spark: SparkSession, d: str) -> DataFrame:
    """The labelled examples."""
    return X.feature_table(facts(spark, d), sale_events(spark))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The columns of snapshots that features and scores look at, stored once and dealt by product: labels, sweeps, totals and histories move no row of it."""
    return dealt(snapshots(spark, d, dealt=True).drop("delivery_paise", "platform_paise", "availability", "line_no", "suppkey"), "product_id")


def fea1_visible(spark: SparkSession, d: str) -> DataFrame:
    """Per event all rows of its scope that were observed and recorded before it began, however old; late rows are not.

    Rows are counted by scope and day of their being known, and days are summed up; an event takes the sum of the days before its own, and
    counts the rows of its own day by the exact time.
    """
    rows = H.qualifying(snapshots(spark, d)).where(F.col("observed_at").isNotNull() & F.col("created_at").isNotNull())
    keyed, sides, columns = S.scoped(rows.select("retailer_id", "brand", "category", "price", F.greatest("observed_at", "created_at").alias("known_at")), sale_events(spark))
    keyed = keyed.withColumn("day", F.to_date("known_at"))
    bound = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(c).cast("string")).alias(f"_on_{c}") for i, c in enumerate(columns)]
    scope = ["_scope", *(f"_on_{c}" for c in columns)]
    daily = keyed.select("_scope", *bound, "day", "price").groupBy(*scope, "day").agg(F.count("*").alias("n"), F.sum("price").alias("paise"))
    upto = Window.partitionBy(*scope).orderBy("day")
    summed = daily.select(*scope, F.col("day").alias("upto"), F.sum("n").over(upto).alias("n"), F.sum("paise").over(upto).alias("paise"))
    asked = sides.select("event_id", "start_at", F.to_date("start_at").alias("start_day"), "_scope", *(F.col(c).alias(f"_{c}") for c in columns))
    exact = reduce(Column.__and__, (F.col(f"_{c}").cast("string").eqNullSafe(F.col(f"_on_{c}")) for c in columns))
    before = asked.join(summed, "_scope").where((F.col("upto") < F.col("start_day")) & exact).groupBy("event_id").agg(F.max_by(F.struct("n", "paise"), "upto").alias("before")).select("event_id", "before.n", "before.paise")
    same_day = keyed.join(asked, [keyed["_scope"] == asked["_scope"], F.col("day") == F.col("start_day")]).where((F.col("known_at") < F.col("start_at")) & S.fits(columns))
    own = same_day.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("price").alias("paise"))
    return before.unionByName(own).groupBy("event_id").agg(F.sum("n").alias("known"), F.sum("paise").cast("long").alias("total"))


def fea5_features(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark, d)


def fea9_labels(spark: SparkSession, d: str) -> DataFrame:
    return X.labels(snapshots(spark, d), sale_events(spark)).select("listing_id", F.col("seller_id").cast("string").alias("seller_id"), "event_id", "as_of", "target_paise2", "target_n")


def fea10_split(spark: SparkSession, d: str) -> DataFrame:
    return X.split_summary(X.chronological_split(stored(examples(spark, d))))


def fea11_encoder(spark: SparkSession, d: str) -> DataFrame:
    return X.fit_encoder(X.chronological_split(stored(examples(spark, d))).where("split = 'train'"))


def fea12_leakage(spark: SparkSession, d: str) -> DataFrame:
    return X.leakage(examples(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return stored(M.baseline(X.chronological_split(stored(examples(spark, d)))))


def mod1_trees(spark: SparkSession, d: str) -> DataFrame:
    """Errors of boosted trees per split; trained on the first times, stopped on the middle ones."""
    split = stored(X.chronological_split(stored(examples(spark, d))))
    trained = M.train(split)
    if trained is None:
        return spark.createDataFrame([], "split string, examples long, mae double, rmse double")
    out = M.score(*trained, split).withColumn("actual", F.col("target_paise2") / 200.0)
    return M.evaluate(out)


def mod2_errors(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluate(scored(spark, d))


def mod3_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    u = M.fit_uncertainty(scored(spark, d).where("split = 'validation'"))
    return u.select(*(F.round(c, 4).alias(c) for c in u.columns))


def mod5_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return M.intervals(rows, M.fit_uncertainty(rows.where("split = 'validation'"))).where("split = 'test'").select("listing_id", "seller_id", "event_id", "predicted", "lower", "upper", "confidence")


def uncertainty(points: DataFrame) -> DataFrame:
    """The uncertainty of the rule predictor by the labelled examples: one row, stored."""
    known = stored(M.baseline(X.chronological_split(stored(X.feature_table(points, sale_events(points.sparkSession))))).where("split = 'validation'"))
    return stored(M.fit_uncertainty(known))


def mod5_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every series scored by the rule predictor, with the uncertainty of its labelled examples."""
    points = facts(spark, d)
    return M.batch_scores(points, sale_events(spark), now(), M.baseline, uncertainty(points))


def decision_inputs(spark: SparkSession, d: str, predicted: bool) -> DataFrame:
    """Histories with their events ahead and predictions. With predictions, histories and scores both come from the dealt fact and meet where they are."""
    snaps = facts(spark, d) if predicted else snapshots(spark, d)
    history = H.variant_history(snaps, now())
    history = dealt(history, "product_id") if predicted else stored(history)
    about = history.select("product_id", "retailer_id").join(products(spark, d).select("product_id", "brand", "category"), "product_id")
    ahead = R.events_ahead(about, sale_events(spark), now())
    rows = history.join(ahead, "product_id", "left")
    if not predicted:
        return rows.withColumns({"predicted_paise": F.lit(None).cast("long"), "prediction_confidence": F.lit(None).cast("double")})
    return R.with_prediction(rows, M.scores(snaps, sale_events(spark), now(), M.baseline, uncertainty(snaps)))


def rec9_decisions(spark: SparkSession, d: str) -> DataFrame:
    return R.decide(decision_inputs(spark, d, False), now())


def rec9_decisions_predicted(spark: SparkSession, d: str) -> DataFrame:
    return R.decide(decision_inputs(spark, d, True), now())


def rec7_events_ahead(spark: SparkSession, d: str) -> DataFrame:
    return R.events_ahead(H.variant_history(snapshots(spark, d), now()).select("product_id", "retailer_id").join(products(spark, d).select("product_id", "brand", "category"), "product_id"), sale_events(spark), now())


def rec12_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = rec9_decisions_predicted(spark, d).join(products(spark, d).select("product_id", "category"), "product_id")
    return rows.rollup("category", "recommendation").agg(F.count("*").alias("variants"), F.grouping_id().cast("long").alias("level"))


_APPLY = "(e.retailer_id IS NULL OR e.retailer_id = {r}) AND (e.brand IS NULL OR e.brand = {b}) AND (e.category IS NULL OR e.category = {c})"
_SERIES = "concat_ws('|', listing_id, coalesce(CAST(seller_id AS VARCHAR), 'none'))"
_IE = f"qs AS (SELECT *, {_SERIES} AS series FROM q), ie AS (SELECT e.event_id, e.start_at, e.end_at, q.* FROM qs q JOIN ev e ON q.observed_at BETWEEN e.start_at AND e.end_at AND {_APPLY.format(r='q.retailer_id', b='q.brand', c='q.category')})"
_LABELS = f"""{_IE}, kn AS (SELECT series, min(greatest(observed_at, created_at)) AS known_at FROM qs GROUP BY 1),
lab AS (SELECT * EXCLUDE (known_at) FROM (SELECT series, listing_id, CAST(seller_id AS VARCHAR) AS seller_id, event_id, CAST(2 * median(price) AS BIGINT) AS target_paise2, count(*) AS target_n, any_value(start_at) AS as_of FROM ie GROUP BY ALL) JOIN kn USING (series) WHERE known_at < as_of)"""
_KNOWN = "observed_at < as_of AND created_at < as_of"
_AVG = lambda n: long(half_up(f"sum(price) FILTER (observed_at >= as_of - INTERVAL {n} DAY)", f"count(*) FILTER (observed_at >= as_of - INTERVAL {n} DAY)"))


def _features(lab: str, x: str = "") -> str:
    """Features of the examples in `lab` as the table ft; x tells the tables of two uses apart."""
    return f"""
sn{x} AS (SELECT l.series, l.event_id, as_of, target_paise2, target_n, q.* EXCLUDE (series) FROM {lab} l JOIN qs q USING (series) WHERE {_KNOWN}),
fb{x} AS (SELECT series, event_id, as_of, target_paise2, target_n, arg_max({{'p': price, 'm': mrp_paise, 'r': retailer_id, 's': seller_id, 'b': brand, 'c': category, 'l': listing_id, 'v': product_id}}, ROW(observed_at, created_at, snapshot_id)) AS now, {_AVG(7)} AS a7, {_AVG(30)} AS a30, {_AVG(90)} AS a90, min(price) AS low, max(price) AS high,
  CASE WHEN count(*) > 1 THEN round(sqrt((count(*) * sum(price * price) - sum(price) * sum(price))::DOUBLE / (count(*) * (count(*) - 1))::DOUBLE) / 100, 2) END AS volatility FROM sn{x} GROUP BY ALL),
pw{x} AS (SELECT l.series, l.event_id, ie.event_id AS past_id, ie.start_at AS past_start, {long(half_up('sum(price)', 'count(*)'))} AS average, min(price) AS lowest FROM {lab} l JOIN ie ON l.series = ie.series WHERE ie.end_at < as_of AND {_KNOWN} GROUP BY ALL),
lp{x} AS (SELECT series, event_id, arg_max({{'a': average, 'l': lowest}}, ROW(past_start, past_id)) AS last, count(*) AS sales FROM pw{x} GROUP BY 1, 2),
j{x} AS (SELECT fb.*, last, sales, event_type, source, start_at, coalesce(CASE WHEN source = 'observed_price_inference' THEN end_at < as_of ELSE source IS NOT NULL END, false) AS tk FROM fb{x} fb LEFT JOIN lp{x} lp ON fb.series = lp.series AND fb.event_id IS NOT DISTINCT FROM lp.event_id LEFT JOIN ev ON fb.event_id = ev.event_id),
nr{x} AS (SELECT j.series, j.event_id, arg_min({{'i': e.event_id, 't': e.event_type, 's': e.start_at}}, ROW(e.start_at, e.event_id)) AS near FROM j{x} j JOIN ev e ON e.source <> 'observed_price_inference' AND e.end_at >= as_of AND {_APPLY.format(r='now.r', b='now.b', c='now.c')} WHERE NOT tk GROUP BY 1, 2),
f0{x} AS (SELECT now.v AS product_id, now.l AS listing_id, j.event_id, as_of, target_paise2, target_n, now.p / 100.0::DOUBLE AS current_price, a7 / 100.0::DOUBLE AS avg_7d, a30 / 100.0::DOUBLE AS avg_30d, a90 / 100.0::DOUBLE AS avg_90d, low / 100.0::DOUBLE AS historical_low, high / 100.0::DOUBLE AS historical_high, volatility AS price_volatility,
  last.a / 100.0::DOUBLE AS previous_sale_price, last.l / 100.0::DOUBLE AS previous_sale_low, coalesce(sales, 0)::DOUBLE AS previous_sale_count, now.m / 100.0::DOUBLE AS mrp,
  CASE WHEN CASE WHEN tk THEN start_at ELSE near.s END IS NULL THEN 0.0 ELSE greatest(0.0, (epoch_us(CASE WHEN tk THEN start_at ELSE near.s END) - epoch_us(as_of)) / 86400000000.0::DOUBLE) END AS days_until_sale,
  month(as_of)::DOUBLE AS month, (isodow(as_of) - 1)::DOUBLE AS day_of_week, dayofyear(as_of)::DOUBLE AS day_of_year, CASE WHEN isodow(as_of) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend,
  CAST(now.r AS VARCHAR) AS retailer_id, CAST(now.s AS VARCHAR) AS seller_id, now.b AS brand_id, now.c AS category_id, CASE WHEN tk THEN j.event_id ELSE near.i END AS sale_event_id, CASE WHEN tk THEN event_type ELSE near.t END AS sale_event_type FROM j{x} j LEFT JOIN nr{x} nr ON j.series = nr.series AND j.event_id IS NOT DISTINCT FROM nr.event_id),
ft{x} AS (SELECT *, round((22 - {' - '.join(f'({c} IS NULL)::INT' for c in X.NUMERIC + X.CATEGORICAL)}) / 22.0::DOUBLE, 6) AS completeness FROM f0{x})"""


FEATURES = f"""{_LABELS}, {_features('lab')},
tm AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT as_of FROM ft)),
t1 AS (SELECT *, greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS tr FROM tm), t2 AS (SELECT *, greatest(tr + 1, CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT)) AS u0 FROM t1), t3 AS (SELECT *, CASE WHEN u0 >= n THEN n - 1 ELSE u0 END AS u FROM t2),
t4 AS (SELECT *, CASE WHEN tr >= u THEN greatest(1, u - 1) ELSE tr END AS t FROM t3),
sp AS (SELECT ft.*, CASE WHEN i <= t THEN 'train' WHEN i <= u THEN 'validation' ELSE 'test' END AS split, coalesce(previous_sale_price, avg_30d, current_price) AS predicted, target_paise2 / 200.0::DOUBLE AS actual FROM ft JOIN t4 USING (as_of)),
un AS (SELECT quantile_cont(actual - predicted, 0.1) AS p_low, quantile_cont(actual - predicted, 0.9) AS p_high, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted)) AS mae, avg(actual) AS mean_target FROM sp WHERE split = 'validation'),
uc AS (SELECT un.*, (SELECT avg((actual - predicted >= p_low - 1e-9 AND actual - predicted <= p_high + 1e-9)::INT) FROM sp, un WHERE split = 'validation') AS coverage FROM un)"""
_UNIT = lambda c: f"least(1.0, greatest(0.0, {c}))"
SCORES = f"""{FEATURES}, ask AS (SELECT DISTINCT series, CAST(NULL AS VARCHAR) AS event_id, TIMESTAMP '{NOW}' AS as_of, CAST(NULL AS BIGINT) AS target_paise2, CAST(NULL AS BIGINT) AS target_n FROM qs), {_features('ask', '2')},
pr AS (SELECT listing_id, seller_id, greatest(0.0, coalesce(previous_sale_price, avg_30d, current_price)) AS predicted, completeness FROM ft2),
ps AS (SELECT pr.*, round(greatest(0.0, predicted + p_low), 4) AS lower, round(greatest(greatest(0.0, predicted + p_low), predicted + p_high), 4) AS upper, round({_UNIT(f"{_UNIT('coverage')} * {_UNIT('completeness')} / (1.0 + CASE WHEN mean_target > 0 THEN rmse / mean_target ELSE 0 END)")}, 6) AS confidence FROM pr, uc),
al AS (SELECT listing_id, seller_id, min(product_id) AS product_id, min(retailer_id) AS retailer_id FROM snap GROUP BY 1, 2),
sc AS (SELECT al.*, p_low IS NOT NULL AS trained, predicted IS NOT NULL AND p_low IS NOT NULL AS known, predicted, lower, upper, confidence FROM al LEFT JOIN ps ON al.listing_id = ps.listing_id AND CAST(al.seller_id AS VARCHAR) IS NOT DISTINCT FROM ps.seller_id, uc),
scores AS (SELECT product_id, retailer_id, seller_id, listing_id, CASE WHEN known THEN 'PREDICTED' ELSE 'INSUFFICIENT_DATA' END AS status, CASE WHEN NOT trained THEN 'no_trained_model' WHEN predicted IS NULL THEN 'no_current_price' END AS reason,
  CASE WHEN known THEN CAST(round(predicted * 100) AS BIGINT) END AS predicted_paise, CASE WHEN known THEN CAST(round(lower * 100) AS BIGINT) END AS lower_paise, CASE WHEN known THEN CAST(round(upper * 100) AS BIGINT) END AS upper_paise, CASE WHEN known THEN confidence END AS confidence FROM sc)"""
_CODES = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, min(ROW(as_of, event_id, listing_id, coalesce(seller_id, 'none'))) AS r FROM sp WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 2" for c in X.CATEGORICAL)
_LEAK = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS compared, coalesce(bool_and(abs({c} - target_paise2 / 200.0::DOUBLE) <= 1e-9), false) AS leaks FROM ft" for c in X.NUMERIC)

_NOW = f"TIMESTAMP '{NOW}'"
_AHEAD = f"""ah AS (SELECT v.product_id, arg_min({{'i': e.event_id, 'd': days}}, ROW(days, start_at, e.event_id)) FILTER (good) AS nxt, coalesce(bool_or(NOT good), false) AS weak_ahead
  FROM (SELECT vh.product_id, vh.retailer_id, brand, category FROM vh JOIN prod USING (product_id)) v JOIN (SELECT *, CAST(floor((epoch_us(start_at) - epoch_us({_NOW})) / 86400000000) AS BIGINT) AS days, source <> 'observed_price_inference' AND confidence IN ('high', 'medium') AND floor((epoch_us(start_at) - epoch_us({_NOW})) / 86400000000) <= 30 AS good FROM ev WHERE start_at > {_NOW}) e
  ON {_APPLY.format(r='v.retailer_id', b='v.brand', c='v.category')} GROUP BY 1)"""


def _rec(prediction: str) -> str:
    near = lambda p: f"coalesce(current_paise <= {half_up(f'low_paise * {100 + p}', '100')}, false)"
    above = lambda a: f"coalesce({a} > 0 AND {percent4(f'current_paise - {a}', a)} >= 5, false)"
    named = lambda pairs: "[x for x in [" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in pairs) + "] if x IS NOT NULL]"
    return f"""{_AHEAD}, pd AS ({prediction}),
i0 AS (SELECT vh.*, nxt.i AS event_id, nxt.d AS event_days, weak_ahead, predicted_paise, prediction_confidence, {FRESH('current_at', _NOW)} AS status FROM vh LEFT JOIN ah USING (product_id) LEFT JOIN pd ON vh.product_id = pd.product_id AND vh.retailer_id = pd.retailer_id AND vh.seller_id IS NOT DISTINCT FROM pd.seller_id),
i1 AS (SELECT *, predicted_paise IS NOT NULL AND coalesce(prediction_confidence >= 0.5, false) AS prediction_used FROM i0),
i2 AS (SELECT *, CASE WHEN prediction_used AND predicted_paise < current_paise AND current_paise > 0 THEN current_paise - predicted_paise END AS saving_paise FROM i1),
i3 AS (SELECT *, {percent4('saving_paise', 'current_paise')} AS saving, coalesce(percentile <= 25, false) AS b_pct, coalesce(percentile <= 15, false) AS b_strong, {near(5)} AS b_near, {near(2)} AS b_near2, coalesce(current_paise <= avg_30d, false) AND coalesce(current_paise <= avg_90d, false) AS b_below,
  {above('avg_30d')} AND ({above('avg_90d')} OR avg_90d IS NULL) AS w_above FROM i2),
i4 AS (SELECT *, prediction_used AND (saving IS NULL OR saving < 5) AS b_nosave, coalesce(saving >= 5, false) AS w_saving, b_strong OR b_near2 OR (b_pct AND b_near) OR (b_pct AND b_below) AS strong, coalesce(percentile >= 70, false) AND NOT b_near AS w_pct, trend = 'falling' AND (b_pct OR b_near OR b_below) AS b_fall FROM i3),
i5 AS (SELECT *, NOT strong AND (b_pct OR b_near OR b_below) AS weak, event_id IS NOT NULL AND NOT strong AS w_event FROM i4),
i6 AS (SELECT *, w_pct OR w_above OR w_saving OR w_event AS wait, trend = 'rising' AND (w_pct OR w_above OR w_event) AS w_rise FROM i5),
i7 AS (SELECT *, strong AND wait AS conflict, {named([('gate_no_current_price', 'current_paise IS NULL'), ('gate_stale_data', "status = 'stale'"), ('gate_missing_data', "status = 'missing'"), ('gate_insufficient_history', 'qualifying < 3')])} AS gate,
  {named([('buy_favorable_percentile', 'b_pct'), ('buy_strong_percentile', 'b_strong'), ('buy_near_historical_low', 'b_near'), ('buy_strong_near_historical_low', 'b_near2'), ('buy_below_averages', 'b_below'), ('buy_prediction_no_material_savings', 'b_nosave'), ('buy_falling_trend', 'b_fall')])} AS buys,
  {named([('wait_unfavorable_percentile', 'w_pct'), ('wait_above_averages', 'w_above'), ('wait_predicted_savings', 'w_saving'), ('wait_upcoming_sale', 'w_event'), ('wait_rising_trend', 'w_rise')])} AS waits,
  {named([('watch_conflicting_signals', 'strong AND wait'), ('watch_neutral_history', 'coalesce(percentile > 25 AND percentile < 70, false) AND NOT strong AND NOT wait'), ('watch_weak_favorable', 'weak AND NOT wait'), ('watch_event_not_credible', 'coalesce(weak_ahead, false) AND event_id IS NULL AND NOT wait'), ('watch_neutral_trend', "trend = 'stable' AND NOT strong AND NOT wait")])} AS watches,
  {named([('pred_unused_missing', 'predicted_paise IS NULL'), ('watch_prediction_missing', 'predicted_paise IS NULL'), ('pred_unused_low_confidence', 'predicted_paise IS NOT NULL AND NOT prediction_used'), ('watch_prediction_low_confidence', 'predicted_paise IS NOT NULL AND NOT prediction_used')])} AS unused,
  CAST((current_paise IS NOT NULL)::INT * 200000 + (percentile IS NOT NULL)::INT * 150000 + (low_paise IS NOT NULL)::INT * 100000 + (avg_30d IS NOT NULL)::INT * 100000 + (avg_90d IS NOT NULL)::INT * 100000 + (trend <> 'insufficient_history')::INT * 50000 + CASE status WHEN 'fresh' THEN 150000 WHEN 'aging' THEN 70000 ELSE 0 END
    + CASE WHEN prediction_used THEN CAST(round(prediction_confidence * 10000) AS BIGINT) * 10 ELSE 0 END + (event_id IS NOT NULL)::INT * 50000 AS BIGINT) AS points FROM i6),
rec AS (SELECT product_id, CASE WHEN len(gate) > 0 THEN 'INSUFFICIENT_DATA' WHEN conflict THEN 'WATCH' WHEN wait THEN 'WAIT' WHEN strong THEN 'BUY_NOW' ELSE 'WATCH' END AS recommendation, gate[1] AS insufficient,
  coalesce(array_to_string(CASE WHEN len(gate) > 0 THEN gate WHEN conflict THEN watches WHEN wait THEN waits WHEN strong THEN buys WHEN len(watches) > 0 THEN watches ELSE unused END, ','), '') AS rules, prediction_used, saving_paise,
  least(1.0, {half_up('points * (CASE WHEN conflict THEN 3 ELSE 4 END) * (CASE WHEN len(gate) > 0 THEN 1 ELSE 2 END)', '800')} / 10000.0::DOUBLE) AS confidence, status FROM i7)"""


_NONE = "SELECT CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS INTEGER) AS retailer_id, CAST(NULL AS BIGINT) AS seller_id, CAST(NULL AS BIGINT) AS predicted_paise, CAST(NULL AS DOUBLE) AS prediction_confidence"
_SALE = "SELECT product_id, retailer_id, seller_id, arg_min(predicted_paise, listing_id) AS predicted_paise, arg_min(confidence, listing_id) AS prediction_confidence FROM scores WHERE status = 'PREDICTED' GROUP BY 1, 2, 3"
_PRED = f"WITH {SNAP}, {EVENTS}, {SCORES}, {VARIANT_HISTORY}, {_rec(_SALE)}"

QUERIES = {
    "fea1_visible": (fea1_visible, f"WITH {SNAP}, {EVENTS} SELECT event_id, count(*) AS known, CAST(sum(price) AS BIGINT) AS total FROM q JOIN ev e ON q.observed_at < e.start_at AND {_APPLY.format(r='q.retailer_id', b='q.brand', c='q.category')} WHERE observed_at < start_at AND created_at < start_at GROUP BY 1"),
    "fea5_features": (fea5_features, f"WITH {SNAP}, {EVENTS}, {FEATURES} SELECT * FROM ft"),
    "fea9_labels": (fea9_labels, f"WITH {SNAP}, {EVENTS}, {_LABELS} SELECT * EXCLUDE (series) FROM lab"),
    "fea10_split": (fea10_split, f"WITH {SNAP}, {EVENTS}, {FEATURES} SELECT split, count(*) AS examples, min(as_of) AS first_as_of, max(as_of) AS last_as_of, CASE WHEN count(*) < CASE split WHEN 'train' THEN 20 ELSE 6 END THEN 'insufficient_data' ELSE 'ok' END AS status FROM sp GROUP BY 1"),
    "fea11_encoder": (fea11_encoder, f"WITH {SNAP}, {EVENTS}, {FEATURES} SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY r, value) - 1 AS INTEGER) AS code FROM ({_CODES})"),
    "fea12_leakage": (fea12_leakage, f"WITH {SNAP}, {EVENTS}, {FEATURES} {_LEAK}"),
    "mod1_trees": (mod1_trees, None),
    "mod2_errors": (mod2_errors, f"WITH {SNAP}, {EVENTS}, {FEATURES} SELECT split, count(*) AS examples, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse FROM sp GROUP BY 1"),
    "mod3_uncertainty": (mod3_uncertainty, f"WITH {SNAP}, {EVENTS}, {FEATURES} SELECT {', '.join(f'round({c}, 4) AS {c}' for c in ('p_low', 'p_high', 'coverage', 'rmse', 'mae', 'mean_target'))} FROM uc"),
    "mod5_intervals": (mod5_intervals, f"WITH {SNAP}, {EVENTS}, {FEATURES} SELECT listing_id, seller_id, event_id, predicted, round(greatest(0.0, predicted + p_low), 4) AS lower, round(greatest(greatest(0.0, predicted + p_low), predicted + p_high), 4) AS upper, round(least(1.0, greatest(0.0, coverage * completeness / (1.0 + CASE WHEN mean_target > 0 THEN rmse / mean_target ELSE 0 END))), 6) AS confidence FROM sp, uc WHERE split = 'test'"),
    "mod5_predictions": (mod5_predictions, f"WITH {SNAP}, {EVENTS}, {SCORES} SELECT * FROM scores"),
    "rec7_events_ahead": (rec7_events_ahead, f"WITH {SNAP}, {EVENTS}, {VARIANT_HISTORY}, {_AHEAD} SELECT product_id, nxt.i AS event_id, nxt.d AS event_days, weak_ahead FROM ah"),
    "rec9_decisions": (rec9_decisions, f"WITH {SNAP}, {EVENTS}, {VARIANT_HISTORY}, {_rec(_NONE)} SELECT * FROM rec"),
    "rec9_decisions_predicted": (rec9_decisions_predicted, f"{_PRED} SELECT * FROM rec"),
    "rec12_counts": (rec12_counts, f"{_PRED} SELECT category, recommendation, count(*) AS variants, CAST(grouping(category, recommendation) AS BIGINT) AS level FROM rec JOIN prod USING (product_id) GROUP BY ROLLUP (category, recommendation)"),
}

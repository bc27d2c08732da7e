"""Buy, wait or watch: rules as boolean columns, one decision per variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import RecommendConfig
from tidemark.functions.money import half_up, percent4
from tidemark.operators.history import freshness
from tidemark.operators.sales import event_products

#: Evidence in millionths.
EVIDENCE = {"current": 200_000, "percentile": 150_000, "low": 100_000, "average": 100_000, "trend": 50_000, "fresh": 150_000, "aging": 70_000, "event": 50_000}


def events_ahead(products: DataFrame, events: DataFrame, as_of: Column, c: RecommendConfig = RecommendConfig()) -> DataFrame:
    """Per variant and retailer-scope the nearest credible upcoming event, and whether any non-credible one is ahead.

    Inferred windows and low confidence are never credible; days are whole days, rounded down.
    """
    ahead = events.where(F.col("start_at") > as_of).withColumn("days", F.floor((F.unix_micros("start_at") - F.unix_micros(as_of)) / 86_400_000_000))
    about = ahead.select("event_id", "start_at", "days", "confidence", "source")
    rows = event_products(products, ahead).join(about, "event_id")
    good = (F.col("source") != "observed_price_inference") & F.col("confidence").isin("high", "medium") & (F.col("days") <= c.horizon_days)
    first = F.min_by(F.when(good, F.struct("event_id", "days")), F.when(good, F.struct("days", "start_at", "event_id")))
    return rows.groupBy("product_id").agg(first.alias("next"), F.coalesce(F.bool_or(~good), F.lit(False)).alias("weak_ahead")).select("product_id", F.col("next.event_id").alias("event_id"), F.col("next.days").alias("event_days"), "weak_ahead")


def with_prediction(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Variant histories with the prediction of the same variant, retailer and seller as their current row; another listing's is never taken.

    Of several listings of one seller the one with the smallest id counts. A product has one history, so the product alone is the key: rows that
    lie dealt by it are not moved, and the others of its sellers are passed over.
    """
    made = predictions.where("status = 'PREDICTED'").groupBy("product_id", "retailer_id", "seller_id").agg(F.min_by(F.struct("predicted_paise", "confidence"), "listing_id").alias("p"))
    side = made.select(F.col("product_id").alias("_product"), F.col("retailer_id").alias("_retailer"), F.col("seller_id").alias("_seller"), "p.predicted_paise", F.col("p.confidence").alias("prediction_confidence"))
    seller = (F.col("retailer_id") == F.col("_retailer")) & F.col("seller_id").eqNullSafe(F.col("_seller"))
    same = (F.col("product_id") == F.col("_product")) & F.coalesce(seller, F.lit(False))
    return rows.join(side, same, "left").drop("_product", "_retailer", "_seller")


def decide(inputs: DataFrame, as_of: Column, c: RecommendConfig = RecommendConfig()) -> DataFrame:
    """The decision of every row of a variant history joined with event_id, event_days, weak_ahead, predicted_paise and prediction_confidence."""
    now, low, a30, a90 = (F.col(x) for x in ("current_paise", "low_paise", "avg_30d", "avg_90d"))
    pct, predicted, sure = F.col("percentile"), F.col("predicted_paise"), F.col("prediction_confidence")
    yes = lambda x: F.coalesce(x, F.lit(False))
    status = freshness(F.col("current_at"), as_of)
    used = predicted.isNotNull() & yes(sure >= c.min_prediction_confidence)
    near = lambda p: yes(now <= half_up(low * (100 + p), F.lit(100).cast("long")))
    amount = F.when(used & (predicted < now) & (now > 0), now - predicted)
    saving = percent4(amount, now)
    above = lambda a: yes((a > 0) & (percent4(now - a, a) >= c.min_above_percent))
    rows = inputs.select(
        "*", status.alias("status"), used.alias("prediction_used"), amount.alias("saving_paise"),
        yes(pct <= c.buy_percentile).alias("b_pct"), yes(pct <= c.buy_strong_percentile).alias("b_strong"), near(c.near_low_percent).alias("b_near"), near(c.near_low_strong_percent).alias("b_near_strong"),
        (yes(now <= a30) & yes(now <= a90)).alias("b_below"), (used & (saving.isNull() | (saving < c.min_saving_percent))).alias("b_no_saving"),
        yes(saving >= c.min_saving_percent).alias("w_saving"), (above(a30) & (above(a90) | a90.isNull())).alias("w_above"),
    )
    col = F.col
    rows = rows.select(
        "*", (col("b_strong") | col("b_near_strong") | (col("b_pct") & col("b_near")) | (col("b_pct") & col("b_below"))).alias("strong"),
        (yes(pct >= c.wait_percentile) & ~col("b_near")).alias("w_pct"), ((col("trend") == "falling") & (col("b_pct") | col("b_near") | col("b_below"))).alias("b_falling"),
    )
    rows = rows.select("*", (~col("strong") & (col("b_pct") | col("b_near") | col("b_below"))).alias("weak"), (col("event_id").isNotNull() & ~col("strong")).alias("w_event"))
    rows = rows.select("*", (col("w_pct") | col("w_above") | col("w_saving") | col("w_event")).alias("wait"), ((col("trend") == "rising") & (col("w_pct") | col("w_above") | col("w_event"))).alias("w_rising"))
    calm = ~col("wait")
    rows = rows.select(
        "*", (col("strong") & col("wait")).alias("conflict"),
        (yes((pct > c.buy_percentile) & (pct < c.wait_percentile)) & ~col("strong") & calm).alias("n_neutral"), (col("weak") & calm).alias("n_weak"),
        (yes(col("weak_ahead")) & col("event_id").isNull() & calm).alias("n_event"), ((col("trend") == "stable") & ~col("strong") & calm).alias("n_trend"),
    )
    gates = {"gate_no_current_price": now.isNull(), "gate_stale_data": col("status") == "stale", "gate_missing_data": col("status") == "missing", "gate_insufficient_history": col("qualifying") < c.min_observations}
    ids = lambda named: F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in named.items())))
    gate = ids(gates)
    buy = ids({"buy_favorable_percentile": col("b_pct"), "buy_strong_percentile": col("b_strong"), "buy_near_historical_low": col("b_near"), "buy_strong_near_historical_low": col("b_near_strong"), "buy_below_averages": col("b_below"), "buy_prediction_no_material_savings": col("b_no_saving"), "buy_falling_trend": col("b_falling")})
    wait = ids({"wait_unfavorable_percentile": col("w_pct"), "wait_above_averages": col("w_above"), "wait_predicted_savings": col("w_saving"), "wait_upcoming_sale": col("w_event"), "wait_rising_trend": col("w_rising")})
    watch = ids({"watch_conflicting_signals": col("conflict"), "watch_neutral_history": col("n_neutral"), "watch_weak_favorable": col("n_weak"), "watch_event_not_credible": col("n_event"), "watch_neutral_trend": col("n_trend")})
    unused = ids({"pred_unused_missing": predicted.isNull(), "watch_prediction_missing": predicted.isNull(), "pred_unused_low_confidence": predicted.isNotNull() & ~used, "watch_prediction_low_confidence": predicted.isNotNull() & ~used})
    decision = F.when(F.size(gate) > 0, "INSUFFICIENT_DATA").when(col("conflict"), "WATCH").when(col("wait"), "WAIT").when(col("strong"), "BUY_NOW").otherwise("WATCH")
    fired = F.when(F.size(gate) > 0, gate).when(col("conflict"), watch).when(col("wait"), wait).when(col("strong"), buy).when(F.size(watch) > 0, watch).otherwise(unused)
    e = EVIDENCE
    points = (
        sum((F.when(x.isNotNull(), e[k]).otherwise(0) for k, x in (("current", now), ("percentile", pct), ("low", low), ("average", a30), ("average", a90))), F.lit(0))
        + F.when(col("trend") != "insufficient_history", e["trend"]).otherwise(0) + F.when(col("status") == "fresh", e["fresh"]).when(col("status") == "aging", e["aging"]).otherwise(0)
        + F.when(col("prediction_used"), F.round(sure * 10_000).cast("long") * 10).otherwise(0) + F.when(col("event_id").isNotNull(), e["event"]).otherwise(0)
    ).cast("long")
    scaled = points * F.when(col("conflict"), 3).otherwise(4) * F.when(F.size(gate) > 0, 1).otherwise(2)
    confidence = F.least(F.lit(1.0), half_up(scaled, F.lit(800).cast("long")) / F.lit(10_000.0))
    return rows.select("product_id", decision.alias("recommendation"), F.get(gate, 0).alias("insufficient"), F.array_join(fired, ",").alias("rules"), "prediction_used", "saving_paise", confidence.alias("confidence"), "status")

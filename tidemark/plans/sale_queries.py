"""Sale queries over the projected tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SalesConfig
from tidemark.operators import sales as S
from tidemark.operators.history import qualifying
from tidemark.plans.base_sql import EVENTS, SNAP, half_up, long, percent4
from tidemark.sources.scratch import stored
from tidemark.sources.tables import products, sale_events, snapshots

at = lambda s: F.lit(s).cast("timestamp")
STRONG = SalesConfig(drop_percent=25)


def sal1_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of every brand event at the time of every product's newest observation."""
    days = snapshots(spark, d).groupBy("product_id", "brand").agg(F.max("observed_at").alias("at_day"))
    branded = sale_events(spark).where("brand is not null").select("event_id", F.col("brand").alias("_brand"), "start_at", "end_at")
    return days.join(branded, F.col("brand") == F.col("_brand")).select("product_id", "event_id", S.event_status(F.col("at_day")).alias("status"))


def sal2_listed(spark: SparkSession, d: str) -> DataFrame:
    newest = snapshots(spark, d).agg(F.date_sub(F.max("observed_at"), 700).cast("timestamp").alias("at_day"))
    return S.listed(sale_events(spark).join(newest), F.col("at_day"), ["manual_curation", "product_feed", "official_api"], "after_event", 5, 20).select("event_id", "start_at", "status", "total")


def sal3_upcoming(spark: SparkSession, d: str) -> DataFrame:
    oldest = snapshots(spark, d).agg(F.date_add(F.min("observed_at"), 1500).cast("timestamp").alias("at_day"))
    return S.upcoming(sale_events(spark).join(oldest), F.col("at_day")).select("event_id", "start_at", "event_type")


def sal4_applicable(spark: SparkSession, d: str) -> DataFrame:
    return S.event_products(products(spark, d).select("product_id", "brand", "category"), sale_events(spark)).select("event_id", "product_id")


def sal5_in_events(spark: SparkSession, d: str) -> DataFrame:
    return S.in_events(snapshots(spark, d), sale_events(spark)).select("event_id", "snapshot_id", "observed_at")


def sal6_event_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.event_stats(stored(qualifying(snapshots(spark, d)).select("product_id", "brand", "category", "retailer_id", *S.ROW)), sale_events(spark))


def sal8_overall(spark: SparkSession, d: str) -> DataFrame:
    return S.overall_stats(stored(qualifying(snapshots(spark, d)).select("product_id", "brand", "category", "retailer_id", *S.ROW)), sale_events(spark))


def sal10_discounted(spark: SparkSession, d: str) -> DataFrame:
    return S.discounted(snapshots(spark, d).select("listing_id", "seller_id", *S.ROW), ["listing_id", "seller_id"]).select("snapshot_id", "listing_id", "seller_id", "price", "prior2", "drop_percent")


def sal10_discounted_long(spark: SparkSession, d: str) -> DataFrame:
    """The same over the longer series of whole products."""
    return S.discounted(snapshots(spark, d).select("product_id", *S.ROW), ["product_id"]).select("snapshot_id", "product_id", "price", "prior2", "drop_percent")


def sal13_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.detect_windows(snapshots(spark, d), STRONG)


def sal13_windows_per_retailer(spark: SparkSession, d: str) -> DataFrame:
    return S.detect_windows(snapshots(spark, d), SalesConfig(), per_retailer=True)


def snk2_new_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that detection finds at 10 percent but not at 25 percent, by the identity an insert would check."""
    known = S.windows_as_events(S.detect_windows(snapshots(spark, d), STRONG))
    return S.new_windows(S.windows_as_events(S.detect_windows(snapshots(spark, d), SalesConfig())), known).select("event_id", "start_at", "end_at", "event_type", "confidence")


_APPLIES = "(e.retailer_id IS NULL OR e.retailer_id = q.retailer_id) AND (e.brand IS NULL OR e.brand = q.brand) AND (e.category IS NULL OR e.category = q.category)"
_IN = f"ie AS (SELECT e.event_id, e.start_at, e.end_at, q.* FROM q JOIN ev e ON q.observed_at BETWEEN e.start_at AND e.end_at AND {_APPLIES})"
STATS = f"""{_IN}, g AS (SELECT product_id, event_id, count(*) AS n, sum(price) AS total, arg_min({{'p': price, 's': snapshot_id}}, ROW(price, observed_at, snapshot_id)) AS low, arg_max({{'p': price, 's': snapshot_id}}, ROW(price, observed_at, snapshot_id)) AS high FROM ie GROUP BY 1, 2),
t AS (SELECT product_id, count(*) AS all_n, sum(price) AS all_total FROM q GROUP BY 1),
b AS (SELECT g.*, all_n - n AS baseline_n, {long(half_up('total', 'n'))} AS average_paise, {long(half_up('all_total - total', 'all_n - n'))} AS baseline_paise FROM g JOIN t USING (product_id)),
es AS (SELECT product_id, event_id, n, average_paise, low.p AS low_paise, low.s AS low_snapshot_id, high.p AS high_paise, high.s AS high_snapshot_id, baseline_n, baseline_paise, {percent4('baseline_paise - average_paise', 'baseline_paise')} AS below_percent,
  CASE WHEN baseline_n = 0 THEN 'no_qualifying_observations' WHEN baseline_paise = 0 THEN 'zero_baseline_price' END AS below_reason FROM b)"""


_SERIES = "listing_id, seller_id"


def _drops(key: str, percent: int) -> str:
    return f"""d0 AS (SELECT *, CAST(2 * median(price) OVER (PARTITION BY {key} ORDER BY observed_at, created_at, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS prior2 FROM q),
dr AS (SELECT *, {percent4('prior2 - 2 * price', 'prior2')} AS drop_percent FROM d0 WHERE prior2 > 0 AND 100 * (prior2 - 2 * price) >= {percent} * prior2)"""


def sessions_sql(percent: int, part: str = "''") -> str:
    """Discounted rows by scope, with the number of their island."""
    return f"""{_drops(_SERIES, percent)},
sc AS (SELECT {part} AS part, 'retailer' AS scope, CAST(retailer_id AS VARCHAR) AS scope_id, observed_at, concat_ws('|', listing_id, coalesce(CAST(seller_id AS VARCHAR), 'none')) AS series, drop_percent FROM dr UNION ALL SELECT {part}, 'category', category, observed_at, concat_ws('|', listing_id, coalesce(CAST(seller_id AS VARCHAR), 'none')) AS series, drop_percent FROM dr UNION ALL SELECT {part}, 'brand', brand, observed_at, concat_ws('|', listing_id, coalesce(CAST(seller_id AS VARCHAR), 'none')) AS series, drop_percent FROM dr),
gp AS (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY part, scope, scope_id ORDER BY observed_at) > INTERVAL 2 DAY THEN 1 ELSE 0 END AS nw FROM sc),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY part, scope, scope_id ORDER BY observed_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM gp)"""


def _windows(percent: int, part: str = "''", out: str = "win") -> str:
    return f"""{sessions_sql(percent, part)},
{out} AS (SELECT scope, scope_id, CASE WHEN scope = 'retailer' THEN 'retailer_specific' ELSE scope END AS event_type, min(observed_at) AS start_at, max(observed_at) AS end_at, count(DISTINCT series) AS listings, count(*) AS observations, {half_up('CAST(2 * median(CAST(round(drop_percent * 10000) AS BIGINT)) AS BIGINT)', '2')} / 10000.0::DOUBLE AS median_drop_percent,
  CASE WHEN count(DISTINCT series) >= 5 THEN 'high' WHEN count(DISTINCT series) >= 2 THEN 'medium' ELSE 'low' END AS confidence, 'Detected ' || scope || ' sale ' || strftime(min(observed_at), '%Y-%m-%d') AS name, part FROM isl GROUP BY part, scope, scope_id, island HAVING count(DISTINCT series) >= 2)"""


_STATUS = "CASE WHEN {a} < start_at THEN 'before_event' WHEN {a} > end_at THEN 'after_event' ELSE 'during_event' END"
QUERIES = {
    "sal1_status": (sal1_status, f"WITH {SNAP}, {EVENTS}, n AS (SELECT product_id, brand, max(observed_at) AS a FROM snap GROUP BY ALL) SELECT product_id, event_id, {_STATUS.format(a='a')} AS status FROM n JOIN ev USING (brand)"),
    "sal2_listed": (sal2_listed, f"WITH {SNAP}, {EVENTS}, n AS (SELECT max(observed_at) - INTERVAL 700 DAY AS a FROM snap), r AS (SELECT event_id, start_at, {_STATUS.format(a='a')} AS status FROM ev, n WHERE source IN ('manual_curation', 'product_feed', 'official_api')) SELECT event_id, start_at, status, count(*) OVER () AS total FROM r WHERE status = 'after_event' ORDER BY start_at, event_id LIMIT 20 OFFSET 5"),
    "sal3_upcoming": (sal3_upcoming, f"WITH {SNAP}, {EVENTS}, n AS (SELECT min(observed_at) + INTERVAL 1500 DAY AS a FROM snap) SELECT event_id, start_at, event_type FROM ev, n WHERE start_at > a ORDER BY start_at, event_id"),
    "sal4_applicable": (sal4_applicable, f"WITH {SNAP}, {EVENTS} SELECT event_id, product_id FROM prod p JOIN ev e ON (e.brand IS NULL OR e.brand = p.brand) AND (e.category IS NULL OR e.category = p.category)"),
    "sal5_in_events": (sal5_in_events, f"WITH {SNAP}, {EVENTS} SELECT e.event_id, q.snapshot_id, q.observed_at FROM snap q JOIN ev e ON q.observed_at BETWEEN e.start_at AND e.end_at AND {_APPLIES}"),
    "sal6_event_stats": (sal6_event_stats, f"WITH {SNAP}, {EVENTS}, {STATS} SELECT * FROM es"),
    "sal8_overall": (sal8_overall, f"""WITH {SNAP}, {EVENTS}, {_IN}, f AS (SELECT q.*, snapshot_id IN (SELECT snapshot_id FROM ie) AS s FROM q)
SELECT product_id, count(*) FILTER (s) AS sale_n, {long(half_up('sum(price) FILTER (s)', 'count(*) FILTER (s)'))} AS sale_average_paise, min(price) FILTER (s) AS sale_low_paise, count(*) FILTER (NOT s) AS regular_n, {long(half_up('sum(price) FILTER (NOT s)', 'count(*) FILTER (NOT s)'))} AS regular_average_paise,
  median(price) FILTER (NOT s) AS regular_median_paise, CASE WHEN count(*) FILTER (s) = 0 THEN 'no_observations_during_event' END AS reason FROM f GROUP BY 1"""),
    "sal10_discounted": (sal10_discounted, f"WITH {SNAP}, {_drops(_SERIES, 10)} SELECT snapshot_id, listing_id, seller_id, price, prior2, drop_percent FROM dr"),
    "sal10_discounted_long": (sal10_discounted_long, f"WITH {SNAP}, {_drops('product_id', 10)} SELECT snapshot_id, product_id, price, prior2, drop_percent FROM dr"),
    "sal13_windows": (sal13_windows, f"WITH {SNAP}, {_windows(25)} SELECT * EXCLUDE (part) FROM win"),
    "sal13_windows_per_retailer": (sal13_windows_per_retailer, f"WITH {SNAP}, {_windows(10, 'CAST(retailer_id AS VARCHAR)')} SELECT * FROM win"),
    "snk2_new_windows": (snk2_new_windows, f"WITH {SNAP}, old AS (WITH {_windows(25)} SELECT * FROM win), {_windows(10)} SELECT scope || '|' || scope_id || '|' || strftime(start_at, '%Y%m%d') AS event_id, start_at, end_at, event_type, confidence FROM win w WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.scope = w.scope AND o.scope_id = w.scope_id AND o.start_at = w.start_at AND o.end_at = w.end_at)"),
}

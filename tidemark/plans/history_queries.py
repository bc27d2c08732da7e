"""History queries over the projected tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.plans.base_sql import AS_OF, SNAP, half_up, long, percent2, percent4
from tidemark.sources.tables import as_of, products, read, snapshots

at = lambda s: F.lit(s).cast("timestamp")


_HISTORY = ["snapshot_id", "product_id", "listing_id", "seller_id", "brand", "category", "observed_at", "created_at", "displayed_paise", "effective_paise", "mrp_paise", "availability", "confidence"]


def src1_retailer_history(spark: SparkSession, d: str) -> DataFrame:
    return H.history_of(snapshots(spark, d), at("1999-01-01"), at("2000-06-30"), retailer_id=2).select(_HISTORY)


def src1_product_history(spark: SparkSession, d: str) -> DataFrame:
    """All rows of one product, in order."""
    return H.history_of(snapshots(spark, d), at("1995-01-01"), product_id=17).select(_HISTORY)


def src1_listing_history(spark: SparkSession, d: str) -> DataFrame:
    """The oldest three rows of one listing."""
    return H.history_of(snapshots(spark, d), limit=3, listing_id=17 * 5 + 2).select(_HISTORY)


def his1_quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.quality_counts(snapshots(spark, d), "retailer_id", "category")


def his2_window_averages(spark: SparkSession, d: str) -> DataFrame:
    return H.window_averages(snapshots(spark, d), at("2001-05-01"))


def his3_rolling_averages(spark: SparkSession, d: str) -> DataFrame:
    return H.rolling_averages(snapshots(spark, d))


def his4_extrema(spark: SparkSession, d: str) -> DataFrame:
    return H.extrema(snapshots(spark, d))


def his8_changes(spark: SparkSession, d: str) -> DataFrame:
    return H.changes(snapshots(spark, d), *H.SERIES).select("snapshot_id", *H.SERIES, "price", "baseline_paise", "baseline_snapshot_id", "change_percent", "is_drop", "change_reason")


def his10_drop_feed(spark: SparkSession, d: str) -> DataFrame:
    return H.drop_feed(snapshots(spark, d))


def his13_variant_history(spark: SparkSession, d: str) -> DataFrame:
    return H.variant_history(snapshots(spark, d), at("2001-05-01"))


def his12_variant_freshness(spark: SparkSession, d: str) -> DataFrame:
    return H.variant_freshness(snapshots(spark, d), products(spark, d), as_of())


def his12_brand_freshness(spark: SparkSession, d: str) -> DataFrame:
    per_variant = H.variant_freshness(snapshots(spark, d), products(spark, d), as_of())
    return H.roll_up_freshness(per_variant.join(products(spark, d).select("product_id", "brand"), "product_id"), ["brand"])


def his14_page(spark: SparkSession, d: str) -> DataFrame:
    return H.page(snapshots(spark, d), at("1997-01-01"), at("2000-12-31"), 5, 5)


def his15_newest_age(spark: SparkSession, d: str) -> DataFrame:
    return H.newest_age(snapshots(spark, d), as_of())


def availability_feed(spark: SparkSession, d: str) -> DataFrame:
    """Availability events of listings: every order asks for a listing on its date."""
    o = read(spark, d, "orders")
    return o.select((F.col("o_custkey") * 5 + F.col("o_orderkey") % 5).alias("listing_id"), F.col("o_orderdate").alias("fed_at"), F.when(F.col("o_orderstatus") == "F", "out_of_stock").otherwise("in_stock").alias("availability"))


def his16_asof_prices(spark: SparkSession, d: str) -> DataFrame:
    return H.carry_prices(availability_feed(spark, d), snapshots(spark, d))


D7 = (7, 30, 90, 180)
_WIN = lambda a, dd: f"observed_at <= {a} AND observed_at >= {a} - INTERVAL {dd} DAY"
_A = "TIMESTAMP '2001-05-01 00:00:00'"
_AVG = ", ".join(f"{long(half_up(f'sum(price) FILTER ({_WIN(_A, x)})', f'count(*) FILTER ({_WIN(_A, x)})'))} AS avg_{x}d, count(*) FILTER ({_WIN(_A, x)}) AS n_{x}d" for x in D7)
_AGE = "date_diff('microsecond', {t}, {a})"
FRESH = lambda t, a=AS_OF: f"CASE WHEN {t} IS NULL THEN 'missing' WHEN epoch_us({a}) - epoch_us({t}) <= 21600000000 THEN 'fresh' WHEN epoch_us({a}) - epoch_us({t}) <= 86400000000 THEN 'aging' ELSE 'stale' END"
_EXT = """arg_min({'p': price, 's': snapshot_id, 't': observed_at}, ROW(price, observed_at, created_at, snapshot_id)) AS low, arg_min({'p': price, 's': snapshot_id, 't': observed_at}, ROW(-price, observed_at, created_at, snapshot_id)) AS high"""
_EXTCOLS = "low.p AS low_paise, low.s AS low_snapshot_id, low.t AS low_at, high.p AS high_paise, high.s AS high_snapshot_id, high.t AS high_at"


def _changes(keys: str) -> str:
    return f"""c0 AS (SELECT *, lag(price) OVER w AS base, lag(snapshot_id) OVER w AS base_id FROM q WINDOW w AS (PARTITION BY {keys} ORDER BY observed_at, created_at, snapshot_id)),
c AS (SELECT *, base AS baseline_paise, base_id AS baseline_snapshot_id, CASE WHEN base IS NOT NULL THEN {percent4('price - base', 'base')} END AS change_percent, price < base AS is_drop,
  CASE WHEN base IS NULL THEN 'no_comparison_baseline' WHEN base = 0 THEN 'zero_baseline_price' END AS change_reason FROM c0)"""


VARIANT_HISTORY = f"""
{_changes('product_id, listing_id, seller_id')},
lf AS (SELECT product_id AS pid, arg_max({{'p': price, 'b': baseline_paise, 'c': change_percent, 'd': is_drop, 'r': change_reason, 's': snapshot_id, 't': observed_at, 'ret': retailer_id, 'l': listing_id, 'sel': seller_id}}, ROW(observed_at, created_at, snapshot_id)) AS last,
  arg_min({{'p': price, 't': observed_at}}, ROW(observed_at, created_at, snapshot_id)) AS first FROM c GROUP BY 1),
r AS (SELECT c.*, last, first, (epoch_us(observed_at) - epoch_us(first.t)) / 86400000000.0::DOUBLE AS x FROM c JOIN lf ON product_id = pid),
g AS (SELECT product_id, count(*) AS qualifying, {_AVG}, {_EXT}, any_value(last) AS last, any_value(first) AS first, count(*) FILTER (price <= last.p) AS below, sum(price) AS sy, sum(price * price) AS syy,
  sum(x) AS sx, sum(x * price::DOUBLE) AS sxy, sum(x * x) AS sxx, max(x) AS span, count(*)::DOUBLE AS n FROM r GROUP BY 1),
h AS (SELECT *, round(sqrt((qualifying * syy - sy * sy)::DOUBLE / (qualifying * (qualifying - 1))::DOUBLE) / 100, 2) AS sd, n * sxx - sx * sx AS denom FROM g),
vh0 AS (SELECT product_id, qualifying, {', '.join(f'avg_{x}d, n_{x}d' for x in D7)}, {_EXTCOLS}, last.p AS current_paise, last.s AS current_snapshot_id, last.t AS current_at, last.ret AS retailer_id, last.l AS listing_id, last.sel AS seller_id,
  CASE WHEN qualifying >= 2 THEN {percent4('below', 'qualifying')} END AS percentile, CASE WHEN qualifying >= 2 THEN sd END AS volatility, CASE WHEN qualifying >= 2 THEN round(sd / (sy::DOUBLE / qualifying / 100), 4) END AS variation,
  last.b AS baseline_paise, last.c AS change_percent, last.d AS is_drop, last.r AS change_reason,
  CASE WHEN qualifying >= 2 AND denom <> 0 AND first.p <> 0 THEN round((n * sxy - sx * sy::DOUBLE) / denom * span / first.p * 100, 4) END AS trend_percent,
  CASE WHEN qualifying < 2 THEN 'below_minimum_observation_count' WHEN denom = 0 THEN 'zero_time_span' WHEN first.p = 0 THEN 'zero_baseline_price' END AS trend_reason FROM h),
vh AS (SELECT *, CASE WHEN trend_percent IS NULL THEN 'insufficient_history' WHEN abs(trend_percent) <= 2 THEN 'stable' WHEN trend_percent > 0 THEN 'rising' ELSE 'falling' END AS trend FROM vh0)"""

ROLLED = """CASE WHEN count(*) FILTER (status = 'missing') = count(*) THEN 'missing' WHEN count(*) FILTER (status IN ('stale', 'missing')) > 0 THEN 'stale' WHEN count(*) FILTER (status = 'aging') > 0 THEN 'aging' ELSE 'fresh' END AS status,
  min(observed_at) AS oldest_at, max(observed_at) AS newest_at, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'missing') AS missing, count(*) AS offers"""
_VF = f"vf AS (SELECT product_id, brand, n.t AS observed_at, coalesce(n.c, 0) AS observations, {FRESH('n.t')} AS status FROM prod LEFT JOIN (SELECT product_id AS pid, max(observed_at) AS t, count(*) AS c FROM snap GROUP BY 1) n ON product_id = pid)"

QUERIES = {
    "src1_retailer_history": (src1_retailer_history, f"WITH {SNAP} SELECT snapshot_id, product_id, listing_id, seller_id, brand, category, observed_at, created_at, displayed_paise, effective_paise, mrp_paise, availability, confidence FROM snap WHERE retailer_id = 2 AND observed_at BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-06-30'"),
    "src1_product_history": (src1_product_history, f"WITH {SNAP} SELECT {', '.join(_HISTORY)} FROM snap WHERE product_id = 17 AND observed_at >= TIMESTAMP '1995-01-01' ORDER BY observed_at, created_at, snapshot_id"),
    "src1_listing_history": (src1_listing_history, f"WITH {SNAP} SELECT {', '.join(_HISTORY)} FROM snap WHERE listing_id = 87 ORDER BY observed_at, created_at, snapshot_id LIMIT 3"),
    "his1_quality_counts": (his1_quality_counts, f"WITH {SNAP} SELECT retailer_id, category, count(*) FILTER (confidence <> 'low') AS qualifying, count(*) FILTER (confidence = 'low') AS excluded FROM snap GROUP BY ALL"),
    "his2_window_averages": (his2_window_averages, f"WITH {SNAP} SELECT product_id, {_AVG}, {', '.join(f'''CASE WHEN count(*) FILTER ({_WIN(_A, x)}) = 0 THEN 'no_observations_in_window' END AS reason_{x}d''' for x in D7)} FROM q GROUP BY 1"),
    "his3_rolling_averages": (his3_rolling_averages, f"WITH {SNAP} SELECT snapshot_id, product_id, observed_at, price, " + ", ".join(f"{long(half_up(f'sum(price) OVER w{x}', f'count(*) OVER w{x}'))} AS avg_{x}d" for x in D7) + " FROM q WINDOW " + ", ".join(f"w{x} AS (PARTITION BY product_id ORDER BY observed_at RANGE BETWEEN INTERVAL {x} DAY PRECEDING AND CURRENT ROW)" for x in D7)),
    "his4_extrema": (his4_extrema, f"WITH {SNAP}, e AS (SELECT product_id, {_EXT} FROM q GROUP BY 1) SELECT product_id, {_EXTCOLS} FROM e"),
    "his8_changes": (his8_changes, f"WITH {SNAP}, {_changes('product_id, listing_id, seller_id')} SELECT snapshot_id, product_id, listing_id, seller_id, price, baseline_paise, baseline_snapshot_id, change_percent, is_drop, change_reason FROM c"),
    "his10_drop_feed": (his10_drop_feed, f"WITH {SNAP}, {_changes('product_id, listing_id, seller_id')} SELECT snapshot_id, product_id, listing_id, seller_id, observed_at, price, baseline_paise, baseline_snapshot_id, change_percent FROM c WHERE is_drop"),
    "his12_variant_freshness": (his12_variant_freshness, f"WITH {SNAP}, {_VF} SELECT product_id, observed_at, observations, status FROM vf"),
    "his12_brand_freshness": (his12_brand_freshness, f"WITH {SNAP}, {_VF} SELECT brand, {ROLLED} FROM vf GROUP BY 1"),
    "his13_variant_history": (his13_variant_history, f"WITH {SNAP}, {VARIANT_HISTORY} SELECT * FROM vh"),
    "his14_page": (his14_page, f"WITH {SNAP} SELECT product_id, snapshot_id, observed_at, CAST(row_no AS INTEGER) AS row_no, total FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at, created_at, snapshot_id) AS row_no, count(*) OVER (PARTITION BY product_id) AS total FROM snap WHERE observed_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2000-12-31') WHERE row_no > 5 AND row_no <= 10"),
    "his15_newest_age": (his15_newest_age, f"WITH {SNAP} SELECT retailer_id, max(observed_at) AS newest_at, CAST(floor((epoch_us({AS_OF}) - epoch_us(max(observed_at))) / 1000000) AS BIGINT) AS age_seconds FROM snap GROUP BY 1"),
    "his16_asof_prices": (his16_asof_prices, f"""WITH {SNAP}, f AS (SELECT o_custkey * 5 + o_orderkey % 5 AS listing_id, o_orderdate AS fed_at, CASE WHEN o_orderstatus = 'F' THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM orders),
known AS (SELECT listing_id AS lid, observed_at, arg_max({{'d': displayed_paise, 'm': mrp_paise, 's': snapshot_id}}, ROW(created_at, snapshot_id)) AS k FROM snap GROUP BY 1, 2)
SELECT listing_id, fed_at, availability, k.d AS displayed_paise, k.m AS mrp_paise, k.s AS from_snapshot_id, observed_at AS from_at FROM f ASOF JOIN known ON listing_id = lid AND fed_at >= observed_at"""),
}

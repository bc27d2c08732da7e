"""The domain's projections in DuckDB SQL, for the oracle side."""

from __future__ import annotations

SNAP = """
prod AS (SELECT p_partkey AS product_id, p_brand AS brand, p_type AS category, p_name AS title, p_size AS size, CAST(round(p_retailprice * 100) AS BIGINT) AS list_paise FROM part),
sell AS (SELECT s_suppkey AS suppkey, n_regionkey AS retailer_id, s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
snap0 AS (SELECT *, (list_paise * (70 + CAST(l_quantity AS BIGINT))) // 100 AS displayed_paise, CAST(round(l_discount * 100) AS BIGINT) AS cut, CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem JOIN prod ON l_partkey = product_id JOIN sell ON l_suppkey = suppkey JOIN orders ON l_orderkey = o_orderkey),
snap AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS INTEGER)) AS snapshot_id,
  product_id, brand, category, retailer_id, product_id * 5 + retailer_id AS listing_id, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey END AS seller_id,
  l_shipdate AS observed_at, greatest(l_shipdate, o_orderdate) AS created_at, displayed_paise,
  CASE WHEN cut > 5 THEN displayed_paise * (100 - cut) // 100 END AS effective_paise, list_paise * 110 // 100 AS mrp_paise,
  CASE WHEN tax <> 0 THEN tax * 1000 END AS delivery_paise, CASE WHEN l_linenumber = 1 THEN CAST(4900 AS BIGINT) END AS platform_paise,
  CASE WHEN l_quantity <= 5 THEN 'limited_stock' WHEN l_linestatus = 'O' THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
  CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence, l_linenumber AS line_no, suppkey FROM snap0),
q AS (SELECT *, coalesce(effective_paise, displayed_paise) AS price FROM snap WHERE confidence IN ('high', 'medium'))"""

ADJ = """
adj AS (SELECT snapshot_id, CASE line_no % 4 WHEN 0 THEN 'coupon' WHEN 1 THEN 'payment_offer' ELSE 'cashback' END AS kind, CASE WHEN suppkey % 11 <> 0 THEN CAST(line_no * 1000 AS BIGINT) END AS amount_paise,
  ['verified_eligible', 'conditional', 'membership_required', 'payment_specific', 'ineligible', 'unavailable', 'verified_eligible'][suppkey % 7 + 1] AS eligibility FROM snap WHERE line_no % 4 <> 3)"""

EVENTS = """
yr AS (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS y),
ev0 AS (
  SELECT 'all-' || y AS event_id, CAST(NULL AS INTEGER) AS retailer_id, CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS category, make_timestamp(y, 10, 5, 0, 0, 0) AS start_at, 10 AS days, 'manually_curated' AS event_type, 'manual_curation' AS source, 'high' AS confidence FROM yr
  UNION ALL SELECT 'shop-' || y || '-' || r, r, NULL, NULL, make_timestamp(y, r + 1, 10, 0, 0, 0), 15, 'retailer_specific', CASE WHEN r = 0 THEN 'observed_price_inference' ELSE 'official_api' END, CASE WHEN r = 1 THEN 'low' ELSE 'medium' END FROM yr, (SELECT CAST(unnest(range(5)) AS INTEGER) AS r)
  UNION ALL SELECT 'brand-' || y || '-' || b, NULL, 'Brand#' || b, NULL, make_timestamp(y, 8, 1 + b, 0, 0, 0), 5, 'brand', 'affiliate_feed', CASE WHEN b = 1 THEN 'low' ELSE 'high' END FROM yr, (SELECT CAST(unnest(range(1, 26, 5)) AS INTEGER) AS b)
  UNION ALL SELECT 'kind-' || y || '-' || k, NULL, NULL, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][k + 1], make_timestamp(y, 3 + k, 20, 0, 0, 0), 7, 'category', 'product_feed', 'medium' FROM yr, (SELECT CAST(unnest(range(6)) AS INTEGER) AS k)),
ev AS (SELECT event_id, retailer_id, brand, category, start_at, start_at + to_days(CAST(days AS INTEGER)) AS end_at, event_type, source, confidence FROM ev0)"""

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"


def half_up(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CASE WHEN ({num}) < 0 THEN -((2 * abs({num}) + ({den})) // (2 * ({den}))) ELSE (2 * ({num}) + ({den})) // (2 * ({den})) END END)"


def percent4(num: str, den: str) -> str:
    return f"({half_up(f'CAST(({num}) AS HUGEINT) * 1000000', den)} / 10000.0::DOUBLE)"


def percent2(num: str, den: str) -> str:
    return f"({half_up(f'CAST(({num}) AS HUGEINT) * 10000', den)} / 100.0::DOUBLE)"


def long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"

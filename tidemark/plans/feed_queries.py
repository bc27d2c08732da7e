"""Feed, text and catalogue queries. Raw feeds are derived from the part table in each retailer's own shape, with bad rows by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import catalog as C
from tidemark.plans.base_sql import EVENTS, SNAP
from tidemark.sources import feeds as S
from tidemark.sources.scratch import scratch_folder, spread
from tidemark.sources.tables import products, read, sale_events, snapshots

P = lambda: F.col("product_id")
_txt = lambda p: F.format_string("%d.%02d", (p / 100).cast("long"), p % 100)
_none = lambda t="string": F.lit(None).cast(t)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts dealt over all tasks: payloads are made and parsed for every row, which one task would do for a file of one block."""
    return spread(products(spark, d), "product_id")


def _packs(spark: SparkSession, d: str) -> GroupedData:
    """Ten parts a payload, brought together as parts, not as the items made of them, which are several times as wide."""
    numbered = products(spark, d).withColumn("n", F.call_function("div", P(), F.lit(10)))
    return spread(numbered, "n").groupBy("n")


def raw_api(spark: SparkSession, d: str) -> DataFrame:
    stock = F.element_at(F.array(*map(F.lit, ["IN_STOCK", "LIMITED", "OUT_OF_STOCK", "GONE"])), (P() % 4 + 1).cast("int"))
    row = F.struct(
        F.when(P() % 50 == 0, " ").otherwise(F.concat(F.lit("A-"), P())).alias("sku"), F.concat(F.lit("  "), "title", F.lit("   (Size "), "size", F.lit(")")).alias("productName"), F.col("brand").alias("brand"), F.array(F.lit("Catalog"), "category").alias("categoryPath"),
        F.create_map(F.lit("Storage"), F.concat("size", F.lit(" GB")), F.lit("Colour"), F.concat(F.lit(" "), F.initcap(F.substring_index("title", " ", 1)))).alias("attributes"), F.lpad(P().cast("string"), 13, "0").alias("gtin"),
        F.call_function("div", F.col("list_paise") * 11, F.lit(10)).alias("listPriceInPaise"), F.when(P() % 31 != 0, F.col("list_paise")).alias("sellingPriceInPaise"), stock.alias("stock"),
        F.struct(F.concat(F.lit("S"), P() % 7).alias("id"), F.lit("Some Seller").alias("name"), (P() % 2 == 0).alias("firstParty")).alias("fulfilledBy"),
    )
    return _parts(spark, d).select(F.to_json(row).alias("payload")).select(F.from_json("payload", S.API_SCHEMA).alias("r")).select("r.*")


def raw_flat(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select(
        F.concat(F.lit("B-"), P()).alias("item_id"), F.col("title").alias("name"), F.col("brand").alias("mfr"), F.concat(F.lit("Root>"), "category").alias("cat"), F.when(P() % 3 == 0, F.lower("category")).alias("cat_slug"),
        F.concat(F.lit("Size = "), "size", F.lit("|bad|Colour=Dark=Red|")).alias("specs"), F.concat(F.lit("pn-"), P()).alias("mpn"), _txt(F.call_function("div", F.col("list_paise") * 11, F.lit(10))).alias("mrp"), F.when(P() % 23 == 0, "N/A").otherwise(_txt(F.col("list_paise"))).alias("price"),
        F.when(P() % 2 == 0, _txt(F.col("list_paise") - 500)).alias("final_payable"), F.when(P() % 5 == 0, "-1").when(P() % 3 == 0, "40.00").alias("delivery"), F.element_at(F.array(*map(F.lit, ["y", "L", "N", "?"])), (P() % 4 + 1).cast("int")).alias("stock"),
        F.concat(F.lit("c"), P() % 9).alias("seller_code"), F.lit("Third Party").alias("seller_name"),
    )


def raw_nested(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select(
        F.concat(F.lit("C/"), P()).alias("item_code"), F.when(P() % 40 != 0, F.col("title")).alias("title"), F.col("brand").alias("manufacturer"), F.col("category").alias("department"), F.create_map(F.lit("size"), F.col("size").cast("string")).alias("variant"),
        _txt(F.col("list_paise")).alias("mrp_inr"), _txt(F.col("list_paise") - 100).alias("offer_inr"), F.when(P() % 2 == 0, "9.50").alias("platform_fee_inr"), F.element_at(F.array(*map(F.lit, ["In_Stock", "limited", "sold_out", "unknown", "??"])), (P() % 5 + 1).cast("int")).alias("stock_state"),
    )


def raw_market(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of ten items each, as JSON text, parsed with the declared schema."""
    shown = lambda c: F.struct(c.alias("displayValue"))
    money = lambda c: F.struct(F.struct(c.alias("amount"), F.lit("INR").alias("currency")).alias("money"))
    offer = lambda won, paise, kind: F.struct(won.alias("isBuyBoxWinner"), F.struct(F.struct(_txt(paise).alias("amount"), F.lit("INR").alias("currency")).alias("money"), money(_txt(F.col("list_paise") * 2)).alias("savingBasis")).alias("price"), F.struct(F.lit("M1").alias("id"), F.when(P() % 3 == 0, "Amazon.in").otherwise("Shop").alias("name")).alias("merchantInfo"), F.struct(kind.alias("type")).alias("availability"))
    kinds = F.element_at(F.array(*map(F.lit, ["in stock", "LOW_STOCK", "Unavailable", "SOMEDAY"])), (P() % 4 + 1).cast("int"))
    item = F.struct(
        F.concat(F.lit("M"), P()).alias("asin"), F.struct(shown(F.col("title")).alias("title"), shown(F.col("brand")).alias("brand"), F.struct(F.struct(F.array(F.lpad(P().cast("string"), 13, "0"), F.lit(" ")).alias("displayValues")).alias("eans"), F.struct(F.array(F.lpad(P().cast("string"), 12, "0")).alias("displayValues")).alias("upcs")).alias("externalIds"), shown(F.concat(F.lit("pn-"), P())).alias("itemPartNumber")).alias("itemInfo"),
        F.array(offer(F.lit(False), F.col("list_paise") + 700, F.lit("NOW")), offer(P() % 2 == 0, F.col("list_paise"), kinds)).alias("listings"),
    )
    packed = _packs(spark, d).agg(F.collect_list(item).alias("items"))
    return packed.select(F.to_json(F.struct(F.struct("items").alias("searchResult"))).alias("payload")).select(F.from_json("payload", S.MARKET_SCHEMA).alias("r")).select("r.*")


def raw_affiliate(spark: SparkSession, d: str) -> DataFrame:
    money = lambda c: F.struct(c.alias("amount"), F.lit("INR").alias("currency"))
    path = F.concat(F.lit('[[{"node_name":"FLIPKART_TREE"},{"node_name":"Goods"},{"title":"'), "category", F.lit('"}]]'))
    base = F.struct(
        F.concat(F.lit("F"), P()).alias("productId"), F.col("title").alias("title"), F.col("brand").alias("productBrand"), path.alias("categoryPath"), F.when(P() % 3 != 2, P() % 3 == 0).alias("inStock"), F.when(P() % 2 == 0, F.lit(" Red ")).alias("color"), F.col("size").cast("string").alias("size"),
        F.when(P() % 4 == 0, money(_txt(F.col("list_paise")))).alias("flipkartSellingPrice"), F.when(P() % 4 == 1, money(_txt(F.col("list_paise") + 1))).alias("sellingPrice"), F.when(P() % 4 == 2, money(_txt(F.col("list_paise") + 2))).alias("flipkartSpecialPrice"), money(_txt(F.col("list_paise") * 2)).alias("maximumRetailPrice"),
    )
    seller = F.struct(F.when(P() % 3 == 0, "WS Retail").otherwise("Other").alias("sellerName"))
    new, old = F.when(P() % 2 == 0, base), F.when(P() % 2 == 1, F.struct(F.struct(base["productId"].alias("productId"), path.alias("categoryPath")).alias("productIdentifier"), base.alias("productAttributes")))
    item = F.struct(new.alias("productBaseInfoV1"), F.when(P() % 2 == 0, seller).alias("productShippingInfoV1"), old.alias("productBaseInfo"), F.when(P() % 2 == 1, seller).alias("productShippingBaseInfo"))
    packed = _packs(spark, d).agg(F.collect_list(item).alias("productInfoList"))
    return packed.select(F.to_json(F.struct("productInfoList")).alias("payload")).select(F.from_json("payload", S.AFFILIATE_SCHEMA).alias("r")).select("r.*")


def all_feeds(spark: SparkSession, d: str) -> DataFrame:
    return S.union(S.parse_api(raw_api(spark, d)), S.parse_flat(raw_flat(spark, d)), S.parse_nested(raw_nested(spark, d)), S.parse_market(raw_market(spark, d)), S.parse_affiliate(raw_affiliate(spark, d)))


def _flat(rows: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("identifiers", lambda i: F.concat(i["kind"], F.lit(":"), i["value"])), "|")
    return rows.select("feed", "sku", "title", "brand_slug", "category_slug", "variant_key", ids.alias("identifiers"), "displayed_paise", "mrp_paise", "effective_paise", "delivery_paise", "platform_paise", "availability", "seller_external_id", "seller_name", "first_party", "error")


def src2_api(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.parse_api(raw_api(spark, d)))


def src3_flat(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.parse_flat(raw_flat(spark, d)))


def src4_nested(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.parse_nested(raw_nested(spark, d)))


def src5_market(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.parse_market(raw_market(spark, d)))


def src6_affiliate(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.parse_affiliate(raw_affiliate(spark, d)))


def nrm10_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return S.quarantine_counts(all_feeds(spark, d))


def nrm11_event_errors(spark: SparkSession, d: str) -> DataFrame:
    """Events attached to their brand's products, with kinds and sources turned round so that every rule is met somewhere."""
    e = sale_events(spark).join(products(spark, d).select("product_id", F.col("brand").alias("_b")), F.col("brand") == F.col("_b"))
    kind = F.element_at(F.array(*map(F.lit, ["brand", "retailer_specific", "manually_curated", "externally_sourced", "category"])), (P() % 5 + 1).cast("int"))
    src = F.element_at(F.array(*map(F.lit, ["manual_curation", "official_api", "observed_price_inference"])), (P() % 3 + 1).cast("int"))
    end = F.when(P() % 11 == 0, F.col("start_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("end_at"))
    rows = e.select("event_id", "product_id", T.event_error(kind, src, F.when(P() % 2 == 0, F.lit("ref")), F.col("retailer_id"), F.col("category"), F.col("brand"), F.col("start_at"), end).alias("error"))
    return rows.groupBy("error").agg(F.count("*").alias("events"))


def nrm12_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as log lines with credentials planted by rule."""
    c = read(spark, d, "conversations")
    line = F.concat(F.lit("token: abc"), F.col("conv_id"), F.lit(" Bearer xyz "), F.lit("redis://u:p@host/0 "), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", T.redacted(line).alias("line"))


def nrm13_search(spark: SparkSession, d: str) -> DataFrame:
    """A page of each retailer's listings with `ring` in the title and one category."""
    listings = products(spark, d).where(F.contains(F.lower("title"), F.lit("ring")) & (F.col("category") == "PROMO")).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("retailer_id"), "product_id", "title")
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy("retailer_id").orderBy("product_id"))
    kept = listings.withColumn("turn", turn).where("turn <= 20")
    return C.page(kept.withColumn("total", F.count("*").over(Window.partitionBy())), ["retailer_id", "product_id"], 10, 40).select("retailer_id", "product_id", "title", "total")


def nrm14_keys(spark: SparkSession, d: str) -> DataFrame:
    scope = F.create_map(F.lit("sku"), F.concat(F.lit("A-"), P()), F.lit("brand"), F.when(P() % 3 != 0, F.col("brand")), F.lit("note"), F.repeat(F.lit("x"), (P() % 7 * 100).cast("int")))
    return products(spark, d).select("product_id", T.idempotency_key(F.lit("price_refresh"), F.concat(F.lit("shop-"), P() % 5), scope).alias("idempotency_key"))


def cat1_brands(spark: SparkSession, d: str) -> DataFrame:
    """Brands that the listings bring and the dimension (every second brand) doesn't have yet."""
    rows = products(spark, d).select(T.slug(F.col("brand")).alias("slug"), F.col("brand").alias("name"), "product_id")
    have = rows.where(F.regexp_extract("slug", "(\\d+)$", 1).cast("int") % 2 == 0).select("slug").distinct()
    return C.new_rows(rows, have, ["slug"], [F.col("product_id")]).select("slug", "name")


def cat2_sellers(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.tables import sellers

    s = sellers(spark, d)
    have = s.where("suppkey % 3 = 0").select("retailer_id", F.col("suppkey").cast("string").alias("external_id"), F.concat(F.lit("s-"), "suppkey").alias("seller_id"), (F.col("suppkey") % 2 == 0).alias("first_party"))
    asked = s.select("retailer_id", F.col("suppkey").cast("string").alias("external_id"), (F.col("suppkey") % 4 == 0).alias("first_party"))
    return C.merge_sellers(asked, have)


def _listings(spark: SparkSession, d: str) -> DataFrame:
    ids = F.filter(F.array(F.struct(F.lit("gtin").alias("kind"), F.when(P() % 2 == 0, F.lpad(P().cast("string"), 13, "0")).otherwise("").alias("value")), F.struct(F.lit("mpn").alias("kind"), F.concat(F.lit("pn-"), F.call_function("div", P(), F.lit(3))).alias("value"))), lambda i: i["value"].isNotNull())
    return products(spark, d).select((P() % 5).cast("int").alias("retailer_id"), F.concat(F.lit("L"), P()).alias("sku"), ids.alias("identifiers"))


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    gtin = products(spark, d).where("product_id % 6 = 0").select(F.lit("gtin").alias("kind"), F.lpad(P().cast("string"), 13, "0").alias("value"), F.concat(F.lit("v"), P()).alias("variant_id"))
    mpn = products(spark, d).where("product_id % 6 = 3").select(F.lit("mpn"), F.concat(F.lit("pn-"), F.call_function("div", P(), F.lit(3))), F.concat(F.lit("v"), P()))
    return gtin.union(mpn)


def resolved(spark: SparkSession, d: str) -> DataFrame:
    known = products(spark, d).where("product_id % 4 = 1").select((P() % 5).cast("int").alias("retailer_id"), F.concat(F.lit("L"), P()).alias("sku"), F.concat(F.lit("old"), P()).alias("variant_id"))
    return C.resolve(_listings(spark, d), _identifiers(spark, d), known)


def cat3_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("retailer_id", "sku", "variant_id", "resolved_by")


def cat4_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return C.attach_identifiers(resolved(spark, d), _identifiers(spark, d)).where("value <> ''").groupBy("kind", "state").agg(F.count("*").alias("identifiers"))


def cat5_listings(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return C.merge_listings(s.select("retailer_id", F.col("listing_id").cast("string").alias("sku"), F.col("observed_at").alias("seen_at"), F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("u/"), "snapshot_id")).alias("url")))


def cat6_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = products(spark, d).select(T.slug(F.col("title")).alias("slug"), (P() % 5).cast("int").alias("retailer_id"), F.concat(F.lit("L"), P() % 900).alias("sku"), "product_id")
    return C.unique_slugs(rows.dropDuplicates(["slug", "retailer_id", "sku"]).drop("product_id")).select("slug", "retailer_id", "sku", "unique_slug")


def cat7_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants found by attributes in any order and spelling."""
    a = products(spark, d).select("product_id", T.variant_key(T.normal_attributes(F.create_map(F.lit("Size"), F.col("size").cast("string"), F.lit("Colour"), F.upper(F.substring_index("title", " ", 1))))).alias("key"))
    b = products(spark, d).select(F.col("product_id").alias("other_id"), T.variant_key(T.normal_attributes(F.create_map(F.lit("color"), F.concat(F.substring_index("title", " ", 1), F.lit(" ")), F.lit("size"), F.col("size").cast("string")))).alias("key"))
    asked, known = a.groupBy("key").agg(F.count("*").alias("variants")), b.groupBy("key").agg(F.min("other_id").alias("first_id"))  # a key may hold many on both sides
    return asked.join(known, "key")


def cat8_counts(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).groupBy("category", "brand").agg(F.count("*").alias("products"))


def cat8_pages(spark: SparkSession, d: str) -> DataFrame:
    """The second page of three of every category, by title."""
    return C.pages(products(spark, d).select("category", "title", "product_id"), "category", [F.col("title"), P()], 3, 3)


def cat8_retailers(spark: SparkSession, d: str) -> DataFrame:
    """Retailers that have something of a category on offer, and the products they have."""
    able = snapshots(spark, d).where(F.col("availability").isin("in_stock", "limited_stock"))
    pairs = able.select("category", "retailer_id", "product_id").distinct()
    return pairs.groupBy("category").agg(F.count_distinct("retailer_id").alias("retailers"), F.count_distinct("product_id").alias("products"))


def cat8_children(spark: SparkSession, d: str) -> DataFrame:
    """A tree of categories, regions above nations, with the number of their children."""
    top = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("category_id"), _none().alias("parent_id"), F.col("r_name").alias("name"))
    low = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("category_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    return C.children(top.unionByName(low))


def src2_api_files(spark: SparkSession, d: str) -> DataFrame:
    """The API feed read from JSON files."""
    folder = scratch_folder(spark, "feeds")
    raw_api(spark, d).write.json(folder)
    return _flat(S.parse_api(S.read_json_feed(spark, folder, S.API_SCHEMA)))


def src3_flat_files(spark: SparkSession, d: str) -> DataFrame:
    """The flat feed read from CSV files with a header."""
    folder = scratch_folder(spark, "feeds")
    raw_flat(spark, d).select([x.split()[0] for x in S.FLAT_SCHEMA.split(", ")]).write.options(header=True, escape='"').csv(folder)
    return _flat(S.parse_flat(S.read_flat_feed(spark, folder)))


def snk1_new_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What an append of the last two years would write if every third listing was there already."""
    s = snapshots(spark, d)
    batch = s.where(F.col("observed_at") >= F.lit("2000-01-01").cast("timestamp"))
    return C.new_snapshots(batch, s.where("listing_id % 3 = 0").withColumn("observed_date", F.to_date("observed_at"))).select("snapshot_id", "listing_id", "seller_id", "observed_at")


_BAR = "lpad(CAST(product_id AS VARCHAR), 13, '0')"
_SLUG = lambda x: f"nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"
_NUL = "CAST(NULL AS {}) AS {}"
_B = "CAST(NULL AS BIGINT)"
API_SQL = f"""SELECT 'api' AS feed, CASE WHEN product_id % 50 <> 0 THEN 'A-' || product_id END AS sku, title || ' (Size ' || size || ')' AS title, {_SLUG('brand')} AS brand_slug, {_SLUG('category')} AS category_slug, 'color=' || lower(split_part(title, ' ', 1)) || ';storage=' || size || ' gb' AS variant_key, 'gtin:' || {_BAR} AS identifiers,
  CASE WHEN product_id % 31 <> 0 THEN list_paise END AS displayed_paise, list_paise * 11 // 10 AS mrp_paise, {_B} AS effective_paise, {_B} AS delivery_paise, {_B} AS platform_paise, ['in_stock', 'limited_stock', 'out_of_stock', NULL][product_id % 4 + 1] AS availability, 'S' || product_id % 7 AS seller_external_id, 'Some Seller' AS seller_name, product_id % 2 = 0 AS first_party,
  CASE WHEN product_id % 50 = 0 THEN 'missing_id' WHEN product_id % 31 = 0 THEN 'bad_amount' WHEN product_id % 4 = 3 THEN 'bad_stock' END AS error FROM prod"""
FLAT_SQL = f"""SELECT 'flat' AS feed, 'B-' || product_id AS sku, title, {_SLUG('brand')} AS brand_slug, lower(category) AS category_slug, 'color=dark=red;size=' || size AS variant_key, 'mpn:pn-' || product_id AS identifiers, CASE WHEN product_id % 23 <> 0 THEN list_paise END AS displayed_paise, list_paise * 11 // 10 AS mrp_paise,
  CASE WHEN product_id % 2 = 0 THEN list_paise - 500 END AS effective_paise, CASE WHEN product_id % 5 = 0 THEN NULL WHEN product_id % 3 = 0 THEN CAST(4000 AS BIGINT) END AS delivery_paise, {_B} AS platform_paise, ['in_stock', 'limited_stock', 'out_of_stock', NULL][product_id % 4 + 1] AS availability, 'c' || product_id % 9 AS seller_external_id, 'Third Party' AS seller_name, false AS first_party,
  CASE WHEN product_id % 5 = 0 OR product_id % 23 = 0 THEN 'bad_amount' WHEN product_id % 4 = 3 THEN 'bad_stock' END AS error FROM prod"""
NESTED_SQL = f"""SELECT 'nested' AS feed, 'C/' || product_id AS sku, CASE WHEN product_id % 40 <> 0 THEN title END AS title, {_SLUG('brand')} AS brand_slug, {_SLUG('category')} AS category_slug, 'size=' || size AS variant_key, '' AS identifiers, list_paise - 100 AS displayed_paise, list_paise AS mrp_paise, {_B} AS effective_paise, {_B} AS delivery_paise, CASE WHEN product_id % 2 = 0 THEN CAST(950 AS BIGINT) END AS platform_paise,
  ['in_stock', 'limited_stock', 'out_of_stock', 'unknown', NULL][product_id % 5 + 1] AS availability, 'nested' AS seller_external_id, 'house' AS seller_name, true AS first_party, CASE WHEN product_id % 40 = 0 THEN 'missing_title' WHEN product_id % 5 = 4 THEN 'bad_stock' END AS error FROM prod"""
MARKET_SQL = f"""SELECT 'market' AS feed, 'M' || product_id AS sku, title, {_SLUG('brand')} AS brand_slug, CAST(NULL AS VARCHAR) AS category_slug, CAST(NULL AS VARCHAR) AS variant_key, 'ean:' || {_BAR} || '|upc:' || lpad(CAST(product_id AS VARCHAR), 12, '0') || '|mpn:pn-' || product_id AS identifiers, CASE WHEN product_id % 2 = 0 THEN list_paise ELSE list_paise + 700 END AS displayed_paise, list_paise * 2 AS mrp_paise,
  {_B} AS effective_paise, {_B} AS delivery_paise, {_B} AS platform_paise, CASE WHEN product_id % 2 = 1 THEN 'in_stock' ELSE ['in_stock', '', 'out_of_stock', ''][product_id % 4 + 1] END AS availability, 'M1' AS seller_external_id, CASE WHEN product_id % 3 = 0 THEN 'Amazon.in' ELSE 'Shop' END AS seller_name, product_id % 3 = 0 AS first_party, CAST(NULL AS VARCHAR) AS error FROM prod"""
AFFILIATE_SQL = f"""SELECT 'affiliate' AS feed, 'F' || product_id AS sku, title, {_SLUG('brand')} AS brand_slug, {_SLUG('category')} AS category_slug, CASE WHEN product_id % 2 = 0 THEN 'color=red;' ELSE '' END || 'size=' || size AS variant_key, '' AS identifiers, [list_paise, list_paise + 1, list_paise + 2, NULL][product_id % 4 + 1] AS displayed_paise, list_paise * 2 AS mrp_paise, {_B} AS effective_paise, {_B} AS delivery_paise, {_B} AS platform_paise,
  ['in_stock', 'out_of_stock', 'unknown'][product_id % 3 + 1] AS availability, CAST(NULL AS VARCHAR) AS seller_external_id, CASE WHEN product_id % 3 = 0 THEN 'WS Retail' ELSE 'Other' END AS seller_name, product_id % 3 = 0 AS first_party, CASE WHEN product_id % 4 = 3 THEN 'bad_amount' END AS error FROM prod"""
_IDS = f"""have AS (SELECT 'gtin' AS kind, {_BAR} AS value, 'v' || product_id AS owner FROM prod WHERE product_id % 6 = 0 UNION ALL SELECT 'mpn', 'pn-' || product_id // 3, 'v' || product_id FROM prod WHERE product_id % 6 = 3),
ask AS (SELECT product_id, CAST(product_id % 5 AS INTEGER) AS retailer_id, 'L' || product_id AS sku, 0 AS pos, 'gtin' AS kind, CASE WHEN product_id % 2 = 0 THEN {_BAR} ELSE '' END AS value FROM prod UNION ALL SELECT product_id, CAST(product_id % 5 AS INTEGER), 'L' || product_id, 1, 'mpn', 'pn-' || product_id // 3 FROM prod),
res AS (SELECT retailer_id, sku, coalesce(h, CASE WHEN product_id % 4 = 1 THEN 'old' || product_id END, 'new-' || retailer_id || '-' || sku) AS variant_id, CASE WHEN h IS NOT NULL THEN 'identifier' WHEN product_id % 4 = 1 THEN 'sku' ELSE 'new' END AS resolved_by
  FROM (SELECT product_id, retailer_id, sku, arg_min(owner, pos) AS h FROM ask LEFT JOIN have USING (kind, value) GROUP BY ALL))"""
_RE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)(rediss?://)([^/@]+)@', '\\1[REDACTED]@', 'g'), '(?i)(bearer\\s+)[^\\s]+', '\\1[REDACTED]', 'g'), '(?i)\\b(api[-_]?key|token|password|secret|authorization|access[-_]?key)\\s*[:=]\\s*\\S+', '\\1=[REDACTED]', 'g'), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@', '\\1[REDACTED]@', 'g')"
_LINE = _RE.format(x="trim('token: abc' || conv_id || ' Bearer xyz redis://u:p@host/0 ' || coalesce(text, ''), ' ')")

QUERIES = {
    "src2_api_files": (src2_api_files, f"WITH {SNAP} {API_SQL}"),
    "src3_flat_files": (src3_flat_files, f"WITH {SNAP} {FLAT_SQL}"),
    "cat8_pages": (cat8_pages, f"WITH {SNAP} SELECT category, title, product_id, CAST(row_no AS INTEGER) AS row_no, total FROM (SELECT category, title, product_id, row_number() OVER (PARTITION BY category ORDER BY title, product_id) AS row_no, count(*) OVER (PARTITION BY category) AS total FROM prod) WHERE row_no BETWEEN 4 AND 6"),
    "cat8_retailers": (cat8_retailers, f"WITH {SNAP} SELECT category, count(DISTINCT retailer_id) AS retailers, count(DISTINCT product_id) AS products FROM snap WHERE availability IN ('in_stock', 'limited_stock') GROUP BY 1"),
    "cat8_children": (cat8_children, "WITH c AS (SELECT 'r' || r_regionkey AS category_id, NULL AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation) SELECT c.*, (SELECT count(*) FROM c x WHERE x.parent_id = c.category_id) AS children FROM c"),
    "src2_api": (src2_api, f"WITH {SNAP} {API_SQL}"),
    "src3_flat": (src3_flat, f"WITH {SNAP} {FLAT_SQL}"),
    "src4_nested": (src4_nested, f"WITH {SNAP} {NESTED_SQL}"),
    "src5_market": (src5_market, f"WITH {SNAP} {MARKET_SQL}"),
    "src6_affiliate": (src6_affiliate, f"WITH {SNAP} {AFFILIATE_SQL}"),
    "nrm10_quarantine": (nrm10_quarantine, f"WITH {SNAP} SELECT feed, error, count(*) AS bad_rows FROM ({API_SQL} UNION ALL {FLAT_SQL} UNION ALL {NESTED_SQL} UNION ALL {MARKET_SQL} UNION ALL {AFFILIATE_SQL}) WHERE error IS NOT NULL GROUP BY ALL"),
    "nrm11_event_errors": (nrm11_event_errors, f"""WITH {SNAP}, {EVENTS}, r AS (SELECT product_id AS p, start_at, CASE WHEN product_id % 11 = 0 THEN start_at - INTERVAL 1 DAY ELSE end_at END AS e, ['brand', 'retailer_specific', 'manually_curated', 'externally_sourced', 'category'][product_id % 5 + 1] AS k, ['manual_curation', 'official_api', 'observed_price_inference'][product_id % 3 + 1] AS s FROM ev JOIN prod USING (brand))
SELECT CASE WHEN e < start_at THEN 'bad_dates' WHEN k = 'retailer_specific' THEN 'retailer_required' WHEN k = 'category' THEN 'category_required' WHEN k = 'manually_curated' AND s <> 'manual_curation' THEN 'source_not_manual' WHEN k = 'externally_sourced' AND s = 'observed_price_inference' THEN 'inference_not_external' WHEN k = 'externally_sourced' AND s = 'manual_curation' THEN 'source_not_permitted' WHEN k = 'externally_sourced' AND p % 2 = 1 THEN 'source_ref_required' END AS error, count(*) AS events FROM r GROUP BY 1"""),
    "nrm12_redacted": (nrm12_redacted, f"SELECT conv_id, turn, CASE WHEN length({_LINE}) > 1000 THEN substr({_LINE}, 1, 997) || '...' ELSE {_LINE} END AS line FROM conversations"),
    "nrm13_search": (nrm13_search, f"WITH {SNAP}, l AS (SELECT CAST(r AS INTEGER) AS retailer_id, product_id, title FROM prod, (SELECT unnest(range(5)) AS r) WHERE contains(lower(title), 'ring') AND category = 'PROMO'), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY retailer_id ORDER BY product_id) <= 20) SELECT *, count(*) OVER () AS total FROM k ORDER BY retailer_id, product_id LIMIT 40 OFFSET 10"),
    "nrm14_keys": (nrm14_keys, f"""WITH {SNAP}, r AS (SELECT product_id, 'price_refresh|shop-' || product_id % 5 || '|' AS h, 'price_refresh|shop-' || product_id % 5 || '|{{' || CASE WHEN product_id % 3 <> 0 THEN '"brand":"' || brand || '",' ELSE '' END || CASE WHEN product_id % 7 <> 0 THEN '"note":"' || repeat('x', CAST(product_id % 7 * 100 AS INTEGER)) || '",' ELSE '' END || '"sku":"A-' || product_id || '"}}' AS raw FROM prod)
SELECT product_id, CASE WHEN length(raw) <= 512 THEN raw ELSE h || sha256(raw) END AS idempotency_key FROM r"""),
    "cat1_brands": (cat1_brands, f"WITH {SNAP} SELECT DISTINCT {_SLUG('brand')} AS slug, brand AS name FROM prod WHERE CAST(regexp_extract(brand, '([0-9]+)$', 1) AS INTEGER) % 2 = 1"),
    "cat2_sellers": (cat2_sellers, f"WITH {SNAP}, h AS (SELECT retailer_id, min('s-' || suppkey) AS house FROM sell WHERE suppkey % 6 = 0 GROUP BY 1) SELECT s.retailer_id, CAST(suppkey AS VARCHAR) AS external_id, suppkey % 4 = 0 AS first_party, CASE WHEN suppkey % 3 = 0 THEN 's-' || suppkey WHEN suppkey % 4 = 0 THEN house END AS seller_id, CASE WHEN suppkey % 3 = 0 THEN 'external_id' WHEN suppkey % 4 = 0 AND house IS NOT NULL THEN 'first_party' ELSE 'new' END AS found_by FROM sell s LEFT JOIN h USING (retailer_id)"),
    "cat3_resolve": (cat3_resolve, f"WITH {SNAP}, {_IDS} SELECT retailer_id, sku, variant_id, resolved_by FROM res"),
    "cat4_identifiers": (cat4_identifiers, f"""WITH {SNAP}, {_IDS}, a AS (SELECT DISTINCT variant_id, kind, value FROM ask JOIN res USING (retailer_id, sku) WHERE value <> ''), o AS (SELECT a.*, owner, min(variant_id) OVER (PARTITION BY kind, value) AS f FROM a LEFT JOIN have USING (kind, value))
SELECT kind, CASE WHEN owner = variant_id THEN 'known' WHEN owner IS NOT NULL THEN 'conflict' WHEN variant_id = f THEN 'new' ELSE 'conflict' END AS state, count(*) AS identifiers FROM o GROUP BY ALL"""),
    "cat5_listings": (cat5_listings, f"WITH {SNAP} SELECT retailer_id, CAST(listing_id AS VARCHAR) AS sku, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, arg_max('u/' || snapshot_id, ROW(observed_at, snapshot_id)) FILTER (line_no % 2 = 0) AS url FROM snap GROUP BY ALL"),
    "cat6_slugs": (cat6_slugs, f"""WITH {SNAP}, r AS (SELECT DISTINCT {_SLUG('title')} AS slug, CAST(product_id % 5 AS INTEGER) AS retailer_id, 'L' || product_id % 900 AS sku FROM prod), n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY retailer_id, sku) = 1 THEN slug ELSE slug || '-' || retailer_id || '-' || lower(sku) END AS s FROM r)
SELECT slug, retailer_id, sku, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY retailer_id, sku) = 1 THEN s ELSE s || '-' || row_number() OVER (PARTITION BY s ORDER BY retailer_id, sku) END AS unique_slug FROM n"""),
    "cat7_variants": (cat7_variants, f"WITH {SNAP} SELECT 'color=' || lower(split_part(title, ' ', 1)) || ';size=' || size AS key, count(*) AS variants, min(product_id) AS first_id FROM prod GROUP BY 1"),
    "cat8_counts": (cat8_counts, f"WITH {SNAP} SELECT category, brand, count(*) AS products FROM prod GROUP BY ALL"),
    "snk1_new_snapshots": (snk1_new_snapshots, f"WITH {SNAP}, b AS (SELECT * FROM snap WHERE observed_at >= TIMESTAMP '2000-01-01' QUALIFY row_number() OVER (PARTITION BY listing_id, observed_at, seller_id ORDER BY created_at, snapshot_id) = 1) SELECT snapshot_id, listing_id, seller_id, observed_at FROM b WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.listing_id % 3 = 0 AND s.listing_id = b.listing_id AND s.observed_at = b.observed_at AND s.seller_id IS NOT DISTINCT FROM b.seller_id)"),
}

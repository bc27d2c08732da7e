"""Retailer feeds: readers with declared schemas, and parsers into one listing shape with an error per bad row.

A parser never fails a batch: it sets `error`, and split() parts good rows from the quarantine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normal_attributes, slug, squeezed, variant_key

MONEY = "struct<amount:string,currency:string>"
API_SCHEMA = "sku string, productName string, brand string, categoryPath array<string>, attributes map<string,string>, gtin string, listPriceInPaise bigint, sellingPriceInPaise bigint, stock string, fulfilledBy struct<id:string,name:string,firstParty:boolean>"
FLAT_SCHEMA = "item_id string, name string, mfr string, cat string, cat_slug string, specs string, mpn string, mrp string, price string, final_payable string, delivery string, stock string, seller_code string, seller_name string"
NESTED_SCHEMA = "item_code string, title string, manufacturer string, department string, variant map<string,string>, mrp_inr string, offer_inr string, platform_fee_inr string, stock_state string"
_SHOWN = "struct<displayValue:string>"
_IDS = "struct<displayValues:array<string>>"
MARKET_SCHEMA = f"searchResult struct<items:array<struct<asin:string,itemInfo:struct<title:{_SHOWN},brand:{_SHOWN},externalIds:struct<eans:{_IDS},upcs:{_IDS}>,itemPartNumber:{_SHOWN}>,listings:array<struct<isBuyBoxWinner:boolean,price:struct<money:{MONEY},savingBasis:struct<money:{MONEY}>>,merchantInfo:struct<id:string,name:string>,availability:struct<type:string>>>>>>"
_BASE = f"productId:string,title:string,productBrand:string,categoryPath:string,inStock:boolean,color:string,size:string,flipkartSellingPrice:{MONEY},sellingPrice:{MONEY},flipkartSpecialPrice:{MONEY},maximumRetailPrice:{MONEY}"
AFFILIATE_SCHEMA = f"productInfoList array<struct<productBaseInfoV1:struct<{_BASE}>,productShippingInfoV1:struct<sellerName:string>,productBaseInfo:struct<productIdentifier:struct<productId:string,categoryPath:string>,productAttributes:struct<{_BASE}>>,productShippingBaseInfo:struct<sellerName:string>>>"

#: Stock words of each feed. Words that aren't listed are an error, but for the marketplace, where they are unknown.
API_STOCK = {"IN_STOCK": "in_stock", "LIMITED": "limited_stock", "OUT_OF_STOCK": "out_of_stock"}
FLAT_STOCK = {"Y": "in_stock", "L": "limited_stock", "N": "out_of_stock"}
NESTED_STOCK = {"in_stock": "in_stock", "limited": "limited_stock", "sold_out": "out_of_stock", "unknown": "unknown"}
MARKET_STOCK = {"IN_STOCK": "in_stock", "INSTOCK": "in_stock", "NOW": "in_stock", "AVAILABLE": "in_stock", "OUT_OF_STOCK": "out_of_stock", "OUTOFSTOCK": "out_of_stock", "UNAVAILABLE": "out_of_stock", "LIMITED": "limited_stock", "LOW_STOCK": "limited_stock", "LIMITED_STOCK": "limited_stock"}
HOUSE_SELLERS = ["flipkart", "ws retail", "flipkart.com"]


def read_json_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones become rows of nulls, which the parsers put into quarantine."""
    return spark.read.schema(schema).json(path)


def read_flat_feed(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; quotes inside quoted values are doubled."""
    return spark.read.schema(FLAT_SCHEMA).options(header=True, escape='"').csv(path)


def _lookup(words: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in words.items() for x in kv))[key]


def text_paise(text: Column) -> Column:
    """Paise of a decimal text; null if it isn't a number or is negative."""
    amount = F.trim(text).try_cast("decimal(20,2)")
    return F.when(amount >= 0, (amount * 100).cast("long"))


def _kept(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _ids(*pairs: tuple[str, Column]) -> Column:
    def named(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("value")))

    if not pairs:
        return F.array().cast("array<struct<kind:string,value:string>>")
    return F.array_distinct(F.filter(F.flatten(F.array(*(named(k, v) for k, v in pairs))), lambda s: s["value"].isNotNull() & (s["value"] != "")))


def _listing(feed: str, *, sku, title, brand, category, attributes, identifiers, displayed, mrp, effective, delivery, platform, stock, seller_id, seller_name, first_party, bad_amount) -> list[Column]:
    error = F.when(_kept(sku).isNull(), "missing_id").when(_kept(title).isNull(), "missing_title").when(bad_amount | displayed.isNull(), "bad_amount").when(stock.isNull(), "bad_stock")
    null = F.lit(None)
    return [
        F.lit(feed).alias("feed"), _kept(sku).alias("sku"), squeezed(title).alias("title"), brand.alias("brand"), slug(brand).alias("brand_slug"), slug(category).alias("category_slug"),
        normal_attributes(attributes).alias("attributes"), variant_key(normal_attributes(attributes)).alias("variant_key"), identifiers.alias("identifiers"),
        displayed.alias("displayed_paise"), mrp.alias("mrp_paise"), (effective if effective is not None else null.cast("long")).alias("effective_paise"), (delivery if delivery is not None else null.cast("long")).alias("delivery_paise"), (platform if platform is not None else null.cast("long")).alias("platform_paise"),
        stock.alias("availability"), seller_id.alias("seller_external_id"), seller_name.alias("seller_name"), first_party.alias("first_party"), error.alias("error"),
    ]


def parse_api(raw: DataFrame) -> DataFrame:
    """Nested records with integer paise."""
    c = F.col
    bad = c("listPriceInPaise").isNull() | (c("listPriceInPaise") < 0) | (c("sellingPriceInPaise") < 0)
    return raw.select(*_listing(
        "api", sku=c("sku"), title=c("productName"), brand=c("brand"), category=F.try_element_at("categoryPath", F.lit(-1)), attributes=c("attributes"), identifiers=_ids(("gtin", F.array("gtin"))),
        displayed=c("sellingPriceInPaise"), mrp=c("listPriceInPaise"), effective=None, delivery=None, platform=None, stock=_lookup(API_STOCK, c("stock")),
        seller_id=c("fulfilledBy.id"), seller_name=c("fulfilledBy.name"), first_party=c("fulfilledBy.firstParty"), bad_amount=bad,
    ))


def parse_flat(raw: DataFrame) -> DataFrame:
    """Flat rows with amounts as text, `a>b` categories and `k=v|k=v` specs; sellers are third parties."""
    c = F.col
    specs = F.transform(F.filter(F.split("specs", "\\|"), lambda s: F.contains(s, F.lit("="))), lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)).alias("key"), F.trim(F.substr(s, F.instr(s, "=") + 1)).alias("value")))
    amounts = {x: text_paise(c(x)) for x in ("mrp", "price", "final_payable", "delivery")}
    bad = amounts["mrp"].isNull() | (c("final_payable").isNotNull() & amounts["final_payable"].isNull()) | (c("delivery").isNotNull() & amounts["delivery"].isNull())
    return raw.select(*_listing(
        "flat", sku=c("item_id"), title=c("name"), brand=c("mfr"), category=F.coalesce(_kept(c("cat_slug")), F.substring_index("cat", ">", -1)), attributes=F.map_from_entries(specs), identifiers=_ids(("mpn", F.array("mpn"))),
        displayed=amounts["price"], mrp=amounts["mrp"], effective=amounts["final_payable"], delivery=amounts["delivery"], platform=None, stock=_lookup(FLAT_STOCK, F.upper("stock")),
        seller_id=c("seller_code"), seller_name=c("seller_name"), first_party=F.lit(False), bad_amount=bad,
    ))


def parse_nested(raw: DataFrame) -> DataFrame:
    """Nested variant block, no identifiers, the retailer itself sells."""
    c = F.col
    amounts = {x: text_paise(c(x)) for x in ("mrp_inr", "offer_inr", "platform_fee_inr")}
    bad = amounts["mrp_inr"].isNull() | (c("platform_fee_inr").isNotNull() & amounts["platform_fee_inr"].isNull())
    return raw.select(*_listing(
        "nested", sku=c("item_code"), title=c("title"), brand=c("manufacturer"), category=c("department"), attributes=c("variant"), identifiers=_ids(),
        displayed=amounts["offer_inr"], mrp=amounts["mrp_inr"], effective=None, delivery=None, platform=amounts["platform_fee_inr"], stock=_lookup(NESTED_STOCK, F.lower("stock_state")),
        seller_id=F.lit("nested"), seller_name=F.lit("house"), first_party=F.lit(True), bad_amount=bad,
    ))


def parse_market(raw: DataFrame) -> DataFrame:
    """Marketplace payloads: items are exploded, the offer is the first buy-box winner, else the first."""
    items = raw.select(F.explode("searchResult.items").alias("i"))
    offer = F.coalesce(F.get(F.filter("i.listings", lambda o: F.coalesce(o["isBuyBoxWinner"], F.lit(False))), 0), F.get("i.listings", 0))
    rows = items.withColumn("o", offer)
    c = F.col
    seller = F.trim(c("o.merchantInfo.name"))
    stock = F.coalesce(_lookup(MARKET_STOCK, F.regexp_replace(F.upper(F.trim(c("o.availability.type"))), " ", "_")), F.lit("unknown"))
    mrp = text_paise(c("o.price.savingBasis.money.amount"))
    return rows.select(*_listing(
        "market", sku=c("i.asin"), title=c("i.itemInfo.title.displayValue"), brand=c("i.itemInfo.brand.displayValue"), category=F.lit(None).cast("string"), attributes=F.lit(None).cast("map<string,string>"),
        identifiers=_ids(("ean", c("i.itemInfo.externalIds.eans.displayValues")), ("upc", c("i.itemInfo.externalIds.upcs.displayValues")), ("mpn", F.array("i.itemInfo.itemPartNumber.displayValue"))),
        displayed=text_paise(c("o.price.money.amount")), mrp=mrp, effective=None, delivery=None, platform=None, stock=stock,
        seller_id=_kept(c("o.merchantInfo.id")), seller_name=_kept(seller), first_party=F.lower(seller).rlike("^amazon($|[. ])"), bad_amount=c("o.price.savingBasis.money.amount").isNotNull() & mrp.isNull(),
    ))


def parse_affiliate(raw: DataFrame) -> DataFrame:
    """Affiliate payloads in two envelope versions; the price is the first of three fields, the category path is JSON in a string."""
    rows = raw.select(F.explode("productInfoList").alias("p"))
    field = lambda n: F.coalesce(F.col(f"p.productBaseInfoV1.{n}"), F.col(f"p.productBaseInfo.productAttributes.{n}"))
    first = F.coalesce(field("flipkartSellingPrice.amount"), field("sellingPrice.amount"), field("flipkartSpecialPrice.amount"))
    pid = F.coalesce(F.col("p.productBaseInfoV1.productId"), F.col("p.productBaseInfo.productIdentifier.productId"))
    path = F.coalesce(F.col("p.productBaseInfoV1.categoryPath"), F.col("p.productBaseInfo.productIdentifier.categoryPath"))
    nodes = F.get(F.from_json(path, "array<array<struct<node_name:string,title:string>>>"), 0)
    names = F.filter(F.transform(nodes, lambda n: F.trim(F.coalesce(n["node_name"], n["title"]))), lambda s: s.isNotNull() & (s != "") & (F.upper(s) != "FLIPKART_TREE"))
    attributes = F.map_filter(F.create_map(F.lit("color"), field("color"), F.lit("size"), field("size")), lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    seller = F.trim(F.coalesce(F.col("p.productShippingInfoV1.sellerName"), F.col("p.productShippingBaseInfo.sellerName")))
    stock = F.when(field("inStock"), "in_stock").when(~field("inStock"), "out_of_stock").otherwise("unknown")
    mrp = text_paise(field("maximumRetailPrice.amount"))
    return rows.select(*_listing(
        "affiliate", sku=pid, title=field("title"), brand=field("productBrand"), category=F.try_element_at(names, F.lit(-1)), attributes=attributes, identifiers=_ids(),
        displayed=text_paise(first), mrp=mrp, effective=None, delivery=None, platform=None, stock=stock,
        seller_id=F.lit(None).cast("string"), seller_name=_kept(seller), first_party=F.lower(seller).isin(HOUSE_SELLERS), bad_amount=field("maximumRetailPrice.amount").isNotNull() & mrp.isNull(),
    ))


def union(*feeds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, feeds)


def split(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)."""
    return listings.where("error is null").drop("error"), listings.where("error is not null")


def quarantine_counts(listings: DataFrame) -> DataFrame:
    """Rows of the quarantine by feed and error.

    Errors are counted, not filtered first: a filter would be moved to where the rows are read, and a small file's one task would parse them all.
    """
    return listings.groupBy("feed", "error").agg(F.count("error").alias("bad_rows")).where("bad_rows > 0")

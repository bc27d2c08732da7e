"""Projections of star-schema tables onto the price domain, and their readers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.money import whole
from tidemark.functions.series import SKEY

AS_OF = dt.datetime(2001, 8, 1)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its local timestamps taken as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def as_of() -> Column:
    return F.lit(AS_OF.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def paise(rupees: Column) -> Column:
    return F.round(rupees * 100).cast("long")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_name").alias("title"), F.col("p_size").alias("size"), paise(F.col("p_retailprice")).alias("list_paise"))


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suppkey, retailer_id): suppliers are the sellers of their region's retailer. Spark broadcasts it while it is small."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("retailer_id"))
    return read(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("suppkey"), "retailer_id", F.col("s_acctbal").alias("acctbal"))


def snapshots(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The fact: one immutable observation per line item.

    Parts come last: what follows then finds all rows of a product in one task, and the strings of parts are moved by no other join.
    Fractions go through the joins as whole numbers, which squeeze better. Where parts are few enough to be broadcast, lines are not moved for
    them; `dealt` moves them by part nevertheless, for what goes on by product, while they are a third as wide as the rows made of them.
    """
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    hundredth = lambda c: F.round(F.col(c) * 100).cast("long")
    line = line.withColumns({"l_quantity": F.col("l_quantity").cast("long"), "l_discount": hundredth("l_discount"), "l_tax": hundredth("l_tax")})
    sold = line.join(orders, line.l_orderkey == F.col("o_orderkey")).join(sellers(spark, sf_dir), line.l_suppkey == F.col("suppkey"))
    rows = (sold.repartition("l_partkey") if dealt else sold).join(products(spark, sf_dir), F.col("l_partkey") == F.col("product_id"))
    displayed = whole(F.col("list_paise") * (70 + F.col("l_quantity")), F.lit(100))
    cut, tax = F.col("l_discount"), F.col("l_tax")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("int")).alias("snapshot_id"),
        "product_id", "brand", "category", "retailer_id",
        (F.col("product_id") * 5 + F.col("retailer_id")).alias("listing_id"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("seller_id"),
        F.col("l_shipdate").alias("observed_at"), F.greatest("l_shipdate", "o_orderdate").alias("created_at"),
        displayed.alias("displayed_paise"),
        F.when(cut > 5, whole(displayed * (100 - cut), F.lit(100))).alias("effective_paise"),
        whole(F.col("list_paise") * 110, F.lit(100)).alias("mrp_paise"),
        F.when(tax != 0, tax * 1000).alias("delivery_paise"),
        F.when(F.col("l_linenumber") == 1, F.lit(4900).cast("long")).alias("platform_paise"),
        F.when(F.col("l_quantity") <= 5, "limited_stock").when(F.col("l_linestatus") == "O", "in_stock").otherwise("out_of_stock").alias("availability"),
        F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("confidence"),
        F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("suppkey"),
    )


ELIGIBILITIES = ["verified_eligible", "conditional", "membership_required", "payment_specific", "ineligible", "unavailable", "verified_eligible"]


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjustments_of(snapshots(spark, sf_dir))


def adjustments_of(rows: DataFrame) -> DataFrame:
    """Promotional adjustments of snapshots: coupon, payment offer, cashback or none by line number."""
    s = rows.where("line_no % 4 <> 3")
    kind, amount, eligibility = adjustment()
    return s.select("snapshot_id", kind.alias("kind"), amount.alias("amount_paise"), eligibility.alias("eligibility"))


def adjustment() -> tuple[Column, Column, Column]:
    """Kind, amount and eligibility of a snapshot's adjustment, by its line and supplier; without one the kind is null."""
    line = F.col("line_no") % 4
    kind = F.when(line == 0, "coupon").when(line == 1, "payment_offer").when(line == 2, "cashback")
    eligibility = F.element_at(F.array(*map(F.lit, ELIGIBILITIES)), (F.col("suppkey") % 7 + 1).cast("int"))
    return kind, F.when(F.col("suppkey") % 11 != 0, F.col("line_no") * 1000).cast("long"), eligibility


def sale_events(spark: SparkSession, years: range = range(1995, 2002)) -> DataFrame:
    """A rule-made calendar: per year an unscoped event, one per retailer, one per fifth brand and one per category."""
    year = spark.range(years.start, years.stop).select(F.col("id").cast("int").alias("y"))
    day = lambda m, d: F.make_timestamp(F.col("y"), m, d, F.lit(0), F.lit(0), F.lit(0))
    none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
    plain = year.select(F.concat(F.lit("all-"), "y").alias("event_id"), none_i.alias("retailer_id"), none_s.alias("brand"), none_s.alias("category"), day(F.lit(10), F.lit(5)).alias("start_at"), F.lit(10).alias("days"), F.lit("manually_curated").alias("event_type"), F.lit("manual_curation").alias("source"), F.lit("high").alias("confidence"))
    shop = year.select("y", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")).select(F.concat(F.lit("shop-"), "y", F.lit("-"), "r"), F.col("r"), none_s, none_s, day(F.col("r") + 1, F.lit(10)), F.lit(15), F.lit("retailer_specific"), F.when(F.col("r") == 0, "observed_price_inference").otherwise("official_api"), F.when(F.col("r") == 1, "low").otherwise("medium"))
    brand = year.select("y", F.explode(F.sequence(F.lit(1), F.lit(25), F.lit(5))).alias("b")).select(F.concat(F.lit("brand-"), "y", F.lit("-"), "b"), none_i, F.concat(F.lit("Brand#"), "b"), none_s, day(F.lit(8), F.lit(1) + F.col("b")), F.lit(5), F.lit("brand"), F.lit("affiliate_feed"), F.when(F.col("b") == 1, "low").otherwise("high"))
    kinds = F.array(*map(F.lit, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]))
    kind = year.select("y", F.posexplode(kinds).alias("k", "c")).select(F.concat(F.lit("kind-"), "y", F.lit("-"), "k"), none_i, none_s, F.col("c"), day(F.lit(3) + F.col("k"), F.lit(20)), F.lit(7), F.lit("category"), F.lit("product_feed"), F.lit("medium"))
    made = plain.union(shop).union(brand).union(kind)
    return made.select("*", F.timestamp_add("DAY", F.col("days"), F.col("start_at")).alias("end_at")).drop("days")


def bucketed(points: DataFrame, name: str, path: str, buckets: int = 200) -> DataFrame:
    """points written once as a table bucketed by listing and sorted along its series: windows, changes and histories of listings read it without a shuffle.

    A bucket should hold less than an executor's share of memory; a listing lies in one bucket.
    """
    points.repartition(buckets, "listing_id").write.bucketBy(buckets, "listing_id").sortBy("listing_id", *SKEY).option("path", path).saveAsTable(name)
    return points.sparkSession.table(name)

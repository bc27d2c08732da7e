"""Catalogue resolution: upserts as joins, listings resolved to variants, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of incoming whose key isn't there yet, the first of each key; null keys match null keys."""
    turn = Window.partitionBy(*keys).orderBy(*order)
    first = incoming.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")
    seen = existing.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return first.join(seen, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


SNAPSHOT_KEY = ["listing_id", "observed_at", "seller_id"]


def new_snapshots(batch: DataFrame, fact: DataFrame) -> DataFrame:
    """What an idempotent append would write: of rows with the same listing, time and seller the first recorded one, unless the fact has it.

    A fact that is partitioned by observed_date is cut to the days of the batch first: they are looked up and given as literals, so
    only the touched partitions are read.
    """
    if "observed_date" in fact.columns:
        days = [r[0] for r in batch.select(F.to_date("observed_at")).distinct().collect()]  # calendar days
        fact = fact.where(F.col("observed_date").isin(days))
    return new_rows(batch, fact, SNAPSHOT_KEY, [F.col("created_at"), F.col("snapshot_id")])


def append_snapshots(batch: DataFrame, path: str) -> None:
    """Append what is new to a fact partitioned by observed date; running it twice writes nothing more."""
    spark = batch.sparkSession
    schema = batch.schema.add("observed_date", "date") if "observed_date" not in batch.columns else batch.schema
    fact = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], batch.schema)
    dated = new_snapshots(batch, fact).withColumn("observed_date", F.to_date("observed_at"))
    dated.write.mode("append").partitionBy("observed_date").parquet(path)


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def resolve(listings: DataFrame, identifiers: DataFrame, known: DataFrame) -> DataFrame:
    """listings with variant_id and how it was found: by the first identifier in listing order, by (retailer, sku), or new.

    identifiers: (kind, value, variant_id), one row per (kind, value); known: (retailer_id, sku, variant_id).
    """
    usable = F.filter("identifiers", lambda i: F.length(F.trim(i["value"])).between(1, 64))
    asked = listings.select("retailer_id", "sku", F.posexplode(usable).alias("pos", "i")).select("retailer_id", "sku", "pos", "i.kind", "i.value")
    hits = asked.join(identifiers, ["kind", "value"]).groupBy("retailer_id", "sku").agg(F.min_by("variant_id", "pos").alias("_by_id"))
    by_sku = known.select("retailer_id", "sku", F.col("variant_id").alias("_by_sku"))
    rows = listings.join(hits, ["retailer_id", "sku"], "left").join(by_sku, ["retailer_id", "sku"], "left")
    fresh = F.concat_ws("-", F.lit("new"), F.col("retailer_id").cast("string"), "sku")
    how = F.when(F.col("_by_id").isNotNull(), "identifier").when(F.col("_by_sku").isNotNull(), "sku").otherwise("new")
    return rows.withColumns({"variant_id": F.coalesce("_by_id", "_by_sku", fresh), "resolved_by": how}).drop("_by_id", "_by_sku")


def attach_identifiers(resolved: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(kind, value, variant_id, state): new identifiers, and those that another variant owns; new ones go to the smallest variant id."""
    asked = resolved.select("variant_id", F.explode("identifiers").alias("i")).select("variant_id", "i.kind", "i.value").distinct()
    owned = asked.join(identifiers.withColumnRenamed("variant_id", "owner"), ["kind", "value"], "left")
    first = F.min("variant_id").over(Window.partitionBy("kind", "value"))
    state = F.when(F.col("owner") == F.col("variant_id"), "known").when(F.col("owner").isNotNull(), "conflict").when(F.col("variant_id") == first, "new").otherwise("conflict")
    return owned.select("kind", "value", "variant_id", state.alias("state"))


def merge_listings(seen: DataFrame) -> DataFrame:
    """One row per (retailer, sku): first and last sight, and the latest url that was given."""
    at = F.when(F.col("url").isNotNull(), F.col("seen_at"))
    return seen.groupBy("retailer_id", "sku").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.max_by("url", F.struct(at, "url")).alias("url"))


def unique_slugs(products: DataFrame, base: str = "slug") -> DataFrame:
    """A slug of its own for every product: the base for the first, then with retailer and sku, then with a number."""
    first = F.row_number().over(Window.partitionBy(base).orderBy("retailer_id", "sku"))
    named = products.withColumn("_turn", first).withColumn("_slug", F.when(F.col("_turn") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("retailer_id").cast("string"), F.lower("sku"))))
    again = F.row_number().over(Window.partitionBy("_slug").orderBy("retailer_id", "sku"))
    return named.withColumn("unique_slug", F.when(again == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", again.cast("string")))).drop("_turn", "_slug")


def merge_sellers(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (retailer_id, external_id, first_party, name) with its seller: by external id, else the retailer's own seller, else new."""
    by_id = existing.where("external_id is not null").select("retailer_id", "external_id", F.col("seller_id").alias("_by_id"))
    house = existing.where("first_party").groupBy("retailer_id").agg(F.min("seller_id").alias("_house"))
    rows = incoming.join(by_id, ["retailer_id", "external_id"], "left").join(house, "retailer_id", "left")
    found = F.coalesce("_by_id", F.when(F.col("first_party"), F.col("_house")))
    return rows.select(*incoming.columns, found.alias("seller_id"), F.when(found.isNull(), "new").when(F.col("_by_id").isNotNull(), "external_id").otherwise("first_party").alias("found_by"))


def pages(rows: DataFrame, key: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The same page of every key's rows, with its number in the order and the total before paging.

    The window keeps row numbers up to the end of the page only; totals are aggregated apart, so a hot key is no sorted group.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    shown = rows.select("*", turn.alias("row_no")).where(F.col("row_no") <= offset + limit).where(F.col("row_no") > offset)
    return shown.join(rows.groupBy(key).agg(F.count("*").alias("total")), key)


def children(categories: DataFrame) -> DataFrame:
    """categories (category_id, parent_id, name) with how many child categories each has, none included."""
    below = categories.where("parent_id is not null").groupBy(F.col("parent_id").alias("category_id")).agg(F.count("*").alias("children"))
    return categories.join(below, "category_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)

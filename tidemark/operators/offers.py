"""Current offers: latest observations, verified prices, ranking and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import PricingConfig
from tidemark.functions.money import percent2
from tidemark.functions.series import skey
from tidemark.operators.history import freshness, roll_up_freshness

PROMOTIONS = ["coupon", "payment_offer", "cashback"]
LEVELS = ["high", "medium", "low"]


def latest(points: DataFrame, *keys: str) -> DataFrame:
    """The last row of every key by max_by, which aggregates partially; null keys are keys of their own."""
    rest = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.max_by(F.struct(*rest), skey()).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def seller_score(seller_id: Column, first_party: Column, active: Column) -> Column:
    known = F.when(seller_id.isNull(), 0)
    return known.otherwise(1 + F.when(active, 1).otherwise(0) + F.when(first_party, 2).otherwise(0))


def adjustment_sums(adjustments: DataFrame) -> DataFrame:
    """Per snapshot the verified and the possible promotions, and whether any is unsafe; one row per snapshot before any join."""
    verified = (F.col("eligibility") == "verified_eligible") & F.col("amount_paise").isNotNull()
    amount = F.coalesce("amount_paise", F.lit(0))
    promos = adjustments.where(F.col("kind").isin(PROMOTIONS))
    return promos.groupBy("snapshot_id").agg(
        F.sum(F.when(verified, amount).otherwise(0)).alias("verified_off"),
        F.sum(F.when(F.col("eligibility") != "ineligible", amount).otherwise(0)).alias("possible_off"),
        F.max(verified).alias("has_verified"),
        F.max(~F.col("eligibility").isin("verified_eligible", "unavailable")).alias("unsafe"),
    )


def adjustment_columns(kind: Column, amount: Column, eligibility: Column) -> list[Column]:
    """adjustment_sums of offers with one adjustment at most, told by their own columns; all null without one."""
    told = lambda value: F.when(kind.isin(PROMOTIONS), value)
    known = F.coalesce(amount, F.lit(0))
    return [
        told(F.when((eligibility == "verified_eligible") & amount.isNotNull(), known).otherwise(0)).alias("verified_off"), told(F.when(eligibility != "ineligible", known).otherwise(0)).alias("possible_off"),
        told((eligibility == "verified_eligible") & amount.isNotNull()).alias("has_verified"), told(~eligibility.isin("verified_eligible", "unavailable")).alias("unsafe"),
    ]


def amounts_by_kind(adjustments: DataFrame) -> DataFrame:
    """Recorded amounts per snapshot and kind, null where none was recorded."""
    return adjustments.groupBy("snapshot_id").pivot("kind", PROMOTIONS).agg(F.sum("amount_paise"))


def priced(offers: DataFrame, adjustments: DataFrame, as_of: Column, c: PricingConfig = PricingConfig()) -> DataFrame:
    """Offers with discount, verified and estimated price, price kind, freshness, confidence and whether they can win.

    Missing fees are unknown, not zero: they add nothing, and a missing delivery fee costs a step of confidence.
    """
    return with_prices(offers.join(adjustment_sums(adjustments), "snapshot_id", "left"), offers.columns, as_of, c)


def with_prices(rows: DataFrame, columns: list[str], as_of: Column, c: PricingConfig = PricingConfig()) -> DataFrame:
    """The given columns of offers that have their sums of adjustments, with all that `priced` adds."""
    shown = F.col("displayed_paise")
    fees = F.coalesce("delivery_paise", F.lit(0)) + F.coalesce("platform_paise", F.lit(0))
    verified = F.greatest(shown + fees - F.coalesce("verified_off", F.lit(0)), F.lit(0))
    estimate = F.greatest(shown + fees - F.coalesce("possible_off", F.lit(0)), F.lit(0))
    touched = F.coalesce("has_verified", F.lit(False)) | F.col("delivery_paise").isNotNull() | F.col("platform_paise").isNotNull()
    status = freshness(F.col("observed_at"), as_of, c)
    steps = (
        F.when(status == "stale", 1).when(status == "missing", 2).otherwise(0)
        + shown.isNull().cast("int") + (F.col("seller_score") == 0).cast("int") + F.col("delivery_paise").isNull().cast("int") + F.coalesce("unsafe", F.lit(False)).cast("int")
    )
    start = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.least(start + steps, F.lit(2)) + 1)
    available = F.col("availability").isin("in_stock", "limited_stock")
    return rows.select(
        *columns,
        F.when((F.col("mrp_paise") > 0) & (shown < F.col("mrp_paise")), percent2(F.col("mrp_paise") - shown, F.col("mrp_paise"))).alias("discount_percent"),
        F.when(F.col("mrp_paise") > shown, F.col("mrp_paise") - shown).when(F.col("mrp_paise").isNotNull() & shown.isNotNull(), 0).cast("long").alias("mrp_off_paise"),
        verified.alias("verified_paise"), F.nullif(estimate, verified).alias("estimated_paise"),
        F.when(shown.isNotNull() & touched, "verified_effective").otherwise("displayed_only").alias("price_kind"),
        status.alias("status"), level.alias("offer_confidence"), available.alias("is_available"), (available & shown.isNotNull()).alias("can_win"),
    )


def fee_lines(offers: DataFrame) -> DataFrame:
    """The lines an offer's own columns make: MRP discount and fees; a missing fee is unavailable."""
    line = lambda kind, amount: F.struct(F.lit(kind).alias("kind"), amount.alias("amount_paise"), F.when(amount.isNull(), "unavailable").otherwise("verified_eligible").alias("eligibility"))
    off = F.when(F.col("mrp_paise").isNotNull() & F.col("displayed_paise").isNotNull(), F.greatest(F.col("mrp_paise") - F.col("displayed_paise"), F.lit(0)))
    return offers.select("snapshot_id", F.inline(F.array(line("displayed_discount", off), line("delivery_fee", F.col("delivery_paise")), line("platform_fee", F.col("platform_paise")))))


def _rank_keys() -> list[Column]:
    place = F.when(F.col("availability") == "in_stock", 0).when(F.col("availability") == "limited_stock", 1).when(F.col("availability") == "out_of_stock", 3).otherwise(2)
    return [
        F.when(F.col("can_win"), 0).otherwise(1), F.when(F.col("can_win"), F.col("verified_paise")).asc_nulls_last(), F.col("displayed_paise").asc_nulls_last(),
        place, F.col("seller_score").desc(), F.col("delivery_paise").asc_nulls_last(), F.col("retailer_slug"), F.col("offer_id"),
    ]


def ranked(offers: DataFrame, key: str = "product_id") -> DataFrame:
    """Offers of a variant in their order: a total order of nine keys, so ranks are stable."""
    return offers.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*_rank_keys())))


def lowest_verified(offers: DataFrame, key: str = "product_id") -> DataFrame:
    """Per variant the winner, the runner-up's price and the criterion that decided, or why nobody can win.

    All of it is told along the ranks and over the variant, so ranked offers aren't moved or read a second time.
    """
    order, whole = Window.partitionBy(key).orderBy("rank"), Window.partitionBy(key)
    follows = lambda c: F.lead(F.when(F.col("can_win"), F.col(c))).over(order)
    rows = offers.select(
        "*", F.lead(F.col("can_win")).over(order).alias("_next"), *(follows(c).alias(f"_{c}") for c in ("verified_paise", "displayed_paise", "availability", "seller_score")),
        F.max("is_available").over(whole).alias("_any"), F.count("*").over(whole).alias("offers"),
    )
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rule = (
        F.when(~F.coalesce("_next", F.lit(False)), F.when(F.col("price_kind") == "verified_effective", "verified_effective_price").otherwise("displayed_price"))
        .when(differs("verified_paise"), "verified_effective_price").when(differs("displayed_paise"), "displayed_price").when(differs("availability"), "availability")
        .when(differs("seller_score"), "seller_quality").otherwise("delivery")
    )
    first = rows.where("rank = 1")
    reason = F.when(F.col("can_win"), F.lit(None)).otherwise(F.when(F.col("_any"), "no_verified_price").otherwise("none_available"))
    won = lambda c: F.when(F.col("can_win"), F.col(c))
    return first.select(key, won("offer_id").alias("offer_id"), won("retailer_slug").alias("retailer_slug"), won("verified_paise").alias("verified_paise"), F.when(F.col("can_win"), F.col("_verified_paise")).alias("runner_up_paise"), F.when(F.col("can_win"), rule).otherwise("no_applicable_offer").alias("criterion"), reason.alias("reason"), "offers")


def with_missing(listings: DataFrame, offers: DataFrame, keys: list[str]) -> DataFrame:
    """Every listing with its offers; listings that were never observed stay, with nulls."""
    return listings.join(offers, keys, "left")


def cards(offers: DataFrame, winners: DataFrame, key: str = "product_id") -> DataFrame:
    """A card per variant: retailers, price span, best availability, last update, and the winner."""
    best = F.min(F.when(F.col("availability") == "in_stock", 0).when(F.col("availability") == "limited_stock", 1).when(F.col("availability") == "out_of_stock", 3).otherwise(2))
    names = F.array(*map(F.lit, ["in_stock", "limited_stock", "unknown", "out_of_stock"]))
    made = offers.groupBy(key).agg(F.count_distinct("retailer_slug").alias("retailers"), F.min("displayed_paise").alias("min_paise"), F.max("displayed_paise").alias("max_paise"), F.element_at(names, best + 1).alias("availability"), F.max("observed_at").alias("updated_at"))
    return made.join(winners.select(key, "offer_id", "verified_paise"), key, "left")


def product_freshness(offers: DataFrame, keys: list[str]) -> DataFrame:
    return roll_up_freshness(offers, keys)

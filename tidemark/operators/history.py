"""Price history per variant: one pass of conditional aggregates and one lag window, never a pass per metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import PricingConfig
from tidemark.functions.money import mean, percent4
from tidemark.functions.series import SKEY, along, days_between, price, qualifies, skey
from tidemark.operators.catalog import pages


def qualifying(points: DataFrame) -> DataFrame:
    """Rows of high or medium confidence with their analysis price."""
    return points.where(qualifies()).withColumn("price", price())


def quality_counts(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.count_if(qualifies()).alias("qualifying"), F.count_if(~qualifies()).alias("excluded"))


def _in_window(as_of: Column, days: int) -> Column:
    return (F.col("observed_at") <= as_of) & (F.col("observed_at") >= as_of - F.make_dt_interval(F.lit(days)))


def average_columns(as_of: Column, c: PricingConfig) -> list[Column]:
    """Per window the HALF_UP average and its count; both bounds belong to it."""
    out = []
    for d in c.window_days:
        inside = _in_window(as_of, d)
        n = F.count_if(inside)
        out += [mean(F.sum(F.when(inside, F.col("price"))), n).alias(f"avg_{d}d"), n.alias(f"n_{d}d")]
    return out


def window_averages(points: DataFrame, as_of: Column, c: PricingConfig = PricingConfig(), keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Averages of the windows that end at as_of, with a reason where a window is empty."""
    rows = qualifying(points).groupBy(*keys).agg(*average_columns(as_of, c))
    reason = [F.when(F.col(f"n_{d}d") == 0, "no_observations_in_window").alias(f"reason_{d}d") for d in c.window_days]
    return rows.select("*", *reason)


def rolling_averages(points: DataFrame, c: PricingConfig = PricingConfig(), key: str = "product_id") -> DataFrame:
    """The window averages as of every observation: a range frame over microseconds per window, one sort for all."""
    rows = qualifying(points).withColumn("_at", F.unix_micros("observed_at"))
    out = []
    for d in c.window_days:
        frame = Window.partitionBy(key).orderBy("_at").rangeBetween(-d * 86_400_000_000, 0)
        out.append(mean(F.sum("price").over(frame), F.count("price").over(frame)).alias(f"avg_{d}d"))
    return rows.select("snapshot_id", key, "observed_at", "price", *out)


def extrema(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Lowest and highest price with the rows that gave them; ties go to the earliest row."""
    return qualifying(points).groupBy(key).agg(*extrema_columns()).select(key, *_extrema_fields())


def extrema_columns() -> list[Column]:
    row = F.struct("price", *SKEY)
    return [F.min_by(row, F.struct(F.col("price"), skey())).alias("_low"), F.min_by(row, F.struct(-F.col("price"), skey())).alias("_high")]


def _extrema_fields() -> list[Column]:
    return [F.col(f"_{x}.{f}").alias(f"{x}_{n}") for x in ("low", "high") for f, n in (("price", "paise"), ("snapshot_id", "snapshot_id"), ("observed_at", "at"))]


def changes(points: DataFrame, *keys: str) -> DataFrame:
    """Every qualifying row with the previous one of its series: percent change, drop flag and reason."""
    before = F.lag(F.struct("price", "snapshot_id", "observed_at")).over(along(*keys))
    rows = qualifying(points).withColumn("_before", before)
    base = F.col("_before.price")
    reason = F.when(F.col("_before").isNull(), "no_comparison_baseline").when(base == 0, "zero_baseline_price")
    return rows.select("*", base.alias("baseline_paise"), F.col("_before.snapshot_id").alias("baseline_snapshot_id"), percent4(F.col("price") - base, base).alias("change_percent"), (F.col("price") < base).alias("is_drop"), reason.alias("change_reason")).drop("_before")


SERIES = ("product_id", "listing_id", "seller_id")


def drop_feed(points: DataFrame) -> DataFrame:
    """All price drops: rows strictly below the previous observation of the same listing and seller."""
    return changes(points, *SERIES).where("is_drop").select("snapshot_id", *SERIES, "observed_at", "price", "baseline_paise", "baseline_snapshot_id", "change_percent")


def variant_history(points: DataFrame, as_of: Column, c: PricingConfig = PricingConfig()) -> DataFrame:
    """The full history record of every variant.

    Rows are combined per variant and price, then per variant: everything but the change of the latest row comes from sums, counts and
    extrema, so a hot variant only meets in partial aggregates. The share of rows at or below the current price comes from the
    counts of its distinct prices. Only the previous row of a series needs a window.
    """
    row = F.struct("price", *SKEY)
    latest = F.struct("price", "displayed_paise", "effective_paise", "baseline_paise", "change_percent", "is_drop", "change_reason", "retailer_id", "listing_id", "seller_id", *SKEY)
    x = days_between(F.col("observed_at"), as_of)
    per_price = changes(points, *SERIES).groupBy("product_id", "price").agg(
        F.count("*").alias("n"), *(F.count_if(_in_window(as_of, d)).alias(f"n_{d}d") for d in c.window_days), F.max_by(latest, skey()).alias("_last"), F.min_by(row, skey()).alias("_first"),
        F.sum(x).alias("_sx"), F.sum(x * x).alias("_sxx"), F.max(x).alias("_mx"),
    )
    p, order = F.col("price"), lambda s: F.struct(*(F.col(f"{s}.{k}") for k in SKEY))
    counted = lambda d: F.sum(F.col(f"n_{d}d"))
    summed = per_price.groupBy("product_id").agg(
        F.sum("n").alias("qualifying"), *(y for d in c.window_days for y in (mean(F.sum(p * F.col(f"n_{d}d")), counted(d)).alias(f"avg_{d}d"), counted(d).alias(f"n_{d}d"))),
        F.max_by("_last", order("_last")).alias("_last"), F.min_by("_first", order("_first")).alias("_first"), F.min_by("_first", F.struct(p, order("_first"))).alias("_low"), F.min_by("_first", F.struct(-p, order("_first"))).alias("_high"),
        F.sum(p * F.col("n")).alias("_sy"), F.sum(p * p * F.col("n")).alias("_syy"), F.sum("_sx").alias("_sx"), F.sum(p * F.col("_sx")).alias("_sxy"), F.sum("_sxx").alias("_sxx"), F.max("_mx").alias("_mx"),
        F.collect_list(F.struct("price", "n")).alias("_prices"),
    )
    start, many = days_between(F.col("_first.observed_at"), as_of), F.col("qualifying")
    below = F.aggregate(F.filter("_prices", lambda q: q["price"] <= F.col("_last.price")), F.lit(0).cast("long"), lambda total, q: total + q["n"])
    grouped = summed.select("*", below.alias("_below"), (F.col("_mx") - start).alias("_span"), start.alias("_start")).withColumns({
        "_sxx": F.col("_sxx") - 2 * F.col("_start") * F.col("_sx") + many * F.col("_start") * F.col("_start"), "_sxy": F.col("_sxy") - F.col("_start") * F.col("_sy"), "_sx": F.col("_sx") - many * F.col("_start"),
    })
    n = F.col("qualifying")
    enough = n >= c.min_count
    spread = (n * F.col("_syy") - F.col("_sy") * F.col("_sy")).cast("double") / (n * (n - 1)).cast("double")
    stdev = F.round(F.sqrt(spread) / 100, 2)
    denom = n * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = (n * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / F.when(F.col("_span") > 0, denom)
    implied = F.round(slope * F.col("_span") / F.when(F.col("_first.price") != 0, F.col("_first.price")) * 100, 4)
    values = grouped.select(
        "product_id", "qualifying", *(f"{p}_{d}d" for d in c.window_days for p in ("avg", "n")), *_extrema_fields(),
        F.col("_last.price").alias("current_paise"), F.col("_last.snapshot_id").alias("current_snapshot_id"), F.col("_last.observed_at").alias("current_at"),
        F.col("_last.retailer_id").alias("retailer_id"), F.col("_last.listing_id").alias("listing_id"), F.col("_last.seller_id").alias("seller_id"),
        F.when(enough, percent4(F.col("_below"), n)).alias("percentile"),
        F.when(enough, stdev).alias("volatility"), F.when(enough, F.round(stdev / (F.col("_sy") / n / 100), 4)).alias("variation"),
        F.col("_last.baseline_paise").alias("baseline_paise"), F.col("_last.change_percent").alias("change_percent"), F.col("_last.is_drop").alias("is_drop"), F.col("_last.change_reason").alias("change_reason"),
        F.when(enough, implied).alias("trend_percent"),
        F.when(~enough, "below_minimum_observation_count").when(F.col("_span") == 0, "zero_time_span").when(F.col("_first.price") == 0, "zero_baseline_price").alias("trend_reason"),
    )
    direction = F.when(F.col("trend_percent").isNull(), "insufficient_history").when(F.abs("trend_percent") <= c.stable_percent, "stable").when(F.col("trend_percent") > 0, "rising").otherwise("falling")
    return values.withColumn("trend", direction)


def freshness(observed_at: Column, as_of: Column, c: PricingConfig = PricingConfig()) -> Column:
    """fresh, aging or stale by age, missing for null; the future is fresh."""
    age = F.unix_micros(as_of) - F.unix_micros(observed_at)
    hour = 3_600_000_000
    return F.when(observed_at.isNull(), "missing").when(age <= c.fresh_hours * hour, "fresh").when(age <= c.aging_hours * hour, "aging").otherwise("stale")


def roll_up_freshness(rows: DataFrame, keys: list[str], status: str = "status", at: str = "observed_at") -> DataFrame:
    """Worst status per key with the oldest and newest time: missing only if nothing was observed, stale if anything is stale or partly missing."""
    n, missing, stale, aging = F.count("*"), *(F.count_if(F.col(status) == x) for x in ("missing", "stale", "aging"))
    worst = F.when(missing == n, "missing").when((stale > 0) | (missing > 0), "stale").when(aging > 0, "aging").otherwise("fresh")
    return rows.groupBy(*keys).agg(worst.alias("status"), F.min(at).alias("oldest_at"), F.max(at).alias("newest_at"), stale.alias("stale"), missing.alias("missing"), n.alias("offers"))


def variant_freshness(points: DataFrame, variants: DataFrame, as_of: Column) -> DataFrame:
    """Freshness of every variant by its newest row of any confidence; a variant without rows is one missing observation."""
    newest = points.groupBy("product_id").agg(F.max("observed_at").alias("observed_at"), F.count("*").alias("observations"))
    return variants.select("product_id").join(newest, "product_id", "left").select("product_id", "observed_at", F.coalesce("observations", F.lit(0)).alias("observations"), freshness(F.col("observed_at"), as_of).alias("status"))


def page(points: DataFrame, since: Column, until: Column, offset: int, limit: int, key: str = "product_id") -> DataFrame:
    """A page of observations per variant between inclusive bounds, with the total before paging; a hot variant is no sorted group."""
    inside = points.where((F.col("observed_at") >= since) & (F.col("observed_at") <= until)).select(key, *SKEY)
    return pages(inside, key, [F.col(x) for x in SKEY], offset, limit).select(key, "snapshot_id", "observed_at", "row_no", "total")


def history_of(points: DataFrame, since: Column | None = None, until: Column | None = None, limit: int | None = None, **ids) -> DataFrame:
    """The rows with given ids (a product, a listing, a retailer), oldest first, between inclusive bounds; with a limit the oldest ones."""
    for name, value in ids.items():
        points = points.where(F.col(name) == value)
    points = points if since is None else points.where(F.col("observed_at") >= since)
    points = points if until is None else points.where(F.col("observed_at") <= until)
    rows = points.orderBy(*SKEY)
    return rows if limit is None else rows.limit(limit)


def newest_age(points: DataFrame, as_of: Column, key: str = "retailer_id") -> DataFrame:
    return points.groupBy(key).agg(F.max("observed_at").alias("newest_at")).select(key, "newest_at", F.floor((F.unix_micros(as_of) - F.unix_micros("newest_at")) / 1_000_000).alias("age_seconds"))


def carry_prices(feed: DataFrame, points: DataFrame, key: str = "listing_id") -> DataFrame:
    """As-of join: an availability feed (key, fed_at, availability) takes the latest known price of its listing; without one a row goes.

    Both sides are one union, and the last known price is carried along the key's order: one shuffle by key, no range join.
    """
    known = points.select(key, F.col("observed_at").alias("fed_at"), F.lit(0).alias("side"), *SKEY, F.lit(None).cast("string").alias("availability"), "displayed_paise", "mrp_paise")
    asked = feed.select(key, "fed_at", F.lit(1).alias("side"), F.col("fed_at").alias("observed_at"), F.col("fed_at").alias("created_at"), F.lit("").alias("snapshot_id"), "availability", F.lit(None).cast("long").alias("displayed_paise"), F.lit(None).cast("long").alias("mrp_paise"))
    before = Window.partitionBy(key).orderBy("fed_at", "side", *SKEY).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("side") == 0, F.struct("displayed_paise", "mrp_paise", "snapshot_id", "observed_at")), ignorenulls=True).over(before)
    rows = known.unionByName(asked).withColumn("_known", carried).where("side = 1 and _known is not null")
    return rows.select(key, "fed_at", "availability", F.col("_known.displayed_paise").alias("displayed_paise"), F.col("_known.mrp_paise").alias("mrp_paise"), F.col("_known.snapshot_id").alias("from_snapshot_id"), F.col("_known.observed_at").alias("from_at"))



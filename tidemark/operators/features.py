"""Leakage-safe features and labels: one example per series (listing and seller) and sale event, seeing only what was known before the event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import ModelConfig
from tidemark.functions.money import mean, whole
from tidemark.functions.series import SKEY, days_between, price, qualifies
from tidemark.operators.history import qualifying
from tidemark.operators.sales import SCOPES, beside_events, in_events, scope_mask
from tidemark.sources.scratch import dealt, stored

#: Names of the features.
NUMERIC = ["current_price", "avg_7d", "avg_30d", "avg_90d", "historical_low", "historical_high", "price_volatility", "previous_sale_price", "previous_sale_low", "previous_sale_count", "mrp", "days_until_sale", "month", "day_of_week", "day_of_year", "is_weekend"]
CATEGORICAL = ["retailer_id", "seller_id", "brand_id", "category_id", "sale_event_id", "sale_event_type"]
SERIES = ["listing_id", "seller_id"]
EXAMPLE = ["listing_id", "seller_id", "event_id"]
INFERRED = "observed_price_inference"
#: What rows of a series are grouped by. A listing is of one product, so rows that lie dealt by product needn't be moved for it.
WITHIN = ["product_id", "_series"]
#: What the newest row of a series tells.
FIELDS = ["product_id", "listing_id", "price", "mrp_paise", "retailer_id", "seller_id", "brand", "category"]


def known_before(at: Column) -> Column:
    """A row may be used at a time if it was observed and recorded strictly before it."""
    return (F.col("observed_at") < at) & (F.col("created_at") < at)


def schedule_known(at: Column) -> Column:
    """Inferred events are known once they have ended, published ones always."""
    return F.when(F.col("source") == INFERRED, F.col("end_at") < at).otherwise(F.col("source").isNotNull())


def series(listing: str = "listing_id", seller: str = "seller_id") -> Column:
    """A series as one value; no seller is a seller of its own."""
    return F.concat_ws("|", F.col(listing).cast("string"), F.coalesce(F.col(seller).cast("string"), F.lit("none")))


def labels(points: DataFrame, events: DataFrame) -> DataFrame:
    """(product_id, listing_id, seller_id, event_id, as_of, target_paise2, target_n): twice the median in-event price of every series.

    Only of series with a row that was observed and recorded before the event began: without one there is no example.
    """
    known = F.min(F.greatest("observed_at", "created_at")).over(Window.partitionBy(*WITHIN))
    rows = qualifying(points).select(series().alias("_series"), "product_id", *SERIES, "retailer_id", "brand", "category", "price", "observed_at", "created_at")
    rows = rows.select(*WITHIN, *SERIES, "retailer_id", "brand", "category", "price", "observed_at", known.alias("_known_at"))
    inside = in_events(rows, events).where("_known_at < start_at").groupBy(*WITHIN, *EXAMPLE)
    return inside.agg((F.percentile("price", F.lit(0.5)) * 2).cast("long").alias("target_paise2"), F.count("*").alias("target_n"), F.first("start_at").alias("as_of")).drop("_series")


def asked(points: DataFrame, at: Column) -> DataFrame:
    """An example per series without an event or a target, at one time: what is scored."""
    rows = qualifying(points).select("product_id", *SERIES).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("product_id", *SERIES, none("string").alias("event_id"), at.alias("as_of"), none("long").alias("target_paise2"), none("long").alias("target_n"))


WINDOWS = (7, 30, 90)
DAY_US = 86_400_000_000


def sale_states(rows: DataFrame, events: DataFrame) -> DataFrame:
    """(product_id, _series, at, sale): what a sale of a series looked like after each of its rows, from the time when the sale was over and the row known."""
    sold = in_events(rows.select(*WITHIN, "retailer_id", "brand", "category", "price", "observed_at", "created_at", "snapshot_id"), events)
    known = sold.where(F.col("observed_at").isNotNull() & F.col("created_at").isNotNull()).select(*WITHIN, "event_id", "start_at", "price", "snapshot_id", F.unix_micros(F.greatest("observed_at", "created_at", "end_at")).alias("at"))
    upto = Window.partitionBy(*WITHIN, "event_id").orderBy("at", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    sale = F.struct("start_at", "event_id", F.count("*").over(upto).alias("n"), F.sum("price").over(upto).alias("paise"), F.min("price").over(upto).alias("lowest"))
    return known.select(*WITHIN, "at", sale.alias("sale"))


def sweep(rows: DataFrame, sales: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with what its series showed before each time: the newest row (now), extrema, sums, sums of the last 7, 30 and 90 days, the last sale and the number of sales.

    A row counts once it was observed and recorded, so it enters the order of time at the later of both. It leaves a window of d days when d days
    have passed since it was observed; a row recorded later than that was never in it. So sums of d days are two running sums, one up to the
    time and one up to d days before it, over one sorted series: an example doesn't meet its rows. A row whose two times differ takes two places.
    """
    seen, known = F.unix_micros("observed_at"), F.unix_micros(F.greatest("observed_at", "created_at"))
    timely = [(known - seen < d * DAY_US).alias(f"timely_{d}") for d in WINDOWS]
    now, at = F.struct(*SKEY, *FIELDS), F.explode(F.when(known == seen, F.array(seen)).otherwise(F.array(seen, known))).alias("at")
    steps = rows.where(F.col("observed_at").isNotNull() & F.col("created_at").isNotNull()).select(*WITHIN, "price", now.alias("row"), *timely, seen.alias("seen"), known.alias("known"), at)
    steps = steps.select(*WITHIN, "at", F.when(F.col("at") == F.col("known"), F.col("row")).alias("row"), F.when(F.col("at") == F.col("seen"), F.col("price")).alias("leaving"), *(f"timely_{d}" for d in WINDOWS))
    asked = wanted.select("*", F.unix_micros("as_of").alias("at"), F.lit(True).alias("asked"))
    every = steps.unionByName(sales, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    until = lambda d: Window.partitionBy(*WITHIN).orderBy("at").rangeBetween(Window.unboundedPreceding, -d * DAY_US - 1)
    before, price, leaving = until(0), F.col("row.price"), F.col("leaving")
    total = lambda value, window: F.coalesce(F.sum(value).over(window), F.lit(0))
    within = lambda d, entered, left: total(F.when(F.col(f"timely_{d}"), entered), before) - total(F.when(F.col(f"timely_{d}"), left), until(d))
    one = lambda c: F.when(c.isNotNull(), F.lit(1))
    swept = every.select(
        "*", total(one(price), before).alias("seen_n"), total(price, before).alias("seen_paise"), total(price * price, before).alias("seen_squares"), F.max("row").over(before).alias("now"),
        F.min(price).over(before).alias("low"), F.max(price).over(before).alias("high"),
        *(y for d in WINDOWS for y in (within(d, one(price), one(leaving)).alias(f"n_{d}"), within(d, price, leaving).alias(f"paise_{d}"))),
        F.max("sale").over(before).alias("last"), total((F.col("sale.n") == 1).cast("int"), before).alias("sales"),
    )
    return swept.where("asked and seen_n > 0")


def totals(points: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """What sweep gives, for every series of the points at one time: plain sums, as there is no order of times to follow.

    A series without a row known before that time has no newest row (now); of every series there are its ids, too.
    """
    rows = points.select(series().alias("_series"), *SERIES, *SKEY, "product_id", "retailer_id", "brand", "category", "mrp_paise", price().alias("price"), F.coalesce(qualifies() & known_before(at), F.lit(False)).alias("_known"))
    value = F.when(F.col("_known"), F.col("price"))
    recent = lambda d: F.when(F.col("observed_at") >= at - F.make_dt_interval(F.lit(d)), value)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    placed = beside_events(rows, events.where(F.col("end_at") < at)).groupBy(*WITHIN, "start_at", "event_id").agg(
        F.min("listing_id").alias("_listing"), F.min("seller_id").alias("_seller"), F.min("retailer_id").alias("_retailer"),
        F.count(value).alias("n"), total(value).alias("paise"), total(value * value).alias("squares"), F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.when(F.col("_known"), F.struct(*SKEY, *FIELDS))).alias("now"),
        *(y for d in WINDOWS for y in (F.count(recent(d)).alias(f"n_{d}"), total(recent(d)).alias(f"paise_{d}"))),
    )
    rows_, sale = F.col("event_id").isNull(), F.col("event_id").isNotNull() & (F.col("n") > 0)
    own = lambda c: F.max(F.when(rows_, F.col(c)))
    names = {"n": "seen_n", "paise": "seen_paise", "squares": "seen_squares", **{c: c for c in ("_listing", "_seller", "_retailer", "low", "high", "now", *(f"{x}_{d}" for d in WINDOWS for x in ("n", "paise")))}}
    last = F.max(F.when(sale, F.struct("start_at", "event_id", "n", "paise", F.col("low").alias("lowest"))))
    return placed.groupBy(*WITHIN).agg(*(own(c).alias(name) for c, name in names.items()), last.alias("last"), F.count_if(sale).alias("sales"))


def exampled(points: DataFrame, events: DataFrame) -> DataFrame:
    """The qualifying points of series that have a labelled example: a row inside an event, and one that was known before that began.

    The earliest row known and the latest event met are carried over each series where its rows lie; a join with the labels would move them all.
    """
    whole = Window.partitionBy(*WITHIN)
    rows = points.where(qualifies()).withColumn("_series", series())
    has = F.min(F.greatest("observed_at", "created_at")).over(whole) < F.max("start_at").over(whole)
    return beside_events(rows, events).withColumn("_has", has).where("_has and event_id is null").select(*points.columns)


def feature_table(points: DataFrame, events: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The examples (labelled ones, if none are given) with 16 numeric and 6 categorical features and their completeness.

    Every series is swept once in the order of time, see `sweep`. An example without a row known before its time has no features and gives no
    row. An example without an event takes the nearest published one. Examples that are given are looked at several times, so they should be
    stored. Of the labelled ones' series the rows are stored first, as few series have any.
    """
    labelled = wanted is None
    if labelled:
        points = dealt(exampled(points, events), "product_id")
        wanted = dealt(labels(points, events), "product_id")
    wanted = wanted.select(series().alias("_series"), "product_id", F.col("event_id").alias("_event"), "as_of", "target_paise2", "target_n")
    rows = qualifying(points).select(series().alias("_series"), *SERIES, "product_id", "retailer_id", "brand", "category", "price", "mrp_paise", "observed_at", "created_at", "snapshot_id")
    rows = rows if labelled else rows.join(wanted, WITHIN, "left_semi")
    swept = sweep(rows, sale_states(rows, events), wanted)
    own = events.select(F.col("event_id").alias("_event"), "event_type", "source", "start_at", "end_at")
    return _featured(swept.join(own, "_event", "left"), nearest(wanted.select("as_of").distinct(), events))


def features_at(points: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """The features of every series of the points at one time, without event or target, and its ids and number of known rows (_product, _listing, _seller, _retailer, seen_n)."""
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {"_event": "string", "target_paise2": "long", "target_n": "long", "event_type": "string", "source": "string", "start_at": "timestamp", "end_at": "timestamp"}
    series_ = totals(points, events, at).select("*", F.col("product_id").alias("_product"), at.alias("as_of"), *(none(kind).alias(c) for c, kind in kinds.items()))
    return _featured(series_, nearest(points.sparkSession.range(1).select(at.alias("as_of")), events), "_product", "_listing", "_seller", "_retailer", "seen_n")


def _featured(known: DataFrame, near: tuple[DataFrame, list[int]], *more: str) -> DataFrame:
    """The features of what sweep or totals give, with the columns of their own event and the nearest ones of their times."""
    T = F.col("as_of")
    n, sy, syy = F.col("seen_n"), F.col("seen_paise"), F.col("seen_squares")
    spread = F.when(n > 1, (n * syy - sy * sy).cast("double") / F.nullif(n * (n - 1), F.lit(0)).cast("double"))
    base = known.select(
        "_event", "as_of", "target_paise2", "target_n", "now", *(mean(F.col(f"paise_{d}"), F.col(f"n_{d}")).alias(f"a{d}") for d in WINDOWS), "low", "high", F.round(F.sqrt(spread) / 100, 2).alias("volatility"),
        F.struct(mean(F.col("last.paise"), F.col("last.n")).alias("average"), F.col("last.lowest").alias("lowest")).alias("last"), "sales", "event_type", "source", "start_at", "end_at", *more,
    )
    target_known = F.coalesce(schedule_known(T), F.lit(False))
    full = _with_nearest(base, *near)
    pick = lambda own, other: F.when(target_known, own).otherwise(F.col(other))
    rupees = lambda c: F.col(c) / 100.0
    starts = pick(F.col("start_at"), "near_start")
    featured = full.select(
        F.col("now.product_id").alias("product_id"), F.col("now.listing_id").alias("listing_id"), F.col("_event").alias("event_id"), "as_of", "target_paise2", "target_n",
        (F.col("now.price") / 100.0).alias("current_price"), rupees("a7").alias("avg_7d"), rupees("a30").alias("avg_30d"), rupees("a90").alias("avg_90d"),
        rupees("low").alias("historical_low"), rupees("high").alias("historical_high"), F.col("volatility").alias("price_volatility"),
        (F.col("last.average") / 100.0).alias("previous_sale_price"), (F.col("last.lowest") / 100.0).alias("previous_sale_low"), F.col("sales").cast("double").alias("previous_sale_count"),
        (F.col("now.mrp_paise") / 100.0).alias("mrp"), F.greatest(F.lit(0.0), days_between(starts, T)).alias("days_until_sale"),
        F.month(T).cast("double").alias("month"), F.weekday(T).cast("double").alias("day_of_week"), F.dayofyear(T).cast("double").alias("day_of_year"), F.when(F.weekday(T) >= 5, 1.0).otherwise(0.0).alias("is_weekend"),
        F.col("now.retailer_id").cast("string").alias("retailer_id"), F.col("now.seller_id").cast("string").alias("seller_id"), F.col("now.brand").alias("brand_id"), F.col("now.category").alias("category_id"),
        pick(F.col("_event"), "near_id").alias("sale_event_id"), pick(F.col("event_type"), "near_type").alias("sale_event_type"), *more,
    )
    present = sum((F.col(c).isNotNull().cast("int") for c in NUMERIC + CATEGORICAL), F.lit(0))
    return featured.withColumn("completeness", F.round(present / float(len(NUMERIC + CATEGORICAL)), 6))


def nearest(times: DataFrame, events: DataFrame) -> tuple[DataFrame, list[int]]:
    """Per time (as_of) and scope of events the published event that begins first of those that have not ended (near), and which scope columns events bind, as bits.

    Times and scopes of events are few next to what is asked. They are stored, so that Spark knows how few.
    """
    published = events.where(F.col("source") != INFERRED).withColumn("_mask", scope_mask(SCOPES))
    masks = sorted(r[0] for r in published.select("_mask").distinct().collect())  # at most eight
    side = published.select("_mask", *SCOPES, "end_at", F.struct("start_at", "event_id", "event_type").alias("near"))
    return stored(times.join(side, side["end_at"] >= times["as_of"]).groupBy("as_of", "_mask", *SCOPES).agg(F.min("near").alias("near"))), masks


def _with_nearest(examples: DataFrame, near: DataFrame, masks: list[int]) -> DataFrame:
    """examples with the nearest published event that applies to them (near_id, near_type, near_start): the first of those of its scopes, each looked up by what it binds."""
    placed = examples
    for m in masks:
        bound = [c for i, c in enumerate(SCOPES) if m >> i & 1]
        own = near.where(F.col("_mask") == m).select(F.col("as_of").alias("_at"), *(F.col(c).alias(f"_{c}") for c in bound), F.col("near").alias(f"_near_{m}"))
        same = reduce(Column.__and__, (F.col(f"now.{c}") == F.col(f"_{c}") for c in bound), F.col("as_of") == F.col("_at"))
        placed = placed.join(own, same, "left").select(*placed.columns, f"_near_{m}")
    kind = "struct<start_at:timestamp,event_id:string,event_type:string>"
    first = F.array_min(F.array(F.lit(None).cast(kind), *(F.col(f"_near_{m}").cast(kind) for m in masks)))
    return placed.withColumn("near", first).select(*examples.columns, F.col("near.event_id").alias("near_id"), F.col("near.event_type").alias("near_type"), F.col("near.start_at").alias("near_start"))


def chronological_split(examples: DataFrame, c: ModelConfig = ModelConfig()) -> DataFrame:
    """examples with their split, by distinct times: the times are few, so only they are ordered in one place."""
    times = examples.select("as_of").distinct().select("as_of", F.row_number().over(Window.orderBy("as_of")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    n = F.col("n")
    train = F.greatest(F.lit(1), F.floor(n * c.train_fraction))
    until = F.greatest(train + 1, F.floor(n * (c.train_fraction + c.validation_fraction)))
    until = F.when(until >= n, n - 1).otherwise(until)
    train = F.when(train >= until, F.greatest(F.lit(1), until - 1)).otherwise(train)
    named = times.select("as_of", F.when(F.col("i") <= train, "train").when(F.col("i") <= until, "validation").otherwise("test").alias("split"))
    return examples.join(named, "as_of")


def split_summary(split: DataFrame, c: ModelConfig = ModelConfig()) -> DataFrame:
    least = F.when(F.col("split") == "train", c.min_train).when(F.col("split") == "validation", c.min_validation).otherwise(c.min_test)
    made = split.groupBy("split").agg(F.count("*").alias("examples"), F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"))
    return made.withColumn("status", F.when(F.col("examples") < least, "insufficient_data").otherwise("ok"))


def fit_encoder(train: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """(feature, value, code): codes by first appearance in the order of (as_of, event, listing, seller), each feature on its own."""
    order = F.struct("as_of", "event_id", "listing_id", F.coalesce("seller_id", F.lit("none")))
    rows = train.select(order.alias("at_row"), F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns)))).where("value is not null")
    first = rows.groupBy("feature", "value").agg(F.min("at_row").alias("at_row"))
    return first.select("feature", "value", (F.row_number().over(Window.partitionBy("feature").orderBy("at_row", "value")) - 1).alias("code"))


def encode(examples: DataFrame, codes: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """examples with cat_<column> codes; values that train never saw are missing."""
    for c in columns:
        own = codes.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("code").cast("double").alias(f"cat_{c}"))
        examples = examples.join(own, c, "left")
    return examples


def leakage(examples: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(feature, compared, leaks): a numeric feature that equals the target everywhere leaks it."""
    target = F.col("target_paise2") / 200.0
    rows = examples.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(F.col(c) - target).alias("gap")) for c in NUMERIC))))
    return rows.groupBy("feature").agg(F.count("gap").alias("compared"), F.coalesce(F.bool_and(F.col("gap") <= tolerance), F.lit(False)).alias("leaks"))


def median_paise(doubled: Column) -> Column:
    return whole(doubled, F.lit(2))

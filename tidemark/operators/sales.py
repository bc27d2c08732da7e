"""Sale events: applicability, in-event statistics, and detection of sale windows from price drops."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import SalesConfig
from tidemark.functions.money import half_up, mean, percent4
from tidemark.functions.series import SKEY, along
from tidemark.operators.history import qualifying
from tidemark.sources.scratch import stored

DAY_US = 86_400_000_000


#: What a price history needs of a row.
ROW = [*SKEY, "confidence", "displayed_paise", "effective_paise"]


def event_status(at: Column) -> Column:
    return F.when(at < F.col("start_at"), "before_event").when(at > F.col("end_at"), "after_event").otherwise("during_event")


def upcoming(events: DataFrame, at: Column) -> DataFrame:
    return events.where(F.col("start_at") > at).orderBy("start_at", "event_id")


def listed(events: DataFrame, at: Column, sources: list[str], status: str, offset: int, limit: int) -> DataFrame:
    """A page of events by source and status, with the total before paging; events are few, the page is small."""
    rows = events.where(F.col("source").isin(sources)).withColumn("status", event_status(at)).where(F.col("status") == status)
    counted = rows.select("*", F.count("*").over(Window.partitionBy("status")).alias("total"))
    return counted.orderBy("start_at", "event_id").offset(offset).limit(limit)


SCOPES = ["retailer_id", "brand", "category"]


def scope_mask(columns: list[str]) -> Column:
    """Which of the scope columns an event binds, as bits."""
    return sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0))


def _scope_key(mask: Column, columns: list[str]) -> Column:
    """One number for the values of the scope columns that a mask binds; equal keys are checked against the columns after the join."""
    return F.xxhash64(mask, *(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.col(c).cast("string")) for i, c in enumerate(columns)))


def scoped(rows: DataFrame, events: DataFrame, itself: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """rows (with `_mask`, the columns bound, as bits) and events with `_scope`, a key to join them on, and the scope columns in question: those that rows have.

    A row is repeated for each combination of scope columns that any event binds (at most eight, looked up), so that a
    calendar of all kinds of events takes one pass over the rows and one join on equal keys. With `itself` every row is there once more,
    with the mask -1, which no event has.
    """
    columns = [c for c in SCOPES if c in rows.columns]
    masks = sorted(r[0] for r in events.select(scope_mask(columns)).distinct().collect()) or [0]
    keyed = rows.select("*", F.explode(F.array(*map(F.lit, [-1, *masks] if itself else masks))).alias("_mask")).select("*", _scope_key(F.col("_mask"), columns).alias("_scope"))
    return keyed, events.select("*", _scope_key(scope_mask(columns), columns).alias("_scope")), columns


def fits(columns: list[str], prefix: str = "_") -> Column:
    """An event, with its scope in prefixed columns, applies to a row: null scopes are wildcards."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(f"{prefix}{c}").isNull() | (F.col(f"{prefix}{c}") == F.col(c)))
    return out


def event_products(products: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, product columns) of all events that can apply to a product; a null scope is a wildcard, and so is a scope that products don't have."""
    rows, sides, columns = scoped(products, events)
    side = sides.select("event_id", "_scope", *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(side, "_scope").where(fits(columns)).select("event_id", *products.columns)


def in_events(points: DataFrame, events: DataFrame) -> DataFrame:
    """(event columns, point columns) of every observation inside an event that applies to it; both bounds belong to the event.

    Each event is spread over its days, so the interval join is an equal join on day and scope, with the exact bounds checked after it.
    """
    rows, side, inside = _by_day(points, events)
    return rows.join(side, ["_scope", "_day"]).where(inside).select("event_id", "start_at", "end_at", *points.columns)


def beside_events(points: DataFrame, events: DataFrame) -> DataFrame:
    """in_events, and every observation once more by itself, without an event: what is summed up of both is read once."""
    rows, side, inside = _by_day(points, events, itself=True)
    same = (F.col("_mask") >= 0) & (rows["_scope"] == side["_scope"]) & (rows["_day"] == side["_day"])
    return rows.join(side, same, "left").where((F.col("_mask") < 0) | F.coalesce(inside, F.lit(False))).select("event_id", "start_at", "end_at", *points.columns)


def _by_day(points: DataFrame, events: DataFrame, itself: bool = False) -> tuple[DataFrame, DataFrame, Column]:
    """points and events with their days and scopes, and what holds of a point inside an event that applies to it."""
    rows, sides, columns = scoped(points, events, itself)
    days = F.explode(F.sequence(F.to_date("start_at"), F.to_date("end_at"))).alias("_day")
    side = sides.select("event_id", "start_at", "end_at", days, "_scope", *(F.col(c).alias(f"_{c}") for c in columns))
    inside = (F.col("observed_at") >= F.col("start_at")) & (F.col("observed_at") <= F.col("end_at"))
    return rows.withColumn("_day", F.to_date("observed_at")), side, inside & fits(columns)


def event_stats(points: DataFrame, events: DataFrame, key: str = "product_id") -> DataFrame:
    """Per variant and event: count, average, low and high with their rows, and the baseline from the rows outside this event.

    Low ties go to the earliest row, high ties to the latest. The baseline is the variant's totals less the event's, without an anti-join.
    """
    rows = qualifying(points)
    row = F.struct("price", "snapshot_id", "observed_at")
    inside = in_events(rows, events).groupBy(key, "event_id").agg(
        F.count("*").alias("n"), F.sum("price").alias("total"),
        F.min_by(row, F.struct("price", "observed_at", "snapshot_id")).alias("low"), F.max_by(row, F.struct("price", "observed_at", "snapshot_id")).alias("high"),
    )
    totals = rows.groupBy(key).agg(F.count("*").alias("all_n"), F.sum("price").alias("all_total"))
    both = inside.join(totals, key)
    average = mean(F.col("total"), F.col("n"))
    base_n = F.col("all_n") - F.col("n")
    base = mean(F.col("all_total") - F.col("total"), base_n)
    return both.select(
        key, "event_id", F.col("n").alias("n"), average.alias("average_paise"), F.col("low.price").alias("low_paise"), F.col("low.snapshot_id").alias("low_snapshot_id"),
        F.col("high.price").alias("high_paise"), F.col("high.snapshot_id").alias("high_snapshot_id"), base_n.alias("baseline_n"), base.alias("baseline_paise"),
        percent4(base - average, base).alias("below_percent"),
        F.when(base_n == 0, "no_qualifying_observations").when(base == 0, "zero_baseline_price").alias("below_reason"),
    )


def overall_stats(points: DataFrame, events: DataFrame, key: str = "product_id") -> DataFrame:
    """Per variant: average of the rows in any event (each row once), mean and median of the rows in none, and why there is none.

    in-event membership is one flag per row, so hot variants only meet in partial aggregates.
    """
    rows = qualifying(points)
    sale = in_events(rows, events).select("snapshot_id").distinct().withColumn("_sale", F.lit(True))
    flagged = rows.join(sale, "snapshot_id", "left").withColumn("_sale", F.coalesce("_sale", F.lit(False)))
    inside, outside = F.col("_sale"), ~F.col("_sale")
    n_in, n_out = F.count_if(inside), F.count_if(outside)
    grouped = flagged.groupBy(key).agg(
        n_in.alias("sale_n"), mean(F.sum(F.when(inside, F.col("price"))), n_in).alias("sale_average_paise"), F.min(F.when(inside, F.col("price"))).alias("sale_low_paise"),
        n_out.alias("regular_n"), mean(F.sum(F.when(outside, F.col("price"))), n_out).alias("regular_average_paise"), F.percentile(F.when(outside, F.col("price")), F.lit(0.5)).alias("regular_median_paise"),
    )
    return grouped.withColumn("reason", F.when(F.col("sale_n") == 0, "no_observations_during_event"))


def discounted(points: DataFrame, keys: list[str], c: SalesConfig = SalesConfig()) -> DataFrame:
    """Rows at least drop_percent below the median of all earlier prices of their series; medians in doubled paise are exact.

    Series are dealt and sorted by Spark, and a task streams over them: all series that end in a batch of rows are answered together, and only
    the one that may go on is carried over. What leaves Python are the drops.
    """
    rows = qualifying(points)
    tagged = rows.select("*", F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in keys)).alias("_series")).repartition("_series").sortWithinPartitions("_series", *SKEY)
    schema = rows.schema.add("prior2", "long")

    def drops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the series whose end hasn't been seen yet
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_starts(batch.column("_series"))[-1])
            if held and not last and held[0].column("_series")[0] == batch.column("_series")[0]:
                held.append(batch)
                continue
            yield from found([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        yield from found(held)

    def found(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not any(b.num_rows for b in batches):
            return
        whole = pa.Table.from_batches(batches).combine_chunks()
        prices = whole.column("price").to_numpy()
        prior2 = prior_medians(prices, _starts(whole.column("_series").chunk(0)))
        fell = (prior2 > 0) & (100 * (prior2 - 2 * prices) >= c.drop_percent * prior2)
        yield from whole.drop_columns(["_series"]).append_column("prior2", pa.array(prior2, pa.int64())).filter(pa.array(fell)).to_batches(max_chunksize=10_000)

    return _dropped(tagged.mapInArrow(drops, schema), c)


def _starts(series: pa.Array) -> np.ndarray:
    """Where runs of equal values begin."""
    if len(series) < 2:
        return np.arange(len(series))
    return np.concatenate([[0], np.flatnonzero(pc.not_equal(series.slice(1), series.slice(0, len(series) - 1)).to_numpy(zero_copy_only=False)) + 1])


def prior_medians(prices: np.ndarray, starts: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Twice the median of all earlier prices of its series for each price, -1 for the first; series lie one after the other.

    Of each series the first `known` prices may be given in order of size: they count as earlier, and nothing is asked about them.
    """
    out = np.full(len(prices), -1, np.int64)
    ends = np.append(starts[1:], len(prices))
    two, three = starts[ends - starts > 1] + 1, starts[ends - starts > 2] + 2
    out[two] = 2 * prices[two - 1]
    out[three] = prices[three - 1] + prices[three - 2]
    known = np.zeros(len(starts), np.int64) if known is None else known
    long = (ends - starts > 3) & (ends - starts > known)
    for at, end, n in zip(starts[long].tolist(), ends[long].tolist(), known[long].tolist(), strict=True):
        out[at + max(1, n) : end] = running_median(prices[at:end], n)[0 if n else 1 :]
    return out


def running_median(prices: np.ndarray, known: int = 0) -> list[int | None]:
    """Twice the median of all earlier prices, for each price after the `known` ones, which are sorted; null for the very first. Short series are kept sorted, long ones as counts of their ranks."""
    return _median_sorted(prices.tolist(), known) if len(prices) <= 4096 else _median_ranked(prices, known)


def _median_sorted(prices: list[int], known: int = 0) -> list[int | None]:
    seen = prices[:known]
    out: list[int | None] = []
    for n, price in enumerate(prices[known:], known):
        out.append(seen[n // 2] + seen[(n - 1) // 2] if n else None)
        insort(seen, price)
    return out


def _median_ranked(prices: np.ndarray, known: int = 0) -> list[int | None]:
    """A count tree over the ranks finds the middle in logarithmic time: n log n steps and n numbers of memory."""
    ranked = np.unique(prices)
    ranks, values = np.searchsorted(ranked, prices).tolist(), ranked.tolist()
    top = 1 << max(0, len(values) - 1).bit_length()
    counts = [0] * (top + 1)
    for rank in ranks[:known]:
        counts[rank + 1] += 1
    for at in range(1, len(values) + 1):  # counts of single ranks become the tree's
        if at + (at & -at) <= len(values):
            counts[at + (at & -at)] += counts[at]

    def nth(n: int) -> int:
        at, step = 0, top
        while step:
            if at + step <= len(values) and counts[at + step] <= n:
                at += step
                n -= counts[at]
            step >>= 1
        return values[at]

    out: list[int | None] = []
    for n, rank in enumerate(ranks[known:], known):
        out.append(nth(n // 2) + nth((n - 1) // 2) if n else None)
        at = rank + 1
        while at <= len(values):
            counts[at] += 1
            at += at & -at
    return out


def _dropped(rows: DataFrame, c: SalesConfig) -> DataFrame:
    fall = F.col("prior2") - 2 * F.col("price")
    kept = rows.where((F.col("prior2") > 0) & (100 * fall >= c.drop_percent * F.col("prior2")))
    return kept.withColumn("drop_percent", percent4(F.col("prior2") - 2 * F.col("price"), F.col("prior2")))


def detect_windows(points: DataFrame, c: SalesConfig = SalesConfig(), keys: tuple[str, ...] = ("listing_id", "seller_id"), per_retailer: bool = False) -> DataFrame:
    """Sale windows inferred from concurrent drops, by retailer, category and brand.

    Rows are collapsed to one per scope and day before islands are cut, so a hot category meets one task with days, not rows;
    islands are joined back by day. The drops are stored, as both steps read them, and only the columns in question go through Python.
    Two days whose nearest observations are more than max_gap_days apart begin a new window.
    """
    needed = dict.fromkeys([*keys, *ROW, "retailer_id", "category", "brand"])
    drops = stored(discounted(points.select(*needed), list(keys), c).select("observed_at", "drop_percent", "retailer_id", "category", "brand", *keys))
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), F.col(col).cast("string").alias("scope_id")) for s, col in (("retailer", "retailer_id"), ("category", "category"), ("brand", "brand"))))
    part = F.col("retailer_id").cast("string") if per_retailer else F.lit("")
    rows = drops.select("observed_at", "drop_percent", *keys, part.alias("part"), F.inline(scopes)).where("scope_id is not null").withColumn("day", F.to_date("observed_at"))
    scope = ["part", "scope", "scope_id"]
    daily = rows.groupBy(*scope, "day").agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))
    order = Window.partitionBy(*scope).orderBy("day")
    gap = F.unix_micros("first_at") - F.lag(F.unix_micros("last_at")).over(order)
    islands = daily.withColumn("_new", F.when(gap > c.max_gap_days * DAY_US, 1).otherwise(0)).withColumn("island", F.sum("_new").over(order)).select(*scope, "day", "island")
    placed = rows.join(islands, [*scope, "day"])
    found = placed.groupBy(*scope, "island").agg(
        F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"), F.count_distinct(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in keys))).alias("listings"),
        F.count("*").alias("observations"), (half_up((F.percentile(F.round(F.col("drop_percent") * 10_000).cast("long"), F.lit(0.5)) * 2).cast("long"), F.lit(2)) / 10_000.0).alias("median_drop_percent"),
    ).where(F.col("listings") >= c.min_listings)
    level = F.when(F.col("listings") >= c.high_listings, "high").when(F.col("listings") >= c.medium_listings, "medium").otherwise("low")
    kind = F.when(F.col("scope") == "retailer", "retailer_specific").otherwise(F.col("scope"))
    return found.select("scope", "scope_id", kind.alias("event_type"), "start_at", "end_at", "listings", "observations", "median_drop_percent", level.alias("confidence"), F.concat(F.lit("Detected "), "scope", F.lit(" sale "), F.date_format("start_at", "yyyy-MM-dd")).alias("name"), *(["part"] if per_retailer else []))


def windows_as_events(windows: DataFrame) -> DataFrame:
    """Detected windows in the shape of events, with inferred source and one bound scope column."""
    pick = lambda s: F.when(F.col("scope") == s, F.col("scope_id"))
    return windows.select(F.concat_ws("|", "scope", "scope_id", F.date_format("start_at", "yyyyMMdd")).alias("event_id"), pick("retailer").cast("int").alias("retailer_id"), pick("brand").alias("brand"), pick("category").alias("category"), "start_at", "end_at", "event_type", F.lit("observed_price_inference").alias("source"), "confidence")


IDENTITY = ["retailer_id", "category", "brand", "start_at", "end_at", "event_type", "source"]


def new_windows(windows: DataFrame, existing: DataFrame) -> DataFrame:
    """Windows without an equivalent event: a null-safe anti-join on what identifies them."""
    seen = existing.select(*(F.col(c).alias(f"_{c}") for c in IDENTITY))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]
    return windows.dropDuplicates(IDENTITY).join(seen, same, "left_anti")



"""Structured Streaming forms of the price jobs. Each takes a streaming DataFrame; the batch query stays the truth."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.config import SalesConfig
from tidemark.functions.money import half_up
from tidemark.functions.series import price
from tidemark.operators.ops import price_alerts
from tidemark.operators.sales import prior_medians

KEY = ["listing_id", "observed_at", "seller_id"]


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Snapshots without repeats; what is later than the watermark is dropped with its state."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(KEY)


def daily_stats(stream: DataFrame, late: str = "2 days", key: str = "retailer_id") -> DataFrame:
    """Statistics per day and retailer, or variant with another key."""
    window = F.window("observed_at", "1 day")
    rows = stream.withColumn("price", price()).withWatermark("observed_at", late)
    return rows.groupBy(window, key).agg(F.count("*").alias("observations"), F.sum("price").alias("total_paise"), F.min("price").alias("low_paise"), F.max("price").alias("high_paise")).select(F.col("window.start").alias("day"), key, "observations", "total_paise", "low_paise", "high_paise")


def metric_windows(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    window = F.window("ts", "15 minutes", "5 minutes")
    return stream.withWatermark("ts", late).groupBy(window).agg(F.count("*").alias("events"), F.count_if("failed").alias("errors")).select(F.col("window.start").alias("window_start"), "events", "errors")


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB and write only what a batch changes."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    return session


SERIES = ("product_id", "listing_id", "seller_id")


def keyed_drops(stream: DataFrame, late: str = "30 days", idle_days: int = 3650, groups: int = 1024) -> DataFrame:
    """Drops of every series against its row before, which is the series' state: a batch reads and writes the state of its own groups only.

    Series are dealt into groups by hash, and a group's rows are answered together in columns, as a call per series costs more than its rows.
    A group's state holds the last row of each of its series; some hundred series a group keep both the calls and the rewritten state few.
    The number of groups can't change while a checkpoint lives.

    Rows that arrive behind their series' last row have no baseline and don't become its state. Rows behind the watermark are cut off. A
    series without rows for idle_days (of event time) is cleared and then starts anew; a timer clears a group whose series are all idle.
    """
    rows = stream.where(F.col("confidence").isin("high", "medium")).withColumn("price", price()).withWatermark("observed_at", late)
    seller = F.col("seller_id").cast("string").alias("seller_id")  # a number beside nulls would be a fraction in pandas
    keyed = rows.select(F.pmod(F.xxhash64(*SERIES), F.lit(groups)).alias("_group"), "product_id", "listing_id", seller, "snapshot_id", "price", "observed_at", "created_at")
    types = dict(rows.dtypes)
    columns = ("snapshot_id", *SERIES, "observed_at", "price", "baseline_paise")
    out = ", ".join(f"{c} {types.get(c, 'bigint')}" for c in columns)
    return keyed.groupBy("_group").applyInPandasWithState(partial(_drops_of_group, idle_ms=idle_days * 86_400_000), out, "lasts binary", "append", GroupStateTimeout.EventTimeTimeout)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def _same_series(rows: pa.Table) -> np.ndarray:
    """Whether a row goes on with the series of the row before; no seller is a seller of its own."""
    same = np.ones(max(0, len(rows) - 1), bool)
    for c in SERIES:
        if c in rows.column_names:
            column = rows[c].combine_chunks()
            known, values = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
            same &= (values[1:] == values[:-1]) & (known[1:] == known[:-1])
    return same


def _series_starts(rows: pa.Table) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(~_same_series(rows)) + 1])


def _written(table: pa.Table, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


LAST = pa.schema([*((c, pa.int64()) for c in SERIES), ("seen", pa.int64()), ("made", pa.int64()), ("snapshot_id", pa.string()), ("price", pa.int64()), ("until", pa.int64())])


def _drops_of_group(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    mark = state.getCurrentWatermarkMs()
    held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else LAST.empty_table()
    if held.num_rows:
        held = held.filter(pa.compute.greater(held["until"], mark))
    rows = pd.concat(parts, ignore_index=True) if not state.hasTimedOut else None
    if rows is not None:
        fresh = pa.table({
            "product_id": pa.array(rows["product_id"], pa.int64()), "listing_id": pa.array(rows["listing_id"], pa.int64()), "seller_id": pa.array(rows["seller_id"], pa.string()).cast(pa.int64()), "seen": pa.array(_micros(rows["observed_at"])), "made": pa.array(_micros(rows["created_at"])),
            "snapshot_id": pa.array(rows["snapshot_id"], pa.string()), "price": pa.array(rows["price"].astype("Int64"), pa.int64()), "until": pa.nulls(len(rows), pa.int64()),
        }).cast(LAST)
        every = pa.concat_tables([held, fresh]).sort_by([(c, "ascending") for c in (*SERIES, "seen", "made", "snapshot_id")])
        same = _same_series(every)
        cost, new = every["price"].to_numpy(), every["until"].is_null().to_numpy()
        fell = np.flatnonzero(same & (cost[1:] < cost[:-1]) & new[1:]) + 1
        newest = every.take(np.flatnonzero(np.append(~same, True)))
        until = pa.array(np.maximum(newest["seen"].to_numpy() // 1000, mark) + idle_ms)
        held = newest.set_column(LAST.get_field_index("until"), "until", pa.compute.coalesce(newest["until"], until))
        if len(fell):
            found = every.take(fell)
            drops = {"snapshot_id": found["snapshot_id"].to_pandas(), **{c: found[c].to_pandas(integer_object_nulls=True).astype("Int64") for c in SERIES}}
            yield pd.DataFrame({**drops, "observed_at": pd.to_datetime(found["seen"].to_pandas(), unit="us"), "price": cost[fell], "baseline_paise": cost[fell - 1]})
    if not held.num_rows:
        state.remove()
        return
    state.update((_written(held, LAST),))
    state.setTimeoutTimestamp(max(int(pa.compute.max(held["until"]).as_py()), mark + 1))


def keyed_discounts(stream: DataFrame, percent: int, late: str = "30 days", groups: int = 1024) -> DataFrame:
    """Rows at least percent below the median of all earlier prices of their (listing, seller), whose counts by price are the state.

    Series are dealt into groups as in keyed_drops, and all series of a group are answered together in columns. A group's state is as large as
    the number of distinct prices of its series. Rows have to arrive in the order of their series. The number of groups can't change while a
    checkpoint lives.
    """
    rows = stream.where(F.col("confidence").isin("high", "medium")).withColumn("price", price()).where("price is not null").withWatermark("observed_at", late)
    seller = F.col("seller_id").cast("string").alias("seller_id")  # a number beside nulls would be a fraction in pandas
    kept = ("retailer_id", "category", "brand", "snapshot_id", "price", "observed_at", "created_at")
    keyed = rows.select(F.pmod(F.xxhash64("listing_id", "seller_id"), F.lit(groups)).alias("_group"), "listing_id", seller, *kept)
    types = dict(rows.dtypes)
    columns = (*DISCOUNT, "prior2")
    out = ", ".join(f"{c} {types.get(c, 'bigint')}" for c in columns)
    return keyed.groupBy("_group").applyInPandasWithState(partial(_discounts_of_group, percent=percent), out, "prices binary", "append", GroupStateTimeout.NoTimeout)


DISCOUNT = ("listing_id", "seller_id", "retailer_id", "category", "brand", "snapshot_id", "price", "observed_at")
#: Counts of the prices of a group's series, in the order of series and price.
PRICES = pa.schema([("listing_id", pa.int64()), ("seller_id", pa.int64()), ("price", pa.int64()), ("n", pa.int64())])


def _discounts_of_group(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, percent: int) -> Iterator[pd.DataFrame]:
    held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else PRICES.empty_table()
    rows = pd.concat(parts, ignore_index=True)
    fresh = pa.table({
        "listing_id": pa.array(rows["listing_id"], pa.int64()), "seller_id": pa.array(rows["seller_id"], pa.string()).cast(pa.int64()), "price": pa.array(rows["price"], pa.int64()), "n": pa.array(np.ones(len(rows), np.int64)),
        "seen": pa.array(_micros(rows["observed_at"])), "made": pa.array(_micros(rows["created_at"])), "snapshot_id": pa.array(rows["snapshot_id"], pa.string()), "row": pa.array(np.arange(len(rows))),
    })
    every = pa.concat_tables([held, fresh], promote_options="default")
    every = every.append_column("new", every["row"].is_valid().cast(pa.int8()))
    every = every.sort_by([(c, "ascending") for c in ("listing_id", "seller_id", "new", "seen", "made", "snapshot_id", "price")])
    starts = _series_starts(every)
    many, new = every["n"].to_numpy(), every["new"].to_numpy().astype(bool)
    busy = np.repeat(np.maximum.reduceat(new, starts), np.diff(np.append(starts, len(new))))  # series without new rows have nothing to answer
    times = np.where(busy, many, 0)
    prices, asked = np.repeat(every["price"].to_numpy(), times), np.repeat(new, times)
    at = np.concatenate([[0], np.cumsum(times)])[starts]
    at = at[np.maximum.reduceat(busy, starts)]
    known = np.add.reduceat((~asked).astype(np.int64), at)
    prior2 = prior_medians(prices, at, known)
    fell = np.flatnonzero(asked & (prior2 > 0) & (100 * (prior2 - 2 * prices) >= percent * prior2))
    if len(fell):
        place = np.repeat(np.arange(len(new)), times)[fell]
        found = rows.iloc[every["row"].take(place).to_numpy()].reset_index(drop=True)
        sellers = every["seller_id"].take(place).to_pandas(integer_object_nulls=True).astype("Int64")
        yield found.assign(seller_id=sellers, prior2=prior2[fell])[[*DISCOUNT, "prior2"]]
    counted = every.select(PRICES.names).group_by(["listing_id", "seller_id", "price"], use_threads=False).aggregate([("n", "sum")])
    held = counted.rename_columns([*PRICES.names[:3], "n"]).select(PRICES.names).cast(PRICES).sort_by([(c, "ascending") for c in PRICES.names[:3]])
    state.update((_written(held, PRICES),))


def scoped_drops(drops: DataFrame) -> DataFrame:
    """(observed_at, series, drop, scope, scope_id): drops in ten-thousandths of a percent, once for each of their scopes."""
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), F.col(c).cast("string").alias("scope_id")) for s, c in (("retailer", "retailer_id"), ("category", "category"), ("brand", "brand"))))
    share = half_up((F.col("prior2") - 2 * F.col("price")) * 1_000_000, F.col("prior2"))
    series = F.concat_ws("|", F.col("listing_id").cast("string"), F.coalesce(F.col("seller_id").cast("string"), F.lit("none")))
    return drops.select("observed_at", series.alias("series"), share.alias("drop"), F.inline(scopes)).where("scope_id is not null")


def sale_sessions(drops: DataFrame, gap: str = "2 days", late: str = "4 days", c: SalesConfig = SalesConfig()) -> DataFrame:
    """Sale windows of discounted rows per scope, each written once it is over: rows, distinct listings, median drop and confidence.

    An open session keeps the set of its series and counts by drop. Its own end is the last row plus the gap, so the last row's time is kept.
    """
    rows = drops.withWatermark("observed_at", late)
    median = half_up((F.percentile("drop", F.lit(0.5)) * 2).cast("long"), F.lit(2)) / 10_000.0
    sessions = rows.groupBy(F.session_window("observed_at", gap), "scope", "scope_id").agg(
        F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"), F.count("*").alias("observations"), F.size(F.collect_set("series")).cast("long").alias("listings"), median.alias("median_drop_percent"),
    )
    level = F.when(F.col("listings") >= c.high_listings, "high").when(F.col("listings") >= c.medium_listings, "medium").otherwise("low")
    return sessions.where(F.col("listings") >= c.min_listings).select("scope", "scope_id", "start_at", "end_at", "observations", "listings", "median_drop_percent", level.alias("confidence"))


def alerts(rules: DataFrame, offers_of: Callable[[DataFrame], DataFrame], out_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: rules met by the lowest verified price that arrives in a batch.

    offers_of prices the arriving rows as offers (product_id, currency, verified_paise, can_win); only offers that can win count.
    """
    def run(batch: DataFrame, number: int) -> None:
        able = offers_of(batch).where(F.col("can_win") & F.col("verified_paise").isNotNull())
        lowest = able.groupBy("product_id", "currency").agg(F.min("verified_paise").alias("verified_paise"))
        price_alerts(rules, lowest).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return run


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)


def each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

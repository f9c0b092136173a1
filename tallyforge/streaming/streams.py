"""Structured Streaming twins of the incremental operators.

Sources are folders of files (``events`` with ts, user_id, value); event time is cast to a zoned timestamp before its
watermark. State is kept by ticker and small: a running high and a flag.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.sources.folders import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events as a stream of files; a stream must read a folder or a pattern, never one file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_totals(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_of_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, user_id): one row a user and day; repeats within the watermark are dropped, and so are rows that come more than
    ``late`` behind the newest."""
    rows = events.withWatermark("ts", late).withColumn("day", F.to_date("ts"))
    return rows.dropDuplicatesWithinWatermark(["day", "user_id"]).select("day", "user_id")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): each user's runs of events that are less than ``gap`` apart; a session ends ``gap`` after its last event."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def dip_alerts(prices: DataFrame, fall: float = 0.3) -> DataFrame:
    """(ticker, ts, px): a row when a ticker enters a dip of ``fall`` below its running high; armed again once it is out. ``prices`` are
    rows (ticker, ts, px, seq); those of a batch are taken in the order of their time, and of equal times by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, alerted = state.get if state.exists else (float("-inf"), False)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for ts, px in zip(rows["ts"], rows["px"]):
            if px is None or px != px:
                continue
            high = max(high, px)
            dip = px <= (1 - fall) * high
            if dip and not alerted:
                out.append((key[0], ts, px))
            alerted = dip
        state.update((high, alerted))
        yield pd.DataFrame(out, columns=["ticker", "ts", "px"])

    return prices.groupBy("ticker").applyInPandasWithState(step, "ticker string, ts timestamp, px double", "high double, alerted boolean", "append", GroupStateTimeout.NoTimeout)


def regime_flips(levels: DataFrame) -> DataFrame:
    """(series, ts, was, state): a row when a series (series, ts, level, seq) changes between near its high, pullback and bear; a series
    begins near its high. Rows of a batch are taken in the order of their time, and of equal times by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, was = state.get if state.exists else (float("-inf"), "NEAR-HIGH")
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for ts, level in zip(rows["ts"], rows["level"]):
            if level is None or level != level:
                continue
            high = max(high, level)
            below = 100 * (level / high - 1) if high > 0 else 0.0
            now = "BEAR" if below <= -15 else "PULLBACK" if below <= -5 else "NEAR-HIGH"
            if now != was:
                out.append((key[0], ts, was, now))
            was = now
        state.update((high, was))
        yield pd.DataFrame(out, columns=["series", "ts", "was", "state"])

    return levels.groupBy("series").applyInPandasWithState(step, "series string, ts timestamp, was string, state string", "high double, was string", "append", GroupStateTimeout.NoTimeout)


def refetches(asks: DataFrame, days: float = 3.0, forget: str = "30 days") -> DataFrame:
    """(key, ts): of requests (key, ts) those that a cache of ``days`` doesn't serve. A key that isn't asked for is forgotten once the
    watermark is past its entry's end, so state is bounded by the keys of that time."""
    life = pd.Timedelta(days=days)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for ts in sorted(pd.concat(list(batches))["ts"]):
            if last is None or ts >= last + life:
                out.append((key[0], ts))
                last = ts
        state.update((last,))
        end = int((last + life).timestamp() * 1000)
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["key", "ts"])

    return asks.withWatermark("ts", forget).groupBy("key").applyInPandasWithState(step, "key string, ts timestamp", "fetched timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that ``stream`` gives for what its source holds now, as a table of files: each batch is written under its
    number, so that one that runs again replaces itself; a complete result replaces the one before."""
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
    query.awaitTermination()
    rows = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not rows.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(rows):  # the source held no file
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)

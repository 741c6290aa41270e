"""Streaming counterparts of batch operators, on Structured Streaming; an extension, as the batch tables are bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hop_counts(events: DataFrame, time: str, keys: list[str], window: str, hop: str, late: str) -> DataFrame:
    """Rows of each hop window and key; windows close when the watermark (`late` behind) has passed them."""
    x = events.withWatermark(time, late).groupBy(F.window(time, window, hop), *keys).agg(F.count("*").alias("n"))
    return x.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def gap_sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Islands of a key's rows that are less than `gap` apart."""
    x = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return x.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first of rows with equal keys within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def clock_epochs(samples: DataFrame) -> DataFrame:
    """stream_id, source_ordinal, native_ns, epoch: a native time that runs back in a stream opens a new epoch.

    The state of a stream is its epoch and last time; batches must bring a stream's rows in order."""

    def epochs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("source_ordinal", kind="stable")
        out = []
        for t in rows["native_ns"]:
            if last is not None and t < last:
                epoch += 1
            last = t
            out.append(epoch)
        state.update((int(epoch), int(last)))
        yield pd.DataFrame({"stream_id": key[0], "source_ordinal": rows["source_ordinal"], "native_ns": rows["native_ns"], "epoch": out})

    return samples.groupBy("stream_id").applyInPandasWithState(epochs, "stream_id long, source_ordinal long, native_ns long, epoch long", "epoch long, last long", "append", GroupStateTimeout.NoTimeout)


def clock_epochs_in_any_order(samples: DataFrame, time: str, late: str) -> DataFrame:
    """As clock_epochs, for rows that come in any order, up to `late` behind the newest of all streams.

    samples: stream_id, source_ordinal, native_ns and the timestamp column `time`, which doesn't run back along a
    stream's ordinals. The state of a stream is its epoch and last time, and the rows that the watermark hasn't passed; a timer in
    event time hands those on, in order, when it has. So however rows fall into batches, the result is that of one
    batch. Rows that come later than that are dropped, as from any watermark: see windows_and_ledger for keeping them.
    State of this kind needs the RocksDB store, which the session uses from here on."""
    class Epochs(StatefulProcessor):
        """Rows of a stream wait in state until the watermark has passed them, then go on in the order of their ordinals. Defined
        here, so that it goes to the driver's and the executors' workers by value."""

        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "at long, ordinal long, native long")
            self.last = handle.getValueState("last", "epoch long, native long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            earliest = None
            for x in rows:
                self.held.appendList([(int(a), int(o), int(t)) for a, o, t in zip(x["at_millis"], x["source_ordinal"], x["native_ns"])])
                earliest = int(x["at_millis"].min()) if earliest is None else min(earliest, int(x["at_millis"].min()))
            if earliest is not None:
                self.handle.registerTimer(earliest)
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            rows = list(self.held.get())
            ready, waiting = sorted((r[1], r[2]) for r in rows if r[0] <= passed), [tuple(r) for r in rows if r[0] > passed]
            if not ready:
                return
            self.held.put(waiting) if waiting else self.held.clear()
            if waiting:
                self.handle.registerTimer(min(r[0] for r in waiting))
            epoch, last = self.last.get() if self.last.exists() else (0, None)
            epochs = []
            for _, t in ready:
                epoch += last is not None and t < last
                last = t
                epochs.append(int(epoch))
            self.last.update((int(epoch), int(last)))
            yield pd.DataFrame({"stream_id": [key[0]] * len(ready), "source_ordinal": [o for o, _ in ready], "native_ns": [t for _, t in ready], "epoch": epochs})

        def close(self) -> None:
            pass

    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = samples.withWatermark(time, late).select("stream_id", "source_ordinal", "native_ns", time, F.unix_millis(time).alias("at_millis"))
    return x.groupBy("stream_id").transformWithStateInPandas(Epochs(), "stream_id long, source_ordinal long, native_ns long, epoch long", "append", "EventTime")


def late_rows(events: DataFrame, time: str, keys: list[str], delay: int) -> DataFrame:
    """The rows that come too late, for a ledger: keys, time, newest. A row (time: a long) is late if it lies more than
    delay before the newest time that batches up to the one before brought for its stream.

    The state of a stream is that newest time, one number."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def late(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        most = newest
        for rows in batches:
            t = rows[time]
            most = int(t.max()) if most is None else max(most, int(t.max()))
            if newest is not None:
                yield rows.loc[t < newest - delay, [*keys, time]].assign(newest=newest)
        if most is not None:
            state.update((most,))

    named = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, time])
    return events.groupBy(*keys).applyInPandasWithState(late, f"{named}, newest long", "newest long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """All that the source holds now, through the stream, as a Parquet table in `folder`, which driver and executors share.

    For streams in append mode: with several batches a window or session that is still open is not in it."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def totals_once(stream: DataFrame, folder: str) -> DataFrame:
    """As run_once, for an aggregate in complete mode: each batch writes all groups, open ones too, and replaces the one
    before; a batch that is run again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/table/batch_{number}/rows")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    last = stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{folder}/table").agg(F.max("batch")).first()[0]  # one number
    return stream.sparkSession.read.parquet(f"{folder}/table/batch_{last}/rows").drop("batch")


def _numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the batches' folders under path; none if there are none yet."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def windows_and_ledger(events: DataFrame, folder: str, time: str, keys: list[str], window: int, hop: int, delay: int) -> None:
    """Runs the stream over all that its source holds now; of each batch, rows that aren't late are counted by hop window, and
    late ones go to a ledger, so each row is in one of both.

    time is a long, as are window, hop and delay. A row is late if it lies more than delay before the newest time that earlier
    batches brought. What a batch adds lies in folders of its number, which a batch that is run again writes anew: counts of
    windows (partials), late rows (ledger) and its newest time (progress). A window may get counts from several batches."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = _numbered(spark, f"{folder}/progress", "newest long, batch long").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        late = F.col(time) < newest - delay if newest is not None else F.lit(False)
        kept = batch.where(~late)
        last = F.floor(F.col(time) / hop)
        first = F.floor((F.col(time) - window) / hop) + 1
        counts = kept.withColumn("__window", F.explode(F.sequence(first, last))).groupBy(*keys, (F.col("__window") * hop).alias("start")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/partials/batch={number}")
        batch.where(late).withColumn("newest", F.lit(newest).cast("long")).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")
        batch.agg(F.greatest(F.max(time), F.lit(newest).cast("long")).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")

    q = events.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def counted_windows(spark: SparkSession, folder: str, keys: str, window: int, delay: int) -> DataFrame:
    """keys, start, n, closed (no row that isn't late can reach it any more) of the windows that windows_and_ledger counted."""
    names = [c.split()[0].strip("`") for c in keys.split(", ")]
    newest = _numbered(spark, f"{folder}/progress", "newest long, batch long").agg(F.max("newest")).first()[0]
    x = _numbered(spark, f"{folder}/partials", f"{keys}, start long, n long, batch long")
    return x.groupBy(*names, "start").agg(F.sum("n").alias("n")).withColumn("closed", F.col("start") + window <= F.lit(newest).cast("long") - delay)


def ledger(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """The late rows, each with its batch and the newest time before it."""
    return _numbered(spark, f"{folder}/ledger", f"{columns}, newest long, batch long")

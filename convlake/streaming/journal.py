"""The journal as a stream: an append-only folder of events, read incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """New files of the journal as they come; the checkpoint keeps what has been read."""
    return spark.readStream.schema(SCHEMA).format(kind).load(path)


def per_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and their values by type and hour; rows later than the watermark allows are too late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


class LatestTotal(StatefulProcessor):
    """By conversation the total of the latest value of each key; a later value of a key replaces the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getMapState("latest", "event_type string", "value double, event_id long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        for batch in rows:
            for r in batch.sort_values("event_id").itertuples():
                k = (r.event_type,)
                if not self._latest.containsKey(k) or self._latest.getValue(k)[1] < r.event_id:
                    self._latest.updateValue(k, (float(r.value), int(r.event_id)))
        values = [v[0] for _, v in self._latest.iterator()]
        yield pd.DataFrame({"user_id": [key[0]], "n_keys": [len(values)], "total": [round(sum(sorted(values)), 6)]})

    def close(self) -> None:
        pass


def latest_total(events: DataFrame) -> DataFrame:
    """user_id, n_keys, total, updated with each batch of rows."""
    return events.select("user_id", "event_type", "value", "event_id").groupBy("user_id").transformWithStateInPandas(LatestTotal(), "user_id long, n_keys long, total double", "Update", "None")


def idle(events: DataFrame, gap: str = "3 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that a gap ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """Reads all there is now and writes it to a Parquet folder."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

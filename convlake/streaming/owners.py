"""Who owns the state that an engine holds: lost when another used the engine or it was restarted, worth a save when it lies idle."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
INPUT = "engine bigint, ts timestamp, seq bigint, conv bigint, started bigint, requests bigint, tokens bigint, loaded boolean"
OUTPUT = "engine bigint, at timestamp, what string, conv bigint, tokens bigint"
# How long a state lies idle before it is saved, and how large it then is at least.
IDLE_SECONDS, LEAST_TOKENS = 180, 16_384
#: A counter that a row does not have: nulls would make floats of numbers on their way into a frame.
UNKNOWN = -(2**63)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which processors of state need; the session's setting comes back behind."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Owner(StatefulProcessor):
    """One engine. A row with a conv is a call of ours that ended and owns the state from then on; one without is a look at the engine."""

    def __init__(self, idle_us: int, least_tokens: int) -> None:
        self._idle, self._least = idle_us, least_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._owner = handle.getValueState("owner", "conv bigint, started bigint, requests bigint, tokens bigint, ended_us bigint, saved boolean")

    def _timer(self, owner: tuple) -> int:
        return -(-(owner[4] + self._idle) // 1000)

    def _idle_by(self, owner: tuple | None, us: int) -> bool:
        return owner is not None and not owner[5] and owner[3] >= self._least and owner[4] + self._idle <= us

    @staticmethod
    def _why_lost(owner: tuple, row) -> str | None:
        if not row.loaded:
            return "unloaded"
        if owner[1] != UNKNOWN and row.started != owner[1]:
            return "restarted"
        # the total of an engine may come a moment after the end of a call
        if owner[2] != UNKNOWN and row.requests not in (owner[2], owner[2] - 1):
            return "foreign request"
        return None

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        seen = pd.concat(list(rows)).sort_values(["us", "seq"])
        owner = self._owner.get() if self._owner.exists() else None
        timer, out = self._timer(owner) if owner and not owner[5] else None, []
        for row in seen.itertuples(index=False):
            if self._idle_by(owner, row.us):
                out.append((owner[4] + self._idle, "idle", owner[0], owner[3]))
                owner = (*owner[:5], True)
            if row.own:
                owner = (row.conv, row.started, row.requests, row.tokens, row.us, False)
            elif owner is not None and (why := self._why_lost(owner, row)):
                out.append((row.us, why, owner[0], owner[3]))
                owner = None
        wanted = self._timer(owner) if owner and not owner[5] and owner[3] >= self._least else None
        if timer != wanted:
            if timer in set(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            if wanted is not None:
                self._handle.registerTimer(wanted)
        if owner is None:
            self._owner.clear()
        else:
            self._owner.update(owner)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        owner = self._owner.get() if self._owner.exists() else None
        if self._idle_by(owner, expiredTimerInfo.getExpiryTimeInMs() * 1000):
            self._owner.update((*owner[:5], True))
            yield self._rows(key, [(owner[4] + self._idle, "idle", owner[0], owner[3])])

    @staticmethod
    def _rows(key, out: list):
        import pandas as pd

        us, what, conv, tokens = zip(*out)
        what = pd.Series(what, dtype=object)
        return pd.DataFrame({"engine": [key[0]] * len(out), "at": pd.to_datetime(list(us), unit="us"), "what": what, "conv": conv, "tokens": tokens})

    def close(self) -> None:
        pass


def owners(rows: DataFrame, idle_seconds: int = IDLE_SECONDS, least_tokens: int = LEAST_TOKENS, late: str = "1 hour") -> DataFrame:
    """What happens to the states that engines hold: engine, at, what, conv, tokens.

    rows (INPUT) are a stream in which each engine's come in the order of ts and seq. what: unloaded, restarted (`started` is another) or
    foreign request (`requests` is neither the owner's nor one less): the owner's state is lost, found by the first row that shows it;
    counters that the owner's row lacks are not compared, rows without engine or ts are passed over, a null `loaded` is true;
    idle: nobody lost or replaced a state of least_tokens or more for idle_seconds, told once for each. An engine that falls silent has
    its idle state told by a timer, once the watermark is past it; each engine's state is one row, whatever number of rows it has.
    """
    counters = (f"coalesce({c}, {UNKNOWN}) AS {c}" for c in ("started", "requests"))
    others = ("coalesce(seq, 0) AS seq", "conv IS NOT NULL AS own", "coalesce(conv, 0) AS conv", "coalesce(tokens, 0) AS tokens", "coalesce(loaded, true) AS loaded")
    timed = rows.where("engine IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).selectExpr("engine", "ts", "unix_micros(ts) AS us", *counters, *others)
    return timed.groupBy("engine").transformWithStateInPandas(Owner(idle_seconds * 1_000_000, least_tokens), OUTPUT, "Append", "EventTime")

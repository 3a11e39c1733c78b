"""The liquidity machine as a stream: state by market, days taken in order by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.simulate import liquidity_steps
from tidemill.streaming.events import exactly, shared_folder

FIELDS = "market string, d date, raw string, status string"


class LiquidityMachine(StatefulProcessor):
    """A market's days wait in state until the watermark has passed them; a timer a day then takes all that
    are due, in order, so late and mixed rows within the watermark change nothing. The first raw state of
    a day counts; a day that was taken is not taken again."""

    def __init__(self, confirm: int, recovery: int):
        self.confirm, self.steps = confirm, liquidity_steps(confirm, recovery)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "state int, day long")
        self.waiting = handle.getMapState("waiting", "day long", "raw string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.at.get()[1] if self.at.exists() else -(1 << 60)
        for pdf in rows:
            for day, raw in zip(pdf["at"].astype("datetime64[ms]").astype("int64").tolist(), pdf["raw"]):
                if day > taken and not self.waiting.containsKey((day,)):
                    self.waiting.updateValue((day,), (raw,))
                    self.handle.registerTimer(day)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(day for (day,) in self.waiting.keys() if day <= expiredTimerInfo.getExpiryTimeInMs())
        state, out = self.at.get()[0] if self.at.exists() else 0, []
        for day in due:
            raw = self.waiting.getValue((day,))[0]
            step = self.steps.get(raw)
            if step:
                new = step[state]
                crisis = raw == "CRISIS" or (raw == "WATCH" and state != 0) or (raw == "NORMAL" and 0 < state < self.confirm)
                out.append((key[0], day, raw, "CRISIS" if crisis else "WATCH" if raw == "WATCH" else "NORMAL" if new == 0 else "RECOVERY"))
                state = new
            self.waiting.removeKey((day,))
        if due:
            self.at.update((state, due[-1]))
        if out:
            days = [pd.Timestamp(o[1], unit="ms").date() for o in out]
            yield pd.DataFrame({"market": [o[0] for o in out], "d": days, "raw": [o[2] for o in out], "status": [o[3] for o in out]})

    def close(self) -> None:
        pass


def liquidity_stream(spark: SparkSession, path: str, late: str = "5 days", confirm: int = 3, recovery: int = 3, files_at_once: int = 1) -> DataFrame:
    """market, d, raw, status of all files (market, d, raw) now at path, taken a few at a time.

    A day is told once the watermark passes it, so the newest days, within `late` of the last one seen,
    wait for what comes next. Each batch writes under its own number, so one that runs again replaces its
    files. State lives in the store that timers need; the setting is that of a session of its own."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = shared_folder(spark)
    rows = session.readStream.schema("market string, d date, raw string").option("maxFilesPerTrigger", files_at_once).parquet(exactly(path))
    timed = rows.withColumn("at", F.col("d").cast("timestamp")).withWatermark("at", late).where("market is not null and d is not null")
    told = timed.groupBy("market").transformWithStateInPandas(LiquidityMachine(confirm, recovery), FIELDS, "append", "eventTime")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    told.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(FIELDS).parquet(f"{folder}/rows").drop("batch")

"""The inventory of episodes as keyed state: rows in any order within a lateness, one row of facts for each episode.

An episode's state is what :func:`features.episode_inventory` counts, as running sums, and the rows that are not older than
``lateness`` behind its newest, which may still change places.  A row that comes later than that is counted as late and
left out of the steps.  Each batch gives the facts so far of every episode it touched; an event-time timer closes an
episode once the watermark is ``retention`` past its newest row, and drops its state.  State is in the stream's checkpoint,
so a restarted stream goes on where it stood.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FACTS = "row_count long, first_t double, last_t double, steps_back long, steps_zero long, steps_forward long, mean_step double, std_step double, min_step double, max_step double, label_segments long, labels string, late_rows long, closed boolean"


class Facts:
    """Running facts of one episode's rows (seconds, row, label) in the order of their rows or times."""

    def __init__(self) -> None:
        self.rows = self.back = self.zero = self.forward = self.segments = self.late = 0
        self.low, self.high, self.least, self.most = math.inf, -math.inf, math.inf, -math.inf
        self.mean = self.square = 0.0
        self.labels: set[str] = set()
        self.last: tuple | None = None
        self.waiting: list[tuple] = []

    def take(self, row: tuple) -> None:
        """The next row in order."""
        t, _, label = row
        before, self.last = self.last, row
        self.rows += 1
        self.low, self.high = min(self.low, t), max(self.high, t)
        if label is not None:
            self.labels.add(label)
        if before is None or before[2] is None or (label is not None and label != before[2]):
            self.segments += 1
        if before is not None:
            step = t - before[0]
            self.back, self.zero = self.back + (step < 0), self.zero + (step == 0)
            if step > 0:
                self.forward += 1
                away = step - self.mean
                self.mean += away / self.forward
                self.square += away * (step - self.mean)
                self.least, self.most = min(self.least, step), max(self.most, step)

    def settle(self, before: float) -> None:
        """Take all waiting rows older than ``before``, in order."""
        self.waiting.sort(key=lambda r: r[:2])
        n = next((i for i, r in enumerate(self.waiting) if r[0] >= before), len(self.waiting))
        for row in self.waiting[:n]:
            self.take(row)
        del self.waiting[:n]

    def so_far(self) -> tuple:
        """The facts with the waiting rows counted in."""
        whole = pickle.loads(pickle.dumps(self))
        whole.settle(math.inf)
        some = whole.forward > 0
        steps = (whole.mean, math.sqrt(max(whole.square / whole.forward, 0.0)), whole.least, whole.most) if some else (None,) * 4
        return whole.rows, whole.low, whole.high, whole.back, whole.zero, whole.forward, *steps, whole.segments, ";".join(sorted(whole.labels)), whole.late


class Inventory(StatefulProcessor):
    """Seconds of lateness within which rows are put in order, and of retention after which an episode is closed."""

    def __init__(self, episode: str, lateness: float, retention: float):
        self.episode, self.lateness, self.retention = episode, lateness, retention

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("facts", "data binary")

    def _row(self, key: tuple, facts: Facts, closed: bool) -> pd.DataFrame:
        names = [self.episode, *(part.split()[0] for part in FACTS.split(", "))]
        return pd.DataFrame([(key[0], *facts.so_far(), closed)], columns=names).astype(object).where(lambda x: x.notna(), None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = pickle.loads(self.state.get()[0]) if self.state.exists() else Facts()
        for part in rows:
            for t, row, label in zip(part["t"], part["row"], part["label"], strict=True):
                if facts.last is not None and (t, row) < facts.last[:2]:
                    facts.late += 1
                else:
                    facts.waiting.append((float(t), int(row), None if pd.isna(label) else str(label)))
        newest = max([r[0] for r in facts.waiting], default=facts.high)
        facts.settle(newest - self.lateness)
        self.state.update((pickle.dumps(facts),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if math.isfinite(newest):
            self.handle.registerTimer(int((newest + self.retention) * 1000))
        yield self._row(key, facts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts = pickle.loads(self.state.get()[0])
        self.state.clear()
        yield self._row(key, facts, True)

    def close(self) -> None:
        pass


def inventory_stream(rows: DataFrame, episode: str, time: str, row: str, label: str, lateness: float = 3600.0, retention: float = 7 * 86400.0) -> DataFrame:
    """``episode`` and its facts for each episode that a batch touches or closes; ``rows`` is a stream.

    Rows without a time are left out.  The watermark lies ``retention`` behind the newest time, so that late rows reach
    their episode and are counted there.
    """
    kind = dict(rows.dtypes)[episode]
    timed = rows.where(F.col(time).isNotNull() & F.col(row).isNotNull()).select(
        F.col(episode), F.col(time).cast("timestamp").alias("event_time"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"), F.col(row).cast("long").alias("row"), F.col(label).cast("string").alias("label")
    )
    marked = timed.withWatermark("event_time", f"{int(retention)} seconds")
    return marked.groupBy(episode).transformWithStateInPandas(Inventory(episode, lateness, retention), f"{episode} {kind}, {FACTS}", "Update", "EventTime")


def run_inventory(stream: DataFrame, path: str, checkpoint: str, episode: str, time: str, row: str, label: str, lateness: float = 3600.0, retention: float = 7 * 86400.0) -> None:
    """Read what is there into a table of facts by batch under ``path``, from where ``checkpoint`` stands."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        # A batch that runs again after a failure writes its folder again.
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        out = inventory_stream(stream, episode, time, row, label, lateness, retention)
        run = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def latest(spark: SparkSession, path: str, episode: str) -> DataFrame:
    """The last facts of each episode under ``path``."""
    newest = F.row_number().over(Window.partitionBy(episode).orderBy(F.desc("batch"), F.desc("closed")))
    return spark.read.parquet(path).withColumn("newest", newest).where("newest = 1").drop("newest", "batch")

"""Views kept as streaming state: compare-and-swap by confidence, the backlog gate, appends that happen once (§2.14)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The session, with the state store that processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class Strongest(StatefulProcessor):
    """A key's row gives way to a later one of no smaller confidence; one row of state per key, no expiry."""

    def __init__(self, schema: str, default: float) -> None:
        self.schema, self.default = schema, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else None
        best, before = old, old
        for pdf in rows:  # in any order: of rows of one batch the surest wins, then the latest
            rank = list(zip(pdf["confidence"].fillna(self.default), pdf["log_pos"], strict=True))
            i = max(range(len(rank)), key=rank.__getitem__)
            if best is None or rank[i] >= self._rank(best):
                best = tuple(None if pd.isna(x) else x for x in pdf.iloc[i])
        if best is not before:
            best = tuple(x.item() if hasattr(x, "item") else x for x in best)
            self.held.update(best)
            yield pd.DataFrame([best], columns=self._names())

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _rank(self, row: tuple) -> tuple:
        at = dict(zip(self._names(), row, strict=True))
        return (self.default if at["confidence"] is None else at["confidence"], at["log_pos"])

    def close(self) -> None:
        pass


def strongest_stream(log: DataFrame, *keys: str, default: float = 0.5) -> DataFrame:
    """Changes of the view of ``fold.strongest_write``, as an update stream: a row when a key's row changes.

    ``log`` has ``log_pos`` and ``confidence``; any split of it into batches, in whatever order
    their rows come, ends in the batch fold's view.
    """
    schema = ", ".join(f"{n} {t}" for n, t in log.dtypes)
    return log.groupBy(*keys).transformWithStateInPandas(Strongest(schema, default), schema, "Update", "None")


class Backlog(StatefulProcessor):
    """Results that no summary covers, by id; above the gate the oldest go out, and stay until a summary has them."""

    def __init__(self, gate: int, most: int) -> None:
        self.gate, self.most = gate, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "event_id string", "ts string, chars long")
        self.covered = handle.getMapState("covered", "event_id string", "there boolean")
        self.chars = handle.getValueState("chars", "chars long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        chars = self.chars.get()[0] if self.chars.exists() else 0
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                name = (r.event_id,)
                if r.compacted:  # also before its result comes: ids decide, never times
                    if self.waiting.containsKey(name):
                        chars -= self.waiting.getValue(name)[1]
                        self.waiting.removeKey(name)
                    self.covered.updateValue(name, (True,))
                elif not self.covered.containsKey(name) and not self.waiting.containsKey(name):
                    self.waiting.updateValue(name, (r.ts, int(r.chars)))
                    chars += int(r.chars)
        self.chars.update((chars,))
        if chars // 4 > self.gate:
            oldest = heapq.nsmallest(self.most, ((v[0], k[0]) for k, v in self.waiting.iterator()))
            yield pd.DataFrame([(key[0], i, e, t, chars // 4) for i, (t, e) in enumerate(oldest)], columns=["store", "place", "event_id", "ts", "tokens"])

    def close(self) -> None:
        pass


def backlog_stream(results: DataFrame, summaries: DataFrame, gate: int = 40_000, most: int = 20) -> DataFrame:
    """``store, place, event_id, ts, tokens``: after each batch that changes a store, what ``fold.backlog_batch`` would take.

    ``results``: ``store, event_id, ts, payload``; ``summaries``: ``store, events_compacted``.
    A result counts once by id.  State is an id with a number per open result and an id per
    covered one; of the open ones no more than ``most`` are held in memory.
    """
    new = results.select("store", "event_id", F.col("ts").cast("string").alias("ts"), F.coalesce(F.length("payload"), F.lit(0)).cast("long").alias("chars"), F.lit(False).alias("compacted"))
    done = summaries.select("store", F.explode("events_compacted").alias("event_id"), F.lit(None).cast("string").alias("ts"), F.lit(0).cast("long").alias("chars"), F.lit(True).alias("compacted"))
    return new.unionByName(done).groupBy("store").transformWithStateInPandas(Backlog(gate, most), "store string, place int, event_id string, ts string, tokens long", "Append", "None")


def append_once_stream(rows: DataFrame, path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Rows to a table, each key once: the keys seen are state without expiry, the table itself is not read (K3, K6, K9).

    The file sink commits whole batches, so a batch that runs again adds nothing either.
    """
    return rows.dropDuplicates(list(keys)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

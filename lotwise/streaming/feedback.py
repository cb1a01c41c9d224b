"""Causal feedback as a stream: wafers are decided on, predicted, and teach the models of their lot as they arrive.

State by (lot, budget, feedback): the model of earlier lots, which comes as initial state; the moments that feedback
refits from, in a map; how many wafers came, were measured and taught; and the keys of wafers seen, so that a repeated
row is taken once. A lot whose wafers stop coming is closed by an event-time timer: it gives one closing row, and its
state is dropped. Rows behind the watermark are dropped by Spark before they come here.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lotwise.streaming.replay import decide

OUTPUT = "lot_number int, budget double, feedback string, wafer_order int, experiment_key string, measured boolean, system_error double, updates int, closed boolean"
COUNTS = "seen int, taken int, updates int, bias double, closes_at long, error_sum double"
BY = ("lot_number", "budget", "feedback")


class FeedbackProcessor(StatefulProcessor):
    """Decides by quota, predicts with what is known, and learns from measured wafers."""

    def __init__(self, alpha: float = 0.3, idle_ms: int = 3_600_000):
        self.alpha, self.idle = alpha, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS)
        self.model = handle.getValueState("model", "model binary")
        self.moments = handle.getMapState("moments", "part string", "moments binary")
        self.keys = handle.getMapState("keys", "experiment_key string", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.model.update((bytes(initialState["model"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows)).sort_values("wafer_order", kind="stable")
        if not self.model.exists():
            yield self._rows([])
            return
        model = pickle.loads(self.model.get()[0])
        budget, feedback, out = float(key[1]), key[2], []
        seen, taken, updates, bias, closes, total = self.counts.get() if self.counts.exists() else (0, 0, 0, 0.0, 0, 0.0)
        known = replace(model.start, bias=bias, updates=updates)
        for part in ("shifts", "scores"):
            if self.moments.containsKey((part,)):
                known = replace(known, **{part: pickle.loads(self.moments.getValue((part,))[0])})
        for r in g.itertuples(index=False):
            if self.keys.containsKey((r.experiment_key,)):
                continue
            self.keys.updateValue((r.experiment_key,), (True,))
            x, target = np.asarray(r.x, float), np.asarray(r.map, float)
            plain = model.predicted(known, x[None])[0]
            measured = decide(seen, taken, int(r.lot_size), float(r.score), budget, float(r.threshold))
            error = 0.0 if measured else float(np.abs(plain + known.bias - target).mean())
            if measured:
                known = model.taught(known, feedback, x, target, plain, self.alpha)
            seen, taken, total = seen + 1, taken + measured, total + error
            out.append((int(key[0]), budget, feedback, int(r.wafer_order), r.experiment_key, bool(measured), error, known.updates, False))
        if out:
            for part in ("shifts", "scores"):
                if getattr(known, part) is not getattr(model.start, part):
                    self.moments.updateValue((part,), (pickle.dumps(getattr(known, part)),))
            if closes:
                self.handle.deleteTimer(closes)
            closes = int(g["event_time"].max().timestamp() * 1000) + self.idle
            self.handle.registerTimer(closes)
            self.counts.update((seen, taken, known.updates, known.bias, closes, total))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.counts.exists():
            seen, _, updates, _, _, total = self.counts.get()
            out = [(int(key[0]), float(key[1]), key[2], seen, None, None, total / seen, updates, True)]
            self.counts.clear()
            self.model.clear()
            self.moments.clear()
            self.keys.clear()
        yield self._rows(out)

    def _rows(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def feedback_stream(wafers: DataFrame, models: DataFrame, alpha: float = 0.3, idle_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """Decisions and errors as wafers come, and a closing row a lot: the number of its wafers, their mean error, closed true.

    wafers: (lot_number, budget, feedback, wafer_order, experiment_key, lot_size, score, threshold, x, map, event_time);
    models: (test_lot, budget, feedback, model), those of ``plans.models.causal_models`` for each budget and feedback. Within a micro-batch wafers are
    taken in their order, so any split into batches that keeps the order of a lot gives what the batch replay gives;
    repeated wafers change nothing. A lot without a model gives nothing. ``idle_ms`` after a lot's last wafer, in event
    time, it is closed.
    """
    start = models.select(F.col("test_lot").alias("lot_number"), "budget", "feedback", "model")
    return wafers.withWatermark("event_time", delay).groupBy(*BY).transformWithStateInPandas(
        statefulProcessor=FeedbackProcessor(alpha, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", initialState=start.groupBy(*BY))


def run_available(wafers: DataFrame, models: DataFrame, path: str, checkpoint: str, alpha: float = 0.3, idle_ms: int = 3_600_000) -> None:
    """Processes what is there and ends. Rows are appended to ``path`` as Parquet."""
    spark = wafers.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = feedback_stream(wafers, models, alpha, idle_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()

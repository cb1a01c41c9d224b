"""The measurement policy as a stream: wafers arrive, each is decided on before its metrology is known.

State by (lot, budget): how many wafers came and were measured, and the bias learnt. The lot size must be known in
advance and comes with each wafer. Within a micro-batch wafers are taken in their order, so any split of a lot into
batches that keeps the order gives what the batch operators give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "lot_number int, budget double, wafer_order int, experiment_key string, measured boolean, bias double, system_error double"
STATE = "seen int, taken int, bias double"


def decide(seen: int, taken: int, n: int, score: float, budget: float, threshold: float) -> bool:
    """Whether the wafer after ``seen`` others, ``taken`` of them measured, is measured."""
    total = min(round(budget * n), n)  # round is half to even
    forced = taken < total - (n - seen - 1)
    eligible = score >= threshold and taken < min(total, math.ceil(budget * (seen + 1)))
    return taken < total and (forced or eligible)


class QuotaProcessor(StatefulProcessor):
    """Decides wafer by wafer and corrects by the bias of those measured before."""

    def __init__(self, alpha: float = 0.3):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("policy", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows)).sort_values("wafer_order")
        seen, taken, bias = self.state.get() if self.state.exists() else (0, 0, 0.0)
        budget, out = float(key[1]), []
        for r in g.itertuples(index=False):
            measured = decide(seen, taken, int(r.lot_size), float(r.score), budget, float(r.threshold))
            out.append((int(key[0]), budget, int(r.wafer_order), r.experiment_key, measured, bias, 0.0 if measured else float(r.error)))
            seen, taken = seen + 1, taken + measured
            if measured:
                bias = self.alpha * float(r.shift) + (1 - self.alpha) * bias
        self.state.update((seen, taken, bias))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def replay_stream(wafers: DataFrame, alpha: float = 0.3) -> DataFrame:
    """wafers(lot_number, budget, wafer_order, experiment_key, lot_size, score, threshold, shift, error): decisions as they are made."""
    return wafers.groupBy("lot_number", "budget").transformWithStateInPandas(statefulProcessor=QuotaProcessor(alpha), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def run_available(wafers: DataFrame, path: str, checkpoint: str, alpha: float = 0.3) -> None:
    """Processes what is there and ends; decisions are appended to ``path`` as Parquet."""
    spark = wafers.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = replay_stream(wafers, alpha).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()

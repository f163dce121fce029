"""Mate pairing of records that arrive over time.

State is one pending record a name. A second record completes the fragment; a record whose mate has not
come when the watermark is ``wait`` past it leaves as an orphan. Time is a column of the records or, without
one, the time of the batch that brought them; only it lets records go, so a query over what is there
(``availableNow``) ends, and keeps what still waits for its next start. The batch form is
``operators.quantify.pair_mates``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "qname string, first_arrival long, second_arrival long, orphan boolean"
STATE = "pending long, since long"
#: How long a record waits for its mate.
WAIT_MS = 60_000


def _fragments(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["qname", "first_arrival", "second_arrival", "orphan"]).astype({"second_arrival": "Int64"})


def _stepper(wait_ms: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, out = key[0], []
        if state.hasTimedOut:
            pending, _ = state.get
            state.remove()
            yield _fragments([(name, pending, None, True)])
            return
        pending, since = state.get if state.exists else (None, None)
        for arrival, at in sorted((int(a), int(t)) for b in batches for a, t in zip(b["arrival"], b["_ms"], strict=True)):
            if pending is None:
                pending, since = arrival, at
            else:
                out.append((name, pending, arrival, False))
                pending = None
        if pending is not None:
            state.update((pending, since))
            state.setTimeoutTimestamp(max(since + wait_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield _fragments(out)

    return step


def pair_stream(records: DataFrame, event_time: str | None = None, wait_ms: int = WAIT_MS, late_ms: int = WAIT_MS) -> DataFrame:
    """Fragments of a stream of primary records (qname, arrival), in append mode.

    ``event_time`` names a timestamp column. The watermark is ``late_ms`` behind its latest value: records that come
    in order by up to that much are all paired or leave as orphans, and Spark drops later ones.
    """
    at = F.col(event_time) if event_time else F.current_timestamp()
    rows = records.withColumn("_at", at).withWatermark("_at", f"{late_ms} milliseconds")
    rows = rows.select("qname", "arrival", "_at", F.unix_millis("_at").alias("_ms"))
    return rows.groupBy("qname").applyInPandasWithState(_stepper(wait_ms), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def reads_stream(spark, folder: str, schema: str) -> DataFrame:
    """Chunks of reads as they arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)

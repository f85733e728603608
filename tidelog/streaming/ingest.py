"""Continuous ingest: a stream of log rows into a table, or into per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.table import KVTable


def into_table(stream: DataFrame, table: KVTable, checkpoint: str, trigger: dict | None = None):
    """Write each micro-batch of (batch_id, pos, op, k, v) as one commit.

    A batch that is delivered again after a restart is skipped: the table's manifest
    remembers the last one of the stream.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        if batch <= table.state.get("stream_batch", -1):
            return
        table.write(rows, stream_batch=batch)  # one commit

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_versions(stream: DataFrame, value_type: str = "string") -> DataFrame:
    """(k, seq, op, v) whenever a newer version of a key arrives, in whatever order they come.

    The state keeps tombstones too: without them a late put would bring a deleted key back.
    Late rows lose by their sequence, so no watermark is needed.
    """
    schema = f"k string, seq long, op long, v {value_type}"

    def newer(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, 0, None)
        changed = False
        for part in rows:
            top = part.loc[part["seq"].idxmax()]
            if top["seq"] > best[0]:
                best, changed = (int(top["seq"]), int(top["op"]), top["v"]), True
        if changed:
            state.update(best)
            yield pd.DataFrame({"k": [key[0]], "seq": [best[0]], "op": [best[1]], "v": [best[2]]})

    keyed = stream.select("k", "seq", F.col("op").cast("long").alias("op"), "v").groupBy("k")
    return keyed.applyInPandasWithState(newer, schema, f"seq long, op long, v {value_type}", "update", GroupStateTimeout.NoTimeout)

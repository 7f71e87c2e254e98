"""Record lifecycle: allowed transitions, idempotent events, outbox; in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Allowed transitions.
TRANSITIONS = {
    "CAPTURED": ["PENDING_AI", "MANUAL_REVIEW_REQUIRED"], "PENDING_AI": ["AI_PROCESSED", "PROCESSING_FAILED", "MANUAL_REVIEW_REQUIRED"], "PROCESSING_FAILED": ["MANUAL_REVIEW_REQUIRED"],
    "AI_PROCESSED": ["NEEDS_REVIEW", "PENDING_AI"], "NEEDS_REVIEW": ["VALIDATED", "PENDING_AI", "MANUAL_REVIEW_REQUIRED"], "MANUAL_REVIEW_REQUIRED": ["VALIDATED", "PENDING_AI", "NEEDS_REVIEW"],
    "VALIDATED": ["PATIENT_MATCHED", "DUPLICATE_SUSPECTED", "MANUAL_REVIEW_REQUIRED", "NEEDS_REVIEW"], "DUPLICATE_SUSPECTED": ["PATIENT_MATCHED", "MANUAL_REVIEW_REQUIRED"],
    "PATIENT_MATCHED": ["REGISTERED"], "REGISTERED": ["SYNCED", "SYNC_FAILED"], "SYNC_FAILED": ["SYNCED"], "SYNCED": [],
}


def edges(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, targets in table.items() for b in targets], "from_state string, to_state string")


def illegal(history: DataFrame, allowed: DataFrame, record: str, order: str, state: str) -> DataFrame:
    """Steps (record, order, from_state, to_state) that no edge allows; a repeated state is no step."""
    steps = history.withColumn("from_state", F.lag(state).over(Window.partitionBy(record).orderBy(order))).withColumnRenamed(state, "to_state")
    return steps.where("from_state <> to_state").join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti").select(record, order, "from_state", "to_state")


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each idempotency key."""
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__p = 1").drop("__p")


def settled(pages: DataFrame, record: str, status: Column) -> DataFrame:
    """(record, state): waiting while a page is stored or uploaded, else by whether one failed."""
    return pages.groupBy(record).agg(F.when(F.bool_or(status.isin("stored", "uploaded")), "WAITING").when(F.bool_or(status == "failed"), "MANUAL_REVIEW_REQUIRED").otherwise("AI_PROCESSED").alias("state"))


def missing_jobs(required: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return required.join(existing.select(key), key, "left_anti")


def backoff(attempts: Column, most: int = 600) -> Column:
    return F.least(F.lit(float(most)), F.pow(F.lit(2.0), attempts))


#: Ids that a record's state remembers, the latest ones, to tell a replayed event from a late one.
SEEN = 5000


def guarded(events: DataFrame, table: dict[str, list[str]], record: str = "record_id", state: str = "to_state", remember: int = SEEN) -> DataFrame:
    """Streaming guard: (record, event_id, from_state, to_state, ok, reason) for each event in order of its id; the last legal state of a record is kept.

    events: a stream with record, event_id (long) and the target state. An event whose id is remembered is a replay and gives no row.
    One with a smaller id than the last that isn't remembered comes late: it gives a row that isn't ok and changes nothing.
    """
    schema = f"{record} string, event_id bigint, from_state string, to_state string, ok boolean, reason string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        current, last, recent = held.get if held.exists else (None, -1, [])
        recent = dict.fromkeys(recent)
        rows = pd.concat(list(frames)).sort_values("event_id", kind="stable")
        out = []
        for event, target in zip(rows["event_id"].tolist(), rows[state], strict=True):
            if event in recent:
                continue
            late = event < last
            legal = current is None or current == target or target in table.get(current, [])
            out.append((key[0], event, current, target, legal and not late, "late" if late else None if legal else "illegal"))
            recent[event] = None
            if not late:
                last, current = event, target if legal else current
        held.update((current, last, list(recent)[-remember:]))
        yield pd.DataFrame(out, columns=[record, "event_id", "from_state", "to_state", "ok", "reason"])

    return events.groupBy(record).applyInPandasWithState(step, schema, "state string, last bigint, recent array<bigint>", "append", "NoTimeout")


def appended(history: DataFrame, path: str, query_name: str, checkpoint: str):
    """Starts a query that appends a stream of history rows to a table: nothing is ever rewritten, and a batch that is replayed is written once."""
    return history.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).queryName(query_name).outputMode("append").trigger(availableNow=True).start()


def once(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """A stream without repeats of a key within a time bound (state is kept for so long only)."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])

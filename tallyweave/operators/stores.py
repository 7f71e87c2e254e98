"""Tables of a device and a server: outbox with due times and retries, snapshots, access, encryption of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attempts after which a job fails, by kind of error, and the longest wait.
MOST_ATTEMPTS = {"server": 4, "unavailable": 10}
LONGEST_WAIT = 600


def due(outbox: DataFrame, now: Column) -> DataFrame:
    """Open jobs whose time has come, with their place in the queue."""
    return outbox.where(~F.col("done") & (F.col("next_attempt_at") <= now))


def retry(kind: Column, attempts: Column, error: Column) -> tuple[Column, Column, Column]:
    """(attempts, wait in seconds, failed) after an error of a job: offline doesn't count, syncing never gives up."""
    counted = F.when(error == "offline", attempts).otherwise(attempts + 1)
    most = F.when(error == "server", MOST_ATTEMPTS["server"]).when(error == "unavailable", MOST_ATTEMPTS["unavailable"])
    failed = (kind != "sync") & F.coalesce(counted >= most, F.lit(False))
    wait = F.when(error == "offline", 0.0).otherwise(F.least(F.lit(float(LONGEST_WAIT)), F.pow(F.lit(2.0), counted)))
    return counted, wait, failed


def manual_key(key: Column, at: Column) -> Column:
    """The idempotency key of a retry by hand: another one, so that the server takes it as new."""
    return F.concat(key, F.lit(":"), at.cast("string"))


def with_state(outbox: DataFrame, pages: DataFrame, records: DataFrame, terminal: list[str]) -> DataFrame:
    """Jobs with their page and record; those of finished records are short-circuited."""
    joined = outbox.join(pages, "page_id", "left").join(records, "record_id", "left")
    return joined.withColumn("skip", F.coalesce(F.col("state").isin(terminal), F.lit(False)))


def snapshot(records: DataFrame, pages: DataFrame, history: DataFrame, key: str = "record_id") -> DataFrame:
    """Each record with its pages and history as arrays in order."""
    listed = lambda rows, name: rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
    out = records.join(listed(pages, "pages"), key, "left").join(listed(history, "history"), key, "left")
    return out.withColumns({"n_pages": F.size(F.coalesce("pages", F.array())), "n_steps": F.size(F.coalesce("history", F.array()))})


def replaced_pages(pages: DataFrame, record: str, page_type: str, at: str) -> DataFrame:
    """pages with `replaced`: a later page of the same type in the record takes an earlier one's place."""
    newest = F.row_number().over(Window.partitionBy(record, page_type).orderBy(F.desc(at)))
    return pages.withColumn("replaced", newest > 1)


def newest(rows: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The n latest rows (a report: each partition keeps n)."""
    return rows.orderBy(F.desc(at), *ties).limit(n)


def newest_of_each(rows: DataFrame, key: str, at: str, n: int, *ties: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *ties))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def visible(role: Column, owner: Column, user: Column, region: Column, user_region: Column) -> Column:
    """Who may see a record: its own midwife, the supervisor of its region; epidemiologists see aggregates only."""
    return F.when(role == "midwife", owner == user).when(role == "supervisor", region == user_region).otherwise(False)


def seal(payload: Column, key: Column, record_id: Column) -> Column:
    """AES-256-GCM with the record id as associated data."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), record_id)


def unseal(sealed: Column, key: Column, record_id: Column) -> Column:
    """The payload; null if the data, the key or the record id is another."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), record_id).cast("string")


def audit(rows: DataFrame, user: str, at: Column, allowed: Column) -> DataFrame:
    """An entry for each access, allowed or not."""
    return rows.select(F.lit(user).alias("user"), at.alias("at"), "image_id", allowed.alias("allowed"))

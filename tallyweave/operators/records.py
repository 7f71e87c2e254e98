"""Records and profiles: merges with precedence, folds over time, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources of human decisions, and statuses that a profile stores.
HUMAN = ["confirmed", "corrected", "manual"]
STORED = ["KNOWN", "UNKNOWN", "NOT_APPLICABLE"]


def merge_extraction(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], source: str = "source") -> DataFrame:
    """Full outer merge: a human decision stays, else the new machine value, else the old one."""
    a, b = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in columns), F.lit(True).alias("o")), new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("n"))
    keep = F.col("o").isNotNull() & (F.col(f"o_{source}").isin(HUMAN) | F.col("n").isNull())
    return a.join(b, keys, "full").select(*keys, *(F.when(keep, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in columns))


def needs_review(source: Column, status: Column, confirm_special: Column) -> Column:
    return ~source.isin(HUMAN) & (status.isin("NEEDS_REVIEW", "ILLEGIBLE") | confirm_special)


def validated(rows: DataFrame, record: str, source: str = "source") -> DataFrame:
    return rows.groupBy(record).agg(F.bool_and(F.col(source).isin(HUMAN)).alias("validated"))


def profile_fold(rows: DataFrame, keys: list[str], at: str, value: str, status: str) -> DataFrame:
    """Latest storable value of each key; blanks and unreadable values never erase one."""
    return rows.where(F.col(status).isin(STORED)).groupBy(*keys).agg(F.max_by(F.struct(F.col(value), F.col(status)), F.col(at)).alias("__last")).select(*keys, f"__last.{value}", f"__last.{status}")


def profile_diff(profile: DataFrame, new: DataFrame, keys: list[str], value: str, status: str) -> DataFrame:
    """Fields of both that differ, where the new is known or replaces a known one."""
    a, b = profile.select(*keys, F.col(value).alias("old_value"), F.col(status).alias("old_status")), new.select(*keys, F.col(value).alias("new_value"), F.col(status).alias("new_status"))
    relevant = (F.col("new_status") == "KNOWN") | (F.col("old_status") == "KNOWN")
    return a.join(b, keys).where(relevant & ~(F.col("old_value").eqNullSafe(F.col("new_value")) & F.col("old_status").eqNullSafe(F.col("new_status"))))


def latest_version(rows: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """The row of the largest version; an equal version that came later replaces."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, *ties)).alias("__r")).select(key, *(f"__r.{c}" for c in columns))


def code_order(rows: DataFrame, patient: str, code: str, key: str, at: str) -> DataFrame:
    """Codes of each patient: the spelling first seen, in the order last confirmed."""
    kept = rows.groupBy(patient, key).agg(F.min_by(code, at).alias(code), F.max(at).alias("last"))
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(patient).orderBy("last", code)))


def latest_known(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, at).alias(value))


def decide(entry: Column, status: Column, value: Column, source: Column, by: Column, at: Column) -> Column:
    """An entry (status, value, source, confidence, decided_by, decided_at, audit) after a person's decision, which the audit keeps."""
    step = F.struct(at.alias("at"), by.alias("by"), entry["value"].alias("from"), value.alias("to"))
    return F.struct(status.alias("status"), value.alias("value"), source.alias("source"), F.lit(1.0).alias("confidence"), by.alias("decided_by"), at.alias("decided_at"), F.array_append(entry["audit"], step).alias("audit"))


def confirm_all(rows: DataFrame) -> DataFrame:
    """Every confident machine entry becomes a confirmed one; the others stay."""
    sure = ~F.col("source").isin(HUMAN) & ~needs_review(F.col("source"), F.col("status"), F.col("confirm_special"))
    return rows.withColumns({"changed": sure, "source": F.when(sure, "confirmed").otherwise(F.col("source"))})


# Fields that hold the attributes used for matching.
QUASI = {"age": "history.age", "lmp": "pregnancy.lmp_date", "edd": "pregnancy.edd", "gravidity": "history.gravidity", "parity": "history.parity", "province": "cover.province", "region": "cover.region"}


def quasi_identifiers(rows: DataFrame, record: str = "record_id") -> DataFrame:
    """One row for each record: its code (typed, else the one read) and the attributes for matching, from readable entries only."""
    shown = F.col("status").isin("KNOWN", "NEEDS_REVIEW")
    value = lambda field: F.max(F.when(shown & (F.col("field_id") == field), F.col("value")))
    return rows.groupBy(record).agg(F.coalesce(F.max("code"), value("cover.registry_code")).alias("code"), *(value(field).alias(name) for name, field in QUASI.items()))


def resolve(old: Column, new: Column, choice: Column, picked: Column) -> Column:
    """The value that stays when a page is digitised again: all old, all new, or field by field."""
    return F.when(choice == "keep_old", old).when(choice == "take_new", new).when(picked == "new", new).otherwise(old)


def pages_in_profile(fields: DataFrame, profile: DataFrame, key: str, field: str = "field_id") -> DataFrame:
    """(key, page_type) of pages in fields that the profile has already."""
    page = lambda rows: rows.select(key, F.split_part(F.col(field), F.lit("."), F.lit(1)).alias("page_type")).distinct()
    return page(fields).join(page(profile), [key, "page_type"], "left_semi")


def missing_pages(captured: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Page types that a record has, or all of them where it has none."""
    some = captured.select(key).distinct()
    return captured.select(key, "page_type").distinct().unionByName(every.join(some, key, "left_anti").select(key, "page_type"))


def visits_of(profiles: DataFrame, records: DataFrame) -> DataFrame:
    """(patient_id, record_id, date) for the records that a profile lists; ids without a record are skipped."""
    return profiles.select("patient_id", F.explode("records").alias("record_id")).join(records, "record_id")


def summary(rows: DataFrame, key: str, at: str, name: str, shown: str) -> DataFrame:
    """(key, name, line): each field over time as one line, 'date: value' in order of time."""
    points = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.concat_ws(": ", F.date_format(at, "dd/MM/yyyy"), F.col(shown)).alias("text"))))
    return rows.groupBy(key, name).agg(F.array_join(points["text"], "; ").alias("line"))


def totals(rows: DataFrame) -> DataFrame:
    """(n_fields, n_filled, n_stray, n_dropped) of a dataset of pages (fields, unassigned, dropped: arrays)."""
    return rows.agg(F.sum(F.size("fields")).alias("n_fields"), F.sum(F.size(F.filter("fields", lambda f: f.isNotNull() & (f != "")))).alias("n_filled"), F.count_if(F.size("unassigned") > 0).alias("n_stray"), F.sum(F.size("dropped")).alias("n_dropped"))

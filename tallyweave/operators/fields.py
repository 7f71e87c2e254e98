"""Facts joined to a catalogue of fields, and values as they are shown.

A catalogue has one row for each field: field_id, ord (place in the booklet), label, value_type, kind, vocabulary, unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a catalogue up to which it is broadcast.
CATALOGUE_ROWS = 100_000
LAST = 1 << 30
# What is shown for stored tokens and statuses, in French and English.
DISPLAY = {
    "fr": {
        "yes": "Oui", "no": "Non", "negative": "Négatif", "positive": "Positif", "not_done": "Non fait", "immune": "Immunisée", "non_immune": "Non immunisée", "normal": "Normal", "abnormal": "Anormal", "pale": "Pâles", "closed": "Fermé", "open": "Ouvert", "modified": "Modifié",
        "cephalic": "Céphalique", "breech": "Siège", "transverse": "Transverse", "vaginal": "Voie basse", "instrumental": "Instrumentale", "cesarean": "Césarienne", "none": "Rien à signaler", "primary": "Primaire", "secondary": "Secondaire", "higher": "Supérieur", "F": "Fille", "M": "Garçon",
    },
    "en": {
        "yes": "Yes", "no": "No", "negative": "Negative", "positive": "Positive", "not_done": "Not done", "immune": "Immune", "non_immune": "Not immune", "normal": "Normal", "abnormal": "Abnormal", "pale": "Pale", "closed": "Closed", "open": "Open", "modified": "Changed",
        "cephalic": "Cephalic", "breech": "Breech", "transverse": "Transverse", "vaginal": "Vaginal", "instrumental": "Instrumental", "cesarean": "Cesarean", "none": "Nothing to report", "primary": "Primary", "secondary": "Secondary", "higher": "Higher education", "F": "Girl", "M": "Boy",
    },
}
STATUS_DISPLAY = {
    "fr": {"NOT_PROVIDED": "(vide)", "NOT_APPLICABLE": "(non applicable)", "UNKNOWN": "(inconnu)", "ILLEGIBLE": "(illisible)"},
    "en": {"NOT_PROVIDED": "(blank)", "NOT_APPLICABLE": "(not applicable)", "UNKNOWN": "(unknown)", "ILLEGIBLE": "(illegible)"},
}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def with_catalogue(facts: DataFrame, catalogue: DataFrame, key: str = "field_id", strict: bool = True) -> DataFrame:
    """Facts with the columns of their field. strict: a field that the catalogue lacks is an error when the row is read."""
    small = catalogue.limit(CATALOGUE_ROWS + 1).count() <= CATALOGUE_ROWS
    known = catalogue.withColumn("__known", F.lit(True))
    joined = facts.join(F.broadcast(known) if small else known, key, "left")
    if strict:
        seen = F.when(F.col("__known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unknown field: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
        joined = joined.withColumn(key, seen)
    return joined.drop("__known")


def booklet_order(ord_column: Column, key: Column) -> list[Column]:
    """Sort keys: the booklet's order, unknown fields last, ties by id."""
    return [F.coalesce(ord_column, F.lit(LAST)).asc(), key.asc()]


def of_page(field_id: Column, page_type: Column) -> Column:
    return field_id.startswith(F.concat(page_type, F.lit(".")))


def clean_label(label: Column) -> Column:
    """A label without its explanations in brackets and after a long dash."""
    return F.split_part(F.regexp_replace(label, r"\s*\(.*\)", ""), F.lit(" — "), F.lit(1))


def display_value(value: Column, value_type: Column, kind: Column, vocabulary: Column, unit: Column, lang: str = "fr") -> Column:
    """A stored value (text: 'true' and 'false' for booleans, ISO dates, numbers) as it is shown."""
    table = _literal_map(DISPLAY[lang])
    date = F.try_to_date(value, "yyyy-MM-dd")
    number = value.try_cast("double")
    plain = F.when(number.isNotNull() & (number == F.floor(number)) & ~value.contains("/"), F.floor(number).cast("string")).otherwise(value)
    numeric = value_type.isin("int", "float") & number.isNotNull()
    return (
        F.when((kind == "checkbox") | (value_type == "bool"), F.when(value == "true", DISPLAY[lang]["yes"]).otherwise(DISPLAY[lang]["no"]))
        .when(value_type == "date", F.coalesce(F.date_format(date, "dd/MM/yyyy"), value))
        .when((vocabulary.isNotNull() | (value_type == "enum")) & F.map_contains_key(table, F.coalesce(value, F.lit(""))), F.try_element_at(table, value))
        .when((value_type == "gest_age") & value.isNotNull(), F.concat(plain, F.lit(" SA" if lang == "fr" else " weeks")))
        .when(numeric & unit.isNotNull(), F.concat(plain, F.lit(" "), unit))
        .when(numeric, plain)
        .otherwise(F.coalesce(value, F.lit("")))
    )


def display(status: Column, shown: Column, lang: str = "fr") -> Column:
    """The shown value, or what stands for a status without one."""
    return F.when(status.isin("KNOWN", "NEEDS_REVIEW"), shown).otherwise(F.coalesce(F.try_element_at(_literal_map(STATUS_DISPLAY[lang]), status), F.lit("?")))


def percent(rate: Column, digits: int = 1) -> Column:
    """A rate as French text: 93,4 %; a dash without one."""
    return F.when(rate.isNotNull(), F.concat(F.replace(F.format_string(f"%.{digits}f", rate * 100), F.lit("."), F.lit(",")), F.lit(" %"))).otherwise("—")


def interval(low: Column, high: Column, digits: int = 1) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("["), percent(low, digits), F.lit(" ; "), percent(high, digits), F.lit("]"))).otherwise("")


def clock(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "dd/MM HH:mm")


def is_arabic(text: Column) -> Column:
    return text.rlike("[\\u0600-\\u06FF]")


def fill_page(catalogue: DataFrame, entered: DataFrame, pages: DataFrame, key: str = "field_id") -> DataFrame:
    """The end of a typed page: fields of a page's type that nobody entered become unticked boxes or blanks.

    pages (record, page_type), catalogue (field_id, page_type, kind), entered (record, field_id, status, value).
    """
    every = pages.join(catalogue.select(key, "page_type", "kind"), "page_type")
    box = F.col("kind") == "checkbox"
    return every.join(entered, ["record", key], "left").select(
        "record", key, F.coalesce("status", F.when(box, "KNOWN").otherwise("NOT_PROVIDED")).alias("status"), F.when(F.col("status").isNotNull(), F.col("value")).when(box, "false").alias("value"),
        F.when(F.col("status").isNull(), "manual_default").otherwise("manual").alias("source"),
    )

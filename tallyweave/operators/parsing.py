"""Typed parsing of raw readings: one struct (status, value, number, ok, lexicon_score, flags) for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text
from ..functions.vocab import VOCABULARIES

# Least similarity to a vocabulary form; for free text it depends on the length.
CUTOFF, SHORT_TEXT_CUTOFF, TEXT_CUTOFF, SHORT_TEXT = 0.70, 0.65, 0.85, 4
#: Parts over which rows that need no similarity search are spread in its join.
SPREAD = 1024


def vocabulary_forms(spark: SparkSession) -> DataFrame:
    """(vocabulary, ord, form, token): the folded forms of the closed lists, tokens among them; of tokens that share a form the last wins."""
    fold = text.fold_key
    rows = []
    for name, tokens in VOCABULARIES.items():
        index: dict[str, str] = {}
        for token, forms in tokens.items():
            index |= {fold(form): token for form in [token, *forms]}
        rows += [(name, k, form, token) for k, (form, token) in enumerate(index.items())]
    return spark.createDataFrame(rows, "vocabulary string, ord int, form string, token string")


def _matches(keys: DataFrame, forms: DataFrame) -> DataFrame:
    """The most similar form of each distinct (lookup, fold, cutoff), the first of equals; lengths that can't reach the cutoff are never compared."""
    shorter, both = F.least(F.length("__fold"), F.length("form")), F.length("__fold") + F.length("form")
    near = keys.join(F.broadcast(forms), (F.col("__lookup") == F.col("vocabulary")) & (2 * shorter >= F.col("__cutoff") * both - 1e-9))
    scored = near.withColumn("ratio", F.expr(text.indel_ratio("form", "__fold"))).where(F.col("ratio") >= F.col("__cutoff") - 1e-12)
    best = F.max_by(F.struct("token", "ratio"), F.struct("ratio", -F.col("ord")))
    return scored.groupBy("__lookup", "__fold", "__cutoff").agg(best.alias("__near"))


def _parsed(value: Column, ok: Column | bool = True, score: Column | float = 1.0, flag: Column | None = None, number: Column | None = None, status: str = "KNOWN") -> Column:
    flags = F.array().cast("array<string>") if flag is None else F.array_compact(F.array(flag.cast("string")))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    number = F.lit(None) if number is None else number
    return F.struct(F.lit(status).alias("status"), value.cast("string").alias("value"), number.cast("double").alias("number"), as_column(ok).alias("ok"), as_column(score).cast("double").alias("lexicon_score"), flags.alias("flags"))


def _number(clean: Column, number: Column, kind: Column, found: Column, low: Column, high: Column, unit: Column) -> Column:
    outside = F.coalesce(~number.between(low, high), F.lit(False))
    repaired = F.when(outside, parse.repair_number(clean, low, high, unit))
    best = F.coalesce(repaired, number)
    flag = F.when(repaired.isNotNull(), "repaired").when(outside, "out_of_range")
    whole, decimal = parse.round_half_even(best), parse.round_half_even(best, 2)
    none = (kind == "int") & (found["token"] == "none")
    return (
        F.when(number.isNull() & none, _parsed(F.lit("0"), score=found["ratio"], number=F.lit(0)))
        .when(number.isNull(), _parsed(clean, ok=False, flag=F.lit("number_unparsed")))
        .when(kind == "int", _parsed(whole.cast("bigint"), flag=flag, number=whole))
        .otherwise(_parsed(decimal, flag=flag, number=decimal))
    )


def _pressure(clean: Column) -> Column:
    read, repaired = parse.parse_bp(clean), parse.repair_bp("__clean")
    shown = lambda x: F.concat_ws("/", x["sys"].cast("string"), x["dia"].cast("string"))
    plausible = parse.bp_plausible(read["sys"], read["dia"], parse.BP_PARSE)
    return (
        F.when(read.isNotNull(), _parsed(shown(read), flag=F.when(~plausible, "bp_implausible")))
        .when(repaired.isNotNull(), _parsed(shown(repaired), flag=F.lit("repaired")))
        .otherwise(_parsed(clean, ok=False, flag=F.lit("bp_unparsed")))
    )


def parse_values(readings: DataFrame, raw: str = "raw", value_type: str = "value_type", vocabulary: str = "vocabulary", unit: str = "unit", low: str = "low", high: str = "high") -> DataFrame:
    """readings with a column `parsed`: what the raw text says as a value of its type.

    Types are date, bp, int, float, gest_age, bool, code, enum and text; others are read as text. A blank
    or null reading is NOT_PROVIDED, a dash NOT_APPLICABLE, a word of not knowing UNKNOWN; all else is KNOWN, with
    ok = false where it isn't of the type. Null bounds mean any number is plausible; an enum without a known
    vocabulary is never ok. Only distinct readings that equal no form are compared with the forms, of
    which there are a few hundred; other columns pass through.
    """
    kind, number = F.col(value_type), parse.parse_number(F.col("__clean"))
    columns = readings.columns
    rows = readings.withColumn("__clean", text.clean_raw(F.col(raw)))
    rows = rows.withColumn("__fold", text.fold(F.col("__clean"))).withColumn("__special", text.special_status(F.col("__clean"), F.col("__fold")))
    lookup = F.when(kind.isin("int", "float", "gest_age"), F.when((kind == "int") & number.isNull(), F.lit("history"))).when(kind == "bool", "bool").when(~F.coalesce(kind, F.lit("text")).isin("date", "bp", "code"), F.col(vocabulary))
    is_text = ~F.coalesce(kind, F.lit("text")).isin("int", "float", "gest_age", "bool", "enum")
    cutoff = F.when(is_text, F.when(F.length("__fold") <= SHORT_TEXT, SHORT_TEXT_CUTOFF).otherwise(TEXT_CUTOFF)).otherwise(CUTOFF)
    rows = rows.withColumns({"__lookup": F.when((F.col("__clean") != "") & F.col("__special").isNull(), lookup), "__cutoff": cutoff})
    forms = vocabulary_forms(readings.sparkSession)
    exact = forms.select(F.col("vocabulary").alias("__lookup"), F.col("form").alias("__fold"), F.col("token").alias("__exact"))
    rows = rows.join(F.broadcast(exact), ["__lookup", "__fold"], "left")
    search = F.col("__lookup").isNotNull() & F.col("__exact").isNull() & (F.col("__fold") != "")
    near = _matches(rows.where(search).select("__lookup", "__fold", "__cutoff").distinct(), forms).withColumn("__part", F.lit(0).cast("bigint"))
    rows = rows.withColumn("__part", F.when(search, F.lit(0).cast("bigint")).otherwise(F.monotonically_increasing_id() % SPREAD + 1))
    rows = rows.join(near, ["__lookup", "__fold", "__cutoff", "__part"], "left")
    rows = rows.withColumn("__found", F.when(F.col("__exact").isNotNull(), F.struct(F.col("__exact").alias("token"), F.lit(1.0).alias("ratio"))).otherwise(F.col("__near")))
    clean, found = F.col("__clean"), F.col("__found")
    day = parse.parse_date(clean)
    code = F.btrim(F.upper(F.regexp_replace(clean, r"\s", "")), F.lit("/"))
    parsed = (
        F.when(clean == "", _parsed(F.lit(None), status="NOT_PROVIDED"))
        .when(F.col("__special") == "NOT_APPLICABLE", _parsed(F.lit(None), status="NOT_APPLICABLE"))
        .when(F.col("__special") == "UNKNOWN", _parsed(F.lit(None), status="UNKNOWN"))
        .when(kind == "date", F.when(day.isNotNull(), _parsed(day)).otherwise(_parsed(clean, ok=False, flag=F.lit("date_unparsed"))))
        .when(kind == "bp", _pressure(clean))
        .when(kind.isin("int", "float", "gest_age"), _number(clean, number, kind, found, F.col(low), F.col(high), F.col(unit)))
        .when(kind == "bool", F.when(found.isNull(), _parsed(clean, ok=False, score=0.0, flag=F.lit("bool_unparsed"))).otherwise(_parsed(found["token"] == "yes", score=found["ratio"])))
        .when(kind == "code", _parsed(code, ok=code.rlike(r"^[A-Z0-9][A-Z0-9\-/]{2,}$")))
        .when(kind == "enum", F.when(found.isNull(), _parsed(F.col("__fold"), ok=False, score=0.0, flag=F.lit("not_in_vocabulary"))).otherwise(_parsed(found["token"], score=found["ratio"])))
        .otherwise(F.when(found.isNull(), _parsed(clean)).otherwise(_parsed(found["token"], score=found["ratio"])))
    )
    return rows.select(*columns, parsed.alias("parsed"))

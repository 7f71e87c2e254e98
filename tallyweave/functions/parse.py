"""Typed parsing of cleaned readings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible ranges of blood pressure, at parse time and for repairs and rules.
BP_PARSE = (60, 250, 30, 150)
BP_RULE = (70, 220, 40, 140)


def parse_number(raw: Column) -> Column:
    """First number; a comma is a decimal point, a following k means thousands, a sign is ignored; digits that only spaces part belong together."""
    text = F.when(raw.rlike(r"^[0-9\s]+$"), F.regexp_replace(raw, r"\s", "")).otherwise(raw)
    found = F.nullif(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(""))
    number = F.translate(found, ",", ".").try_cast("double")
    return number * F.when(text.rlike(r"[0-9]\s*[kK]\b"), 1000.0).otherwise(1.0)


def repair_number(raw: Column, low: Column, high: Column, unit: Column) -> Column:
    """For a value out of range: all digits without a last 9 that stands for g, or with a lost decimal point; the first that fits, else null."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    value = F.when(~raw.rlike("[.,]"), digits.try_cast("double"))
    no_unit = F.when((unit == "g") & digits.endswith("9") & (F.length(digits) >= 4), F.left(digits, F.length(digits) - 1).try_cast("double"))
    return F.get(F.filter(F.array(no_unit, value / 10, value / 100), lambda x: x.between(low, high)), 0)


def parse_bp(raw: Column) -> Column:
    """struct(sys, dia) or null; pairs in cmHg become mmHg."""
    text = F.regexp_replace(raw, r"\s", "")
    pattern = r"([0-9]{1,3})[/|\\\-]([0-9]{1,3})"
    first, second = F.regexp_extract(text, pattern, 1).try_cast("int"), F.regexp_extract(text, pattern, 2).try_cast("int")
    cm = (first < 30) & (second < 20)
    return F.when(first.isNotNull(), F.struct(F.when(cm, first * 10).otherwise(first).alias("sys"), F.when(cm, second * 10).otherwise(second).alias("dia")))


def bp_plausible(sys: Column, dia: Column, bounds: tuple[int, int, int, int] = BP_RULE) -> Column:
    return sys.between(bounds[0], bounds[1]) & dia.between(bounds[2], bounds[3]) & (sys > dia)


def repair_bp(raw: str) -> Column:
    """For a reading (a column name) of 4 to 7 digits: the slash may be read as 1 or 7, or be lost. The first plausible split."""
    d = f"regexp_replace({raw}, '[^0-9]', '')"
    a, b, c, e = BP_RULE
    return F.expr(f"""if(length({d}) between 4 and 7, get(filter(flatten(transform(sequence(2, length({d}) - 2), i -> array(
        if(substring({d}, i + 1, 1) in ('1', '7') and length({d}) >= 6, struct(try_cast(substring({d}, 1, i) as int) as sys, try_cast(substring({d}, i + 2) as int) as dia), null),
        struct(try_cast(substring({d}, 1, i) as int) as sys, try_cast(substring({d}, i + 1) as int) as dia)))),
        x -> x.sys between {a} and {b} and x.dia between {c} and {e} and x.sys > x.dia), 0), null)""")


def parse_date(raw: Column) -> Column:
    """Day-first date or null; years under 100 are of this century."""
    text = F.regexp_replace(raw, r"\s", "")
    pattern = r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})"
    day, month, year = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2, 3))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", F.when(year < 100, year + 2000).otherwise(year), month, day), "yyyy-MM-dd")


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)

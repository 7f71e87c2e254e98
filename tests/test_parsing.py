import pytest

from tallyweave.operators.parsing import parse_values

# raw, type, vocabulary, unit, low, high -> status, value, ok, flags
CASES = [
    ("26/04/2025", "date", None, None, None, None, "KNOWN", "2025-04-26", True, []),
    ("٢٦/٠٤/٢٠٢٥", "date", None, None, None, None, "KNOWN", "2025-04-26", True, []),
    ("2 6/04/2025", "date", None, None, None, None, "KNOWN", "2025-04-26", True, []),
    ("31/02/2025", "date", None, None, None, None, "KNOWN", "31/02/2025", False, ["date_unparsed"]),
    ("10 4 / 74", "bp", None, None, None, None, "KNOWN", "104/74", True, []),
    ("12/8", "bp", None, None, None, None, "KNOWN", "120/80", True, []),
    ("80/120", "bp", None, None, None, None, "KNOWN", "80/120", True, ["bp_implausible"]),
    ("137192", "bp", None, None, None, None, "KNOWN", "137/92", True, ["repaired"]),
    ("12O/8O", "bp", None, None, None, None, "KNOWN", "12O/8O", False, ["bp_unparsed"]),
    ("3587 g", "int", None, "g", 500.0, 6000.0, "KNOWN", "3587", True, []),
    ("35879", "int", None, "g", 500.0, 6000.0, "KNOWN", "3587", True, ["repaired"]),
    ("791", "float", None, "kg", 30.0, 200.0, "KNOWN", "79.1", True, ["repaired"]),
    ("372", "float", None, None, 34.0, 42.0, "KNOWN", "37.2", True, ["repaired"]),
    ("4", "float", None, "kg", 30.0, 200.0, "KNOWN", "4.0", True, ["out_of_range"]),
    ("186k", "int", None, None, None, None, "KNOWN", "186000", True, []),
    ("11,8 g/dL", "float", None, None, None, None, "KNOWN", "11.8", True, []),
    ("2,5", "int", None, None, None, None, "KNOWN", "2", True, []),
    ("١٢ أسبوع", "gest_age", None, None, None, None, "KNOWN", "12.0", True, []),
    ("Aucun", "int", None, None, None, None, "KNOWN", "0", True, []),
    ("Aucun", "float", None, None, None, None, "KNOWN", "Aucun", False, ["number_unparsed"]),
    ("Oui", "bool", None, None, None, None, "KNOWN", "true", True, []),
    ("لا", "bool", None, None, None, None, "KNOWN", "false", True, []),
    ("!!", "bool", None, None, None, None, "KNOWN", "true", True, []),
    ("zzzz", "bool", None, None, None, None, "KNOWN", "zzzz", False, ["bool_unparsed"]),
    ("Négatif", "enum", "test_result", None, None, None, "KNOWN", "negative", True, []),
    ("negatf", "enum", "test_result", None, None, None, "KNOWN", "negative", True, []),
    ("سلبي", "enum", "test_result", None, None, None, "KNOWN", "negative", True, []),
    ("Wörd", "enum", "test_result", None, None, None, "KNOWN", "word", False, ["not_in_vocabulary"]),
    ("any", "enum", None, None, None, None, "KNOWN", "any", False, ["not_in_vocabulary"]),
    ("eAs", "text", "history", None, None, None, "KNOWN", "none", True, []),
    ("long words here", "text", "history", None, None, None, "KNOWN", "long words here", True, []),
    ("/ab 12-x/", "code", None, None, None, None, "KNOWN", "AB12-X", True, []),
    ("é", "code", None, None, None, None, "KNOWN", "É", False, []),
    ("plain", None, None, None, None, None, "KNOWN", "plain", True, []),
    ("   ", "date", None, None, None, None, "NOT_PROVIDED", None, True, []),
    (None, "int", None, None, None, None, "NOT_PROVIDED", None, True, []),
    ("—", "bp", None, None, None, None, "NOT_APPLICABLE", None, True, []),
    ("inconnu", "enum", "test_result", None, None, None, "UNKNOWN", None, True, []),
]
FUZZ = ["-/-", "12O/8O", "TA: ?/80", "?", "—", "31/02/2025", "1e9", "١٢/٨", "/", "120/", "/80", "999999999", "9" * 40, "x" * 3000]
SCHEMA = "k int, raw string, value_type string, vocabulary string, unit string, low double, high double, token string, form string"


def test_cases(spark):
    rows = [(k, *c[:6], "t", "f") for k, c in enumerate(CASES)]
    got = {r["k"]: r["parsed"] for r in parse_values(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {k: c[6:] for k, c in enumerate(CASES)}
    assert {k: (p["status"], p["value"], p["ok"], p["flags"]) for k, p in got.items()} == want
    score = {CASES[k][0]: round(p["lexicon_score"], 4) for k, p in got.items()}
    assert score["negatf"] == 0.9231 and score["eAs"] == 0.6667 and score["Wörd"] == 0.0 and score["plain"] == 1.0


@pytest.mark.parametrize("empty", [False, True])
def test_odd_readings_never_fail(spark, empty):
    kinds = ["date", "bp", "int", "float", "gest_age", "bool", "code", "enum", "text", None]
    rows = [(k, raw, kind, "history", "g", 1.0, 100.0, None, None) for k, raw in enumerate(FUZZ + FUZZ) for kind in kinds]
    df = spark.createDataFrame([] if empty else rows, SCHEMA)
    got = parse_values(df)
    assert got.columns == [*df.columns, "parsed"]
    assert got.where("parsed.status is not null").count() == len(df.collect())

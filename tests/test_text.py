import duckdb
import pandas as pd

from tallyweave import catalogue

SIDES = ["", "é", "a", "_", "5", " ", "ع", "\u0301", "\u0663", "\u017f", "\u212a"]
IDS = ["AB123456", "ab 123456", "\u212a12345", "\u017f12345", "A\u017f123456", "AB\x0b123456", "AB\u00a0123456", "AB\n12345"]
SEPARATORS = [" ", ".", "-", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\u00a0"]


def test_scrub_equals_sql_beside_other_scripts(spark, tmp_path):
    texts = [a + i + b for a in SIDES for i in IDS for b in SIDES]
    texts += [p + s + "6" + s + s.join("12345678") for s in SEPARATORS for p in ("+212", "0", "x0")]
    texts += [None, "", "$1 AB12345 \\1", "AB1234567890", "AB12345 AB12345"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs)
    want = {k: (None if pd.isna(c) else bool(c), s) for k, c, s in con.execute(catalogue.ORACLE_SQL["q18_pii_scrub"]).fetchall()}
    got = {r.doc_id: (r.changed, r.scrubbed_sha256) for r in catalogue.QUERIES["q18_pii_scrub"](spark, str(tmp_path)).collect()}
    assert got == want

import duckdb
import pytest

from tallyweave import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(df):
    df = df[sorted(df.columns)].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name.startswith("q37")
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        for frame in (got, want):
            for c in frame.columns:
                if frame[c].dtype.kind in "fiub" or str(frame[c].dtype) == "Int64":
                    frame[c] = frame[c].astype(float)
                elif "date" in str(frame[c].dtype) or c == "parsed":
                    frame[c] = frame[c].astype(str).str[:10].replace({"NaT": "None"})
        assert ordered(got).equals(ordered(want)), (ordered(got).head(), ordered(want).head())

"""Every query with SQL gives the values that DuckDB gives on the same tables."""

import duckdb
import pytest

from textloom.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Long plans, covered by the shorter ones that they are made of.
QUICK = [n for n in catalogue.ORACLE_SQL if n not in {"label_agreement", "objective_and_defects", "repeated_openings", "type_token_ratio", "passive_ratio", "indic_features"}]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_values(spark, db, name):
    want = db.sql(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    as_rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert as_rows(got) == as_rows(want)

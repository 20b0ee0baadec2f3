"""Every registered query has a stable schema and, where SQL can say it, the oracle's rows."""

import duckdb
import pytest

from trackmill.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, db, tmp_path, name):
    catalogue.queries()[name](spark, SF).write.parquet(f"{tmp_path}/out")
    want, got = catalogue.oracle_sql()[name], f"SELECT * FROM '{tmp_path}/out/*.parquet'"
    cols = sorted(r[0] for r in db.sql(f"DESCRIBE ({got})").fetchall())
    assert cols == sorted(r[0] for r in db.sql(f"DESCRIBE ({want})").fetchall())
    pick = ", ".join(f'"{c}"' for c in cols)
    for a, b in ((want, got), (got, want)):
        assert not db.sql(f"SELECT {pick} FROM ({a}) EXCEPT ALL SELECT {pick} FROM ({b})").fetchall()


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, SF).columns

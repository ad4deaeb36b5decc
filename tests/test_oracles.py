"""Every registered query of the library against its SQL."""

import duckdb
import pytest

from groundwork.plans import ORACLE_SQL, QUERIES
from tools.compare import TABLES, plain


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_as_of_reads_follow_the_log(spark, tmp_path):
    for n in (1_000, 20_000):
        events = spark.range(n).selectExpr("id AS event_id", "id % 7 AS user_id", "element_at(array('click', 'view', 'purchase'), cast(id % 3 AS int) + 1) AS event_type", "cast(id AS double) AS value")
        events.write.parquet(f"{tmp_path}/{n}/events.parquet")
        assert QUERIES["as_of_share"](spark, f"{tmp_path}/{n}").count() == (n - 1) * 4 // 5
        assert QUERIES["lens_view_share"](spark, f"{tmp_path}/{n}").count() + QUERIES["discarded_types_share"](spark, f"{tmp_path}/{n}").first().n == (n - 1) * 4 // 5

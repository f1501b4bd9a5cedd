import duckdb
import pytest

import quietlake.queries as q


def canon(rows):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in q.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_is_its_sql(spark, con, sf_dir, name):
    df = q.queries()[name](spark, sf_dir.replace("sf0.001", "sf0.01"))
    want = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(tuple(r[c] for c in sorted(names)) for r in df.collect()) == canon(tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["html_to_text_pages", "eml_scrub"])
def test_runs(spark, sf_dir, name):
    assert q.queries()[name](spark, sf_dir).count() > 0

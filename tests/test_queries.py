import pytest

import __spark_entry__ as entry
from gleaner.plans import queries as library


def test_entry(spark, data):
    assert entry.entry(spark).count() == 8


def test_every_library_query_has_sql_or_tests():
    assert set(library.queries()) - set(library.oracle_sql()) == {"markdown_chunks", "search_hybrid"}


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_library_query_gives_what_sql_gives(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels events conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = c.execute(library.oracle_sql()[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(k) for k in columns]
    rows = [[r[k] for k in at] for r in want.fetchall()]
    df = library.queries()[name](spark, data)
    assert sorted(df.columns) == columns
    found = [list(r) for r in df.select(*columns).collect()]
    tidy = lambda x: sorted([["~" if v is None else float(round(v, 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r] for r in x], key=repr)
    assert tidy(found) == tidy(rows)

"""Every query of the library against DuckDB at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
#: At this scale some of these have no row.
MAY_BE_EMPTY = {"publication_state", "search", "extreme_facts", "walk_forward", "accepted_claims", "near_duplicates", "duplicate_links", "recent_duplicates", "pct_inclusive"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame, columns):
    def text(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.5f}".replace("-0.00000", "0.00000")
        return str(v).removesuffix(" 00:00:00")

    floats = {c for c in columns if str(frame[c].dtype).startswith("float")}
    return sorted(tuple(text(float(v)) if c in floats and v is not None and v is not pd.NA and v == v else text(v) for c, v in zip(columns, r, strict=True)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if name not in ORACLE:
        return
    want = duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for c in columns:  # a nullable integer is a float on one side only
        if str(want[c].dtype).startswith("float") or str(got[c].dtype).startswith("float"):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got, columns) == rows(want, columns)

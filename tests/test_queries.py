from __future__ import annotations

import importlib.util
import os

import duckdb
import pandas as pd
import pytest

from kilnspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_oracle(name, spark, duck, sf_dir):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_from_its_file():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_alone", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(catalog.QUERIES) <= set(module.queries()) and set(module.oracle_sql()) <= set(module.queries())

"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from termloom import queries as core

SQL = core.oracle_sql()


def plain(frame: pd.DataFrame) -> list[str]:
    rows = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        row = []
        for v in r:
            if isinstance(v, (list, np.ndarray)):
                v = tuple(np.asarray(v).tolist())
            elif v is None or v is pd.NA or v != v:
                v = None
            elif hasattr(v, "item"):
                v = v.item()
            if isinstance(v, bool) or (isinstance(v, float) and v == int(v)):
                v = int(v)
            row.append(round(v, 6) if isinstance(v, float) else v)
        rows.append(repr(tuple(row)))
    return sorted(rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = core.queries()[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert core.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_equals_batch(spark, sf, tmp_path):
    from termloom.streaming.metrics import dedupe_stream, run_to_end, windowed_counts

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    out = run_to_end(windowed_counts(stream, late="3650 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.count() == 0  # no window is closed while late rows may still come
    kept = run_to_end(dedupe_stream(stream, "event_id", "ts"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert kept.count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()

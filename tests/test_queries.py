"""Every query with SQL agrees with it; the others run and have a stable schema."""

from __future__ import annotations

import shutil

import pandas as pd
import pytest
from compare import differ
from conftest import DATA

from actaloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, name):
    assert not differ(spark, DATA, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert df.columns
    df.count()


@pytest.mark.parametrize("name", ["evidence_contains", "parity"])
def test_long_ids(spark, tmp_path, name):
    long = "x" * 150
    for t in ("law_catalog", "pdf_catalog"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
    pages = pd.read_parquet(f"{DATA}/raw_pages.parquet", dtype_backend="pyarrow")
    pages.loc[pages.index[pages["text"].notna()][0], "id"] = long
    pages.to_parquet(tmp_path / "raw_pages.parquet")
    edges = pd.read_parquet(f"{DATA}/connections.parquet", dtype_backend="pyarrow")
    edges.loc[edges.index[edges["subject"].str.startswith("document:") & (edges["evidence"] != "")][0], "subject"] = f"document:{long}"
    edges.to_parquet(tmp_path / "connections.parquet")
    assert not differ(spark, str(tmp_path), catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

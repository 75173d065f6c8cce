"""Queries of the further catalogues against their SQL at the smallest size."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from docmill.plans import all_oracles, all_queries, catalogue

SF = "/root/testdata/sf0.001"
MORE = sorted(set(all_oracles()) - set(catalogue.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", MORE)
def test_matches_sql(spark, duck, name):
    ours, theirs = all_queries()[name](spark, SF).toPandas(), duck.execute(all_oracles()[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols and len(ours) == len(theirs) > 0
    ours, theirs = (x[cols].sort_values(cols).reset_index(drop=True) for x in (ours, theirs))
    for c in cols:
        if ours[c].dtype.kind == "f":
            assert np.allclose(ours[c], theirs[c].astype(float), equal_nan=True), c
        else:
            same = ours[c].astype(str) == theirs[c].astype(str)
            assert same.all(), (c, ours[~same].head(3).to_dict("records"), theirs[~same].head(3).to_dict("records"))

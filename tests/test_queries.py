"""Every document-preparation query against its SQL at the smallest size."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from docmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols and len(ours) == len(theirs)
    ours, theirs = (x[cols].sort_values(cols).reset_index(drop=True) for x in (ours, theirs))
    for c in cols:
        if ours[c].dtype.kind == "f":
            assert np.allclose(ours[c], theirs[c], equal_nan=True), c
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c


def test_every_branch_occurs(spark):
    kinds = {(r["status"], r["type"]) for r in catalogue.block_status_counts(spark, SF).collect()}
    assert {("discard", "marketing_cta"), ("discard", "footer"), ("discard", "transcript_filler"), ("keep", "code"), ("keep", "table"), ("keep", "operation_step"), ("evidence", "revenue_claim"), ("discard", "garbled_text")} <= kinds

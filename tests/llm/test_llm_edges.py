"""Every llm query of a numbered problem on empty tables and on tables of NULLs only."""

import glob
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF

from plexaform.llm.queries import R

NAMES = [n for n in R.queries if re.match(r"p\d+_", n)]


@pytest.fixture(scope="module", params=["empty", "nulls"])
def bare(request, tmp_path_factory):
    out = tmp_path_factory.mktemp(request.param)
    for p in glob.glob(f"{SF}/*.parquet"):
        t = pq.read_table(p)
        name = os.path.basename(p)
        if request.param == "empty":
            t = t.slice(0, 0)
        elif name != "context_windows.parquet":
            t = pa.table({c: pa.nulls(3, t.schema.field(c).type) for c in t.column_names})
        pq.write_table(t, out / name)
    return request.param, str(out)


@pytest.mark.parametrize("name", NAMES)
def test_bare_tables(spark, bare, name):
    kind, path = bare
    n = R.queries[name](spark, path).count()
    # rows that say nothing make no case; where every row has a result, repeated NULL records count as one
    assert n == ({"p6_split": 1, "p6_split_totals": 1, "p8_clean_documents": 3}.get(name, 0) if kind == "nulls" else 0)

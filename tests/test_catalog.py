"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from scriven.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, str(SF))
    if name not in catalog.SQL:
        assert df.count() > 0
        return
    rel = con.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(repr(norm(tuple(r))) for r in rows)
    assert key(df.select(*names).collect()) == key(rel.fetchall())


def test_ledger_totals_condenses_each_document_once_a_run(spark, monkeypatch):
    plans = []
    record = catalog.ledger.Ledger.record
    monkeypatch.setattr(catalog.ledger.Ledger, "record", lambda self, done, run=None: (plans.append(done._jdf.queryExecution().optimizedPlan().toString()), record(self, done, run))[1])
    catalog.ledger_totals(spark, str(SF))
    assert len(plans) == 3
    assert all(p.index("Filter") > p.index("ArrowEvalPython") for p in plans)  # the run's documents are chosen below

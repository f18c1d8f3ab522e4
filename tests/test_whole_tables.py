"""Queries on tables whose ids pass every small bound: all rows must count."""

from __future__ import annotations

import inspect

import duckdb
import pytest

from tessera.operators.calibration import targeting
from tessera.plans import catalog, relational
from tests.conftest import SF
from tests.test_oracle import TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["cluster_bootstrap", "paired_bootstrap"])
def test_every_customer_is_a_cluster(spark, duck, name):
    n, point = duck.execute("SELECT count(DISTINCT o_custkey), max(o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey").fetchone()
    assert n > 900 and point >= 1000
    got = catalog.queries()[name](spark, SF)
    cursor = duck.execute(catalog.oracle_sql()[name])
    found = got.collect()
    assert found[0].n_documents == n
    names = [d[0] for d in cursor.description]
    assert rows(got.columns, found) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", ["maxstat_bootstrap", "superiority_verdict"])
def test_every_supplier_counts(spark, name, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW whole AS SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet'")
    # suppliers from 100 on are many and all better than the few below
    con.execute(f"""COPY (SELECT * REPLACE (l_partkey % 400 + 1 AS l_suppkey, CASE WHEN l_partkey % 400 < 99 THEN 0.0e0 ELSE 0.08e0 END AS l_discount,
        CASE WHEN l_partkey % 400 < 99 THEN 0.0e0 ELSE 0.07e0 END AS l_tax) FROM whole) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = catalog.queries()[name](spark, str(tmp_path))
    found = got.collect()
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert rows(got.columns, found) == rows(names, cursor.fetchall())
    if name == "maxstat_bootstrap":
        assert {r.n_documents for r in found} == {400} and all(r.directional_win for r in found)
    else:
        assert found[0].permitted and found[0].n_wins == 4


def test_every_line_is_audited(spark, duck):
    found = catalog.queries()["determinism_audit"](spark, SF).collect()
    assert sum(r.n_prompts * r.repeats for r in found) == duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    want = duck.execute("SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1)").fetchone()[0]
    assert sum(r.n_disagreeing for r in found) == want


def test_frames_and_fills_have_the_operators_own_sizes(spark, monkeypatch):
    assert {r.window_tokens for r in catalog.queries()["source_frames"](spark, "/root/testdata/sf0.001").select("window_tokens").distinct().collect()} == {2000}
    seen = {}
    monkeypatch.setattr(relational.calibration, "targeting", lambda *a, **k: seen.update(inspect.signature(targeting).bind(*a, **k).arguments))
    relational.knapsack_gstar(spark, "/root/testdata/sf0.001")
    assert seen.get("draws", 512) == 512

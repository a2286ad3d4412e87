import json

import duckdb
import pytest

import __spark_entry__ as contract
from tallyspark.views import BASE_TABLES
from tools.check import canonical

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "p14_fix_chain", "d5_dedupe_mode", "j4_merge_feedback", "a11_eval_hierarchical", "a12_latency", "k7_stratified_split",
    "f5_extract_amounts", "f22_parse_time_range", "a25_profile", "w1_group_lines", "j13_reconcile_total", "w15_total_amount",
    "g9_supplement", "st2_apply_corrections", "st5_daily_spend",
]


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 200


def test_every_twin_is_sql():
    assert [name for name, sql in contract.oracle_sql().items() if not isinstance(sql, str)] == []


def test_json_arrays_stay_bounded(spark, tmp_path, monkeypatch):
    from tallyspark.plans import pipelines

    folder = str(tmp_path / "arrays")
    monkeypatch.setattr(pipelines, "scratch", lambda spark, name: folder)
    monkeypatch.setattr(pipelines, "ARRAY_IDS", 160)
    rows = contract.queries()["s4_read_json_array"](spark, SMALL)
    got = [(r.part, r.row_id) for r in rows.collect()]
    sizes = [len(json.loads(r.value)) for r in spark.read.text(folder).collect()]
    assert sum(sizes) == len(got) and all(part == row_id % 16 for part, row_id in got)
    assert max(sizes) <= 10 and len(sizes) > 16


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["label", "count", "target", "gap", "type"] and got.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, duck, name):
    frame = contract.queries()[name](spark, SMALL)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    rel = duck.execute(contract.oracle_sql()[name])
    assert got == canonical([d[0] for d in rel.description], rel.fetchall())

"""Every query against its SQL on the smallest tables; plans of the headline queries."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    done = db.execute(entry.oracle_sql()[name])
    want, columns = done.fetchall(), [c[0] for c in done.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20


def test_panel_shuffles_once_by_entity(spark):
    text = plan(entry.queries()["market_state_supplier"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning(entity") <= 2 and "SortMergeJoin" not in text
    assert "l_quantity:double" in text and "l_tax" not in text and "l_partkey" not in text


def test_post_filter_stays_above_the_cut(spark):
    text = plan(entry.queries()["market_postcut_comparison"](spark, FOLDER))
    assert text.index("pct_change") < text.index("TakeOrderedAndProject") and "TakeOrderedAndProject(limit=50" in text


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["events_zero_errors"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)" in text


def test_topk_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["text_bm25"](spark, FOLDER))

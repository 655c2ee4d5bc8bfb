import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["mean"] <= 1 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")
def test_lookup_scan_is_pruned_and_pushed_down(spark):
    plan = entry.queries()["light_scan"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema:")[1]
    plan = entry.queries()["point_lookup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(conv_id,7)" in plan and "EqualTo(turn,2)" in plan


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")
def test_sentence_chain_has_no_exchange_when_splits_suffice(spark):
    from rostrum.operators import transcripts
    from rostrum.plans.catalog import Tables

    docs = Tables(spark, SMALL).documents.selectExpr("doc_id", "text as raw_text")
    plan = transcripts.sentence_records(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.skipif(not os.environ.get("ROSTRUM_ORACLE"), reason="set ROSTRUM_ORACLE=1 to compare every query with SQL")
def test_all_queries_match_their_oracle():
    done = subprocess.run([sys.executable, str(ROOT / "tools/check.py"), "--sf", "0.001"], capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-4000:]

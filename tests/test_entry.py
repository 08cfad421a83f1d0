"""The entry points, with and without the training-data operators."""

import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each module; all of them are compared at a larger size elsewhere.
SOME = ["A17_monthly_report", "A9_health_score", "R1_recurring", "D1_duplicates", "D3_best_refund", "C4_suggestion_cascade", "V1_W5_balance_chain", "A36_W9_encounters", "S4_S5_S6_S11_staged_rows", "Q7_stage_timings", "A55_goal_progress"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_folders():
    code = "import sys; sys.modules['ledgerloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert not [m for m in sys.modules if m.startswith('ledgerloom.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_entry_and_some_queries_match_duckdb(spark):
    assert entry.entry(spark).limit(1).count() == 1
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name in SOME:
        got, want = entry.queries()[name](spark, SMALL).toPandas(), db.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        plain = lambda df: sorted(tuple("" if v is None or v is pd.NA or v != v else round(float(v), 3) if isinstance(v, (int, float, np.integer)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
        assert plain(got) == plain(want), name

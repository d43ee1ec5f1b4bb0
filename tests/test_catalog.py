"""The registered queries: contract, SQL parity on the smallest tables, plans."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import duck, rows_of
from hippolake.plans.catalog import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: One of each family; compare.py runs them all.
SAMPLE = ["J1_overlap_search", "H7_fused_rerank", "S2_keyset_page", "W1_store_once", "W3_log_replay", "R3_gap_sessions", "C13_resolve_contradictions", "C17_weight_tuning", "A16_retrieval_quality", "J4_lsh_buckets", "J6_shared_entities", "J2_paged_search", "C23_assigned_chunks", "S2_keyset_requests", "J11_supersession_chains", "F11_provenance", "C29_heuristic_extraction"]


def test_contract():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(found) and set(SQL) <= set(QUERIES) and set(sql) <= set(found)


def test_entry_makes_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    cur = duck(small).execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["J1_overlap_search", "J6_contradiction_band", "J12_co_occurrence"])
def test_no_nested_loops(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scans_are_pruned_and_filtered(spark, small):
    plan = QUERIES["S1_export_active"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_corpus_subpackage(tmp_path, gone):
    """The two folders go, with or without the pipeline; all else imports, and tests of all else pass."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    check = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert not any(k.startswith('op') for k in e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", check], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_operators.py", "tests/test_imports.py"], cwd=copy, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused():
    """Executors can't see each other's local folders."""
    from types import SimpleNamespace

    from hippolake.storage import shared_dir

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context))

"""The driver contract, and a side-by-side run of fast queries on the smallest data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

from . import oracle

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "F3_closing_soon", "F5_text_filter", "A1_period_counters", "A9_shares", "A12_sector_facet", "A15_review_stats", "E5_verdicts",
    "E7_ranked_buckets", "E8_extract_eligibility", "Q1_query_groups", "Q7_search", "Q8_typeahead", "M2_text_exists", "M7d_fill_core",
    "W1_section_carry_forward", "W12_previous_same_file", "I2_header_detection", "R1_windowed_counts", "R2_lockouts_batch", "R2_lockouts_stream",
]


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 150
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, key):
    con = oracle.connect(SMALL)
    _, _, verdict = oracle.compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SMALL)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("gone", [("lodestar/llm", "corpus_pipeline.py"), ("lodestar/llm",), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    root = Path(entry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if "corpus_pipeline.py" not in gone and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    skipped = ["__pycache__", *(["llm"] if "lodestar/llm" in gone else [])]
    shutil.copytree(root / "lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns(*skipped))
    if "lodestar/llm" in gone:
        (tmp_path / "lodestar" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted folder may leave behind
    code = "import __spark_entry__ as e; names = e.queries(); assert set(e.oracle_sql()) <= set(names); print(len(names), 'pipeline' in names)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    count, pipeline = done.stdout.split()
    assert int(count) > 150 and pipeline == "False"

"""The driver's contract, and that the rest works without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from docstruct.plans.queries import QUERIES
from tests.conftest import ROOT, SMALL


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and set(QUERIES) <= set(entry.oracle_sql())


def value(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", ["out_outline", "sec_sections", "rel_sentences", "fea_font", "cls_cascade", "agg_doc_font_stats", "sts_profile"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t[:-8]} as select * from '{SMALL}/{t}'")
    df = entry.queries()[name](spark, SMALL)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted([value(r[rel.columns.index(c)]) for c in sorted(rel.columns)] for r in rel.fetchall())
    assert sorted([value(r[c]) for c in sorted(df.columns)] for r in df.collect()) == want


def test_without_llm(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n == set(e.oracle_sql()) and 'out_outline' in n and not any(x.startswith('op') for x in n)"
    assert subprocess.run([sys.executable, "-c", code], cwd=there, env=os.environ | {"PYTHONPATH": str(there)}).returncode == 0

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexiloom.plans.catalogue import QUERIES
from lexiloom.plans.oracle import ORACLE

ROOT = Path(__file__).parent.parent


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "raw", "rank"]


def test_every_statement_has_its_query():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lexiloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lexiloom").parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_the_rest_works_without_the_subpackage():
    code = "import sys; sys.modules['lexiloom.llm'] = None; import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not [k for k in e.queries() if k[0] == 'p' and k[1].isdigit()]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0

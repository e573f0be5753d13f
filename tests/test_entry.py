import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"ngram", "pmi", "frequency"}


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_corpus_operators(tmp_path, pipeline):
    """In a copy without both folders, with and without the pipeline's file."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'pmi_2_topk' in q; print(*q)"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr[-2000:]
    names = ran.stdout.split()
    assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_corpus_operators_are_there_where_their_package_is():
    there = importlib.util.find_spec("inkwell.llm") is not None and importlib.util.find_spec("inkwell.llm").origin is not None
    assert ("op1_sharding" in entry.queries()) == there

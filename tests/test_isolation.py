"""The library without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("sparkloom/llm", "tests/llm"), ("sparkloom/llm", "tests/llm", "corpus_pipeline.py")], ids=["folders", "folders_and_pipeline"])
def test_queries_work_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)

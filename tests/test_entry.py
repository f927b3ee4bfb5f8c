"""The entry module, also with the optional part taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["chartloom/llm", "tests/llm", "corpus_pipeline.py"], ["chartloom/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, gone):
    for name in ("chartloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert ran.returncode == 0, ran.stderr
    queries, sql, pipeline = ran.stdout.split()
    assert int(queries) > 60 and int(sql) > 60 and pipeline == "False"

"""The driver contract, with and without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(o) <= set(q), len(q))"


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"], ["ferrule/llm", "tests/llm"], ["ferrule/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_without_the_optional_parts(tmp_path, gone):
    for name in ("ferrule", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    has = (tmp_path / "ferrule/llm").exists()
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True)
    if "ferrule/llm" in gone:
        (tmp_path / "ferrule/llm/__pycache__").mkdir(parents=True)  # what is left of a deleted package
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    some = has and "ferrule/llm" not in gone
    ops, pipeline, twins, n = run.stdout.split()
    assert (ops, pipeline, twins) == ("10" if some else "0", str(some and not any("pipeline" in g for g in gone)), "True") and int(n) > 50

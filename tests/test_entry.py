import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
LLM = importlib.util.find_spec("marlstone.llm") is not None


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert any(n.startswith("op") for n in q) == ("pipeline" in q) == LLM
    out = entry.entry(spark)
    assert out.columns == ["source", "target", "distance"] and out.count() == 4


def test_contract_without_the_corpus_operators(tmp_path):
    """The entry module in a copy without the subpackage, where the pipeline
    file still lies."""
    for name in ("marlstone", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120).returncode == 0

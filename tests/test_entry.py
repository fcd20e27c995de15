"""The entry without the optional folders, in a copy of the tree."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without(tmp_path, left_out):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out:
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "evalspark"), tmp_path / "evalspark", ignore=lambda d, names: [n for n in names if n in left_out or n == "__pycache__"])
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    total, optional, named = out.stdout.split()
    assert int(total) > 195 and named == "True" and ("llm" not in left_out or optional == "0")

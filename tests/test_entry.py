"""The entry module stands without the operators for training data, and without packages that these need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["larkspur.llm", "corpus_pipeline", "ahocorasick", "zstandard"])
def test_queries_without(missing):
    code = f"""import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
assert len(e.queries()) > 80 and set(e.queries()) == set(e.oracle_sql()) and not any(k.startswith("op1_") or k == "pipeline" for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)

"""The entry works without the training-data operators, and without what they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["trawl.llm", "public_tokenizers", "corpus_pipeline"])
def test_entry_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print('discover' in q, " \
           "'pipeline' in q, any(k.startswith('op12_') for k in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
    found = os.path.isdir(os.path.join(ROOT, "trawl", "llm")) and missing == "corpus_pipeline"
    assert out.stdout.split() == ["True", "False", str(found), "True"]

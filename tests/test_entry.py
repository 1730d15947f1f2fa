"""The entry module works with and without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_without_llm(tmp_path):
    code = textwrap.dedent(
        """
        import importlib.util as u
        real = u.find_spec
        u.find_spec = lambda name, *a: None if name.startswith(("quarrygraph.llm", "corpus_pipeline")) else real(name, *a)
        import __spark_entry__ as e
        q = e.queries()
        assert q and not any(k.startswith("op") and k[2].isdigit() for k in q) and "pipeline" not in q
        assert set(e.oracle_sql()) <= set(q)
        """
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_llm():
    for f in (ROOT / "quarrygraph").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "quarrygraph.llm" not in f.read_text(), f


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""The core stands without the subpackage for training data."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_core_does_not_import_the_subpackage():
    for f in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"(?m)^\s*(?:from|import)\s.*\bllm\b", f.read_text()), f


def test_core_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_names_of_problem_queries_are_kept_for_them():
    from tidemark import queries as core

    assert {n for n in core.queries() if re.match(r"p\d+_", n)} == {"p4_found", "p4_summary"}


def test_no_local_checkpoints():
    for f in (ROOT / "tidemark").rglob("*.py"):
        assert "localCheckpoint" not in f.read_text()

"""The entry points, with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len([n for n in entry.queries() if n.startswith("q_rule_")]) == 32


def test_rest_works_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "codequarry", tmp_path / "codequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_scan' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    for folder in ("functions", "operators", "plans", "sinks", "sources", "streaming"):
        assert not any("codequarry.llm" in p.read_text() for p in (ROOT / "codequarry" / folder).rglob("*.py"))


def test_what_the_text_operators_need_is_not_forgiven(tmp_path):
    shutil.copytree(ROOT / "codequarry", tmp_path / "codequarry", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ModuleNotFoundError as x:\n    assert x.name == 'corpus_pipeline'\nelse:\n    raise SystemExit(1)"
    if (ROOT / "codequarry/llm").is_dir():
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)

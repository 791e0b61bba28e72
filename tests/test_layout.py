"""The library stands without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_subpackage(tmp_path):
    for name in ("threadloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    said = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())), any(q.startswith('op') for q in e.queries()))"
    got = subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert got.returncode == 0, got.stderr[-500:]
    count, *rest = got.stdout.split(maxsplit=1)
    assert int(count) >= 40 and rest[0].strip() == "[] False"


def test_nothing_else_imports_the_subpackage():
    for place in (ROOT / "threadloom").rglob("*.py"):
        if "llm" not in place.relative_to(ROOT).parts:
            assert "threadloom.llm" not in place.read_text() and "import llm" not in place.read_text(), place
